"""Signals, pipelines and query shaping over parts, nodes and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filters as fl
from ..operators import reports as rp
from ..operators import retrieval as rt
from ..operators import signals as sg
from ..plans.model import weight
from ..plans.registry import query
from ..sources.tables import duck, supply, table

_TEXTS = "SELECT p_name AS q FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT c_name FROM customer UNION ALL SELECT concat('func ', p_name, '(x int)') FROM part UNION ALL SELECT concat(p_brand, '.go') FROM part UNION ALL SELECT ''"


def _texts(s, d):
    return s.sql(_TEXTS.replace("FROM part", "FROM {part}").replace("FROM pages", "FROM {pages}").replace("FROM customer", "FROM {customer}"), part=table(s, d, "part"), pages=table(s, d, "pages"), customer=table(s, d, "customer"))


_CLASS = r"""CASE WHEN trim(q) = '' THEN 'unknown' WHEN regexp_matches(trim(q), '\w\(.*\)|->|=>') OR regexp_matches(trim(q), '^(func|def|fn)\s+\w') THEN 'signature'
    WHEN (contains(trim(q), '/') AND NOT contains(trim(q), ' ')) OR regexp_matches(trim(q), '^[\w.-]+\.(go|py|ts|tsx|js|rs|java|md|json|ya?ml)$') THEN 'path'
    WHEN NOT contains(trim(q), ' ') AND regexp_matches(trim(q), '^[\w.:#]+$') AND (regexp_matches(trim(q), '[_.:#]') OR regexp_matches(trim(q), '[a-z][A-Z]') OR regexp_matches(trim(q), '^[A-Z]')) THEN 'symbol' ELSE 'concept' END"""


@query("query_classes", f"SELECT {_CLASS} AS class, count(*) AS n FROM ({_TEXTS}) GROUP BY 1")
def _(s, d):
    return _texts(s, d).groupBy(sg.query_class_of(F.col("q")).alias("class")).agg(F.count("*").alias("n"))


_BAGS = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' AND ', p_brand, ' OR ', p_type) WHEN 1 THEN concat('\"', p_name, '\" \"', p_brand, '\" \"', p_type, '\"') WHEN 2 THEN concat(p_brand, ', ', p_type, ', x') ELSE concat('how is the ', p_name, ' made, sold and kept') END AS q FROM part"


@query("keyword_soup", f"""
    SELECT id, len(regexp_extract_all(q, '\\b(AND|OR|NOT)\\b|\\|')) >= 2 OR len(regexp_extract_all(q, '"[^"]+"')) >= 3 OR (len(regexp_extract_all(q, ',')) >= 2 AND NOT regexp_matches(q, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+')) AS soup FROM ({_BAGS})""")
def _(s, d):
    return s.sql(_BAGS.replace("FROM part", "FROM {part}"), part=table(s, d, "part")).select("id", sg.is_soup(F.col("q")).alias("soup"))


@query("soup_fragments", f"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(q, '\\s*(?:\\b(?:AND|OR|NOT)\\b|\\||,)\\s*'), lambda p: trim(replace(p, '\"', ''))), lambda p: p <> ''), ';') AS parts FROM ({_BAGS}) WHERE id % 4 IN (0, 2)")
def _(s, d):
    q = s.sql(_BAGS.replace("FROM part", "FROM {part}"), part=table(s, d, "part")).where("id % 4 IN (0, 2)")
    return q.select("id", F.array_join(sg.fragments(F.col("q")), ";").alias("parts"))


_SYNONYMS = [["red", "Crimson", "scarlet"], ["bolt", "screw"]]


@query("synonym_expansion", """
    WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token FROM part),
    v(low, other) AS (VALUES ('red', 'crimson'), ('red', 'scarlet'), ('crimson', 'red'), ('crimson', 'scarlet'), ('scarlet', 'red'), ('scarlet', 'crimson'), ('bolt', 'screw'), ('screw', 'bolt'))
    SELECT id, token FROM t UNION SELECT id, other FROM t JOIN v ON lower(token) = low""")
def _(s, d):
    t = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return sg.expand(t, _SYNONYMS)


@query("decompose_rescue", duck("""
    WITH q AS (SELECT DISTINCT concat('find_', replace(p_name, ' ', '_')) AS query FROM part), tok AS (SELECT query, unnest(list_distinct(list_filter(string_split(lower(query), '_'), lambda t: length(t) >= 2))) AS part FROM q),
    names AS (SELECT DISTINCT unnest(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) >= 2)) AS part FROM part)
    SELECT DISTINCT query, part FROM tok WHERE part IN (SELECT part FROM names)"""))
def _(s, d):
    p = table(s, d, "part")
    return sg.rescue(p.select(F.concat(F.lit("find_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("query")).distinct(), p.select(F.col("p_name").alias("name")))


#: Batches of candidates: parts by type, with the files and communities of the graph.
_BATCH = "b AS (SELECT p_type AS query, concat('p', p_partkey) AS id, p_name AS name, p_brand AS community, concat('src/part/', lower(replace(p_brand, '#', '_')), '.rs') AS file, p_size FROM part)"


def _batch(s, d):
    p = table(s, d, "part")
    file = F.concat(F.lit("src/part/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".rs"))
    return p.select(F.col("p_type").alias("query"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("community"), file.alias("file"), "p_size")


@query("signal_community", f"WITH {_BATCH}, n AS (SELECT query, community, count(*) AS own FROM b GROUP BY 1, 2) SELECT b.query, id, round(own / max(own) OVER (PARTITION BY b.query), 6) AS s_community FROM b JOIN n ON n.query = b.query AND n.community = b.community")
def _(s, d):
    return sg.with_community(_batch(s, d)).select("query", "id", F.round("s_community", 6).alias("s_community"))


@query("signal_same_place", duck("SELECT id, CAST(CASE WHEN repo_prefix = 'shop' THEN 1.0 WHEN language = 'rust' THEN 0.7 ELSE 0.0 END AS DOUBLE) AS s FROM nodes"))
def _(s, d):
    return supply(s, d).nodes.select("id", sg.same_place(F.col("repo_prefix"), F.col("language"), "shop", "rust", True).alias("s"))


@query("signal_fan", duck(f"WITH {_BATCH}, f AS (SELECT dst AS id, count(*) AS n FROM edges WHERE kind = 'references' GROUP BY 1), x AS (SELECT b.query, b.id, coalesce(n, 0) AS n FROM b LEFT JOIN f USING (id)) SELECT query, id, round(CASE WHEN max(n) OVER w > 0 THEN ln(1 + n) / ln(1 + max(n) OVER w) ELSE 0.0 END, 6) AS s_fan_in FROM x WINDOW w AS (PARTITION BY query)"))
def _(s, d):
    f = supply(s, d).edges.where("kind = 'references'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return _batch(s, d).join(f, "id", "left").fillna(0, ["n"]).select("query", "id", F.round(sg.fan_signal("n"), 6).alias("s_fan_in"))


@query("signal_cohesion", f"""
    WITH {_BATCH}, h AS (SELECT query, p_size, count(*) AS m FROM b GROUP BY 1, 2),
    x AS (SELECT a.query, a.p_size, sum((o.m - CASE WHEN a.p_size = o.p_size THEN 1 ELSE 0 END) / CAST(1 + abs(a.p_size - o.p_size) AS DOUBLE)) AS s FROM h a JOIN h o ON o.query = a.query GROUP BY 1, 2), n AS (SELECT query, count(*) AS n FROM b GROUP BY 1)
    SELECT b.query, b.id, CAST(round(CASE WHEN n > 1 THEN coalesce(s, 0) / (n - 1) ELSE 0 END, 6) AS DOUBLE) AS cohesion FROM b JOIN n ON n.query = b.query LEFT JOIN x ON x.query = b.query AND x.p_size = b.p_size""")
def _(s, d):
    batch = _batch(s, d).select("query", "id", F.col("p_size").alias("value"))
    return sg.cohesion(batch, lambda a, b: 1.0 / (1 + F.abs(a - b))).select("query", "id", F.round("cohesion", 6).alias("cohesion"))


@query("signal_churn", "SELECT l_partkey AS id, round(ln(1 + count(*)) / ln(1 + max(count(*)) OVER ()), 6) AS s_churn FROM lineitem GROUP BY 1")
def _(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most)).select("id", F.round(rt.norm_log(F.col("n"), F.col("most")), 6).alias("s_churn"))  # one row


@query("signal_signature", "SELECT p_partkey AS id, len(list_intersect(['red', 'ring', 'economy'], string_split(lower(p_name || ' ' || p_type), ' '))) / 3 AS s_signature FROM part")
def _(s, d):
    asked = F.array(*map(F.lit, ("red", "ring", "economy")))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), sg.overlap(asked, F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("s_signature"))


_WEIGHTS = "CASE origin WHEN 'ast_resolved' THEN 1.0 WHEN 'ast_inferred' THEN 0.7 WHEN 'lsp_resolved' THEN 0.5 WHEN 'lsp_dispatch' THEN 0.5 ELSE 0.3 END"


@query("signal_provenance", duck(f"SELECT dst AS id, CAST(round(avg({_WEIGHTS}), 6) AS DOUBLE) AS s_provenance FROM edges GROUP BY 1"))
def _(s, d):
    return sg.provenance(supply(s, d).edges, weight(F.col("origin"))).select("id", F.round("s_provenance", 6).alias("s_provenance"))


@query("provenance_attenuation", duck(f"SELECT origin, CAST(round(sum({_WEIGHTS}), 4) AS DOUBLE) AS mass, count(*) AS edges FROM edges GROUP BY 1"))
def _(s, d):
    return supply(s, d).edges.groupBy("origin").agg(F.round(F.sum(weight(F.col("origin"))), 4).alias("mass"), F.count("*").alias("edges"))


@query("signal_co_change", f"""
    WITH {_BATCH}, f AS (SELECT DISTINCT query, file FROM b), li AS (SELECT DISTINCT l_orderkey, file FROM lineitem JOIN b ON b.id = concat('p', l_partkey)),
    c AS (SELECT a.file AS a, b.file AS b, count(*) AS together FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.file <> b.file GROUP BY 1, 2),
    x AS (SELECT f1.query, f1.file, sum(together) AS t FROM c JOIN f f1 ON f1.file = c.a JOIN f f2 ON f2.file = c.b AND f2.query = f1.query GROUP BY 1, 2), n AS (SELECT query, count(*) AS n FROM f GROUP BY 1)
    SELECT f.query, f.file, round(CASE WHEN n > 1 THEN coalesce(t, 0) / (n - 1) ELSE 0.0 END, 6) AS s_co_change FROM f JOIN n USING (query) LEFT JOIN x ON x.query = f.query AND x.file = f.file""")
def _(s, d):
    b = _batch(s, d)
    li = table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")).join(b.select("id", "file"), "id").select("l_orderkey", "file").distinct()
    pairs = li.toDF("l_orderkey", "a").join(li.toDF("l_orderkey", "b"), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))
    return sg.co_change(b, pairs).select("query", "file", F.round("s_co_change", 6).alias("s_co_change"))


@query("signal_definition", duck("SELECT id, CASE WHEN kind IN ('function', 'method', 'type', 'interface') AND lower(name) = 'red ring' THEN 1.0 WHEN kind IN ('function', 'method', 'type', 'interface') AND starts_with(lower(name), 'red ring') THEN 0.5 ELSE CAST(0.0 AS DOUBLE) END AS s FROM nodes"))
def _(s, d):
    return supply(s, d).nodes.select("id", sg.definition(F.col("kind"), F.col("name"), F.lit("red ring")).alias("s"))


@query("signal_prominence", duck("WITH f AS (SELECT n.id, n.name, count(e.src) AS n FROM nodes n LEFT JOIN edges e ON e.dst = n.id WHERE n.kind = 'type' GROUP BY 1, 2) SELECT id, round(1.0 / row_number() OVER (PARTITION BY name ORDER BY n DESC, id), 6) AS s_prominence FROM f"))
def _(s, d):
    g = supply(s, d)
    n = rp.degrees(g.edges).select("id", F.col("fan_in").alias("n"))
    batch = g.nodes.where("kind = 'type'").select("id", "name").join(n, "id", "left").fillna(0, ["n"])
    return sg.prominence(batch, "name", "n", "id").select("id", F.round("s_prominence", 6).alias("s_prominence"))


@query("signal_source", duck(f"SELECT id, CASE WHEN regexp_matches(CASE WHEN start_line % 3 = 0 THEN concat('tests/', file_path) ELSE file_path END, '{fl.TEST_PATH}') THEN 0.3 ELSE CAST(1.0 AS DOUBLE) END AS s FROM nodes"))
def _(s, d):
    path = F.when(F.col("start_line") % 3 == 0, F.concat(F.lit("tests/"), "file_path")).otherwise(F.col("file_path"))
    return supply(s, d).nodes.select("id", sg.source(path).alias("s"))


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))"


@query("signal_cosine", f"SELECT b.vec_id AS id, round({_COS} / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 4) AS s_cosine FROM embeddings b JOIN embeddings a ON a.vec_id = 0")
def _(s, d):
    e = table(s, d, "embeddings")
    asked = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(asked)).select(F.col("vec_id").alias("id"), F.round(tx.cosine(F.col("q"), F.col("embedding")), 4).alias("s_cosine"))  # one row


def _signals(s, d):
    b = sg.with_community(_batch(s, d))
    f = supply(s, d).edges.where("kind = 'references'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    b = b.join(f, "id", "left").fillna(0, ["n"]).withColumn("s_fan_in", sg.fan_signal("n"))
    return b.withColumn("s_bm25", 61.0 / (61 + F.col("p_size"))).withColumn("s_source", sg.source(F.col("file")))


_SIGNALS = f"""{_BATCH}, c AS (SELECT query, community, count(*) AS own FROM b GROUP BY 1, 2), f AS (SELECT dst AS id, count(*) AS n FROM edges WHERE kind = 'references' GROUP BY 1),
    x AS (SELECT b.query, b.id, b.community, b.file, p_size, coalesce(n, 0) AS n, own FROM b JOIN c ON c.query = b.query AND c.community = b.community LEFT JOIN f ON f.id = b.id),
    y AS (SELECT *, own / max(own) OVER w AS s_community, CASE WHEN max(n) OVER w > 0 THEN ln(1 + n) / ln(1 + max(n) OVER w) ELSE 0.0 END AS s_fan_in, 61.0 / (61 + p_size) AS s_bm25, 1.0 AS s_source FROM x WINDOW w AS (PARTITION BY query))"""


@query("rerank_pipeline", duck(f"WITH {_SIGNALS} SELECT query, id, CAST(round(s_bm25 + 0.3 * s_fan_in + 0.2 * s_community + 0.2 * s_source, 6) AS DOUBLE) AS score, CAST(round(0.3 * s_fan_in, 6) AS DOUBLE) AS from_fan_in FROM y"))
def _(s, d):
    r = sg.scored(_signals(s, d), sg.weights_for("concept"))
    return r.select("query", "id", F.round("score", 6).alias("score"), F.round(F.col("contributions")["fan_in"], 6).alias("from_fan_in"))


@query("rerank_symbol_class", duck(f"WITH {_SIGNALS} SELECT query, id, CAST(round(1.4 * s_bm25 + 0.3 * s_fan_in + 0.2 * s_community + 0.2 * s_source, 6) AS DOUBLE) AS score FROM y"))
def _(s, d):
    return sg.scored(_signals(s, d), sg.weights_for("symbol")).select("query", "id", F.round("score", 6).alias("score"))


@query("rerank_prose", duck(f"WITH {_SIGNALS} SELECT query, id, CAST(round(1.5 * s_bm25, 6) AS DOUBLE) AS score, CAST(1 AS INTEGER) AS signals FROM y"))
def _(s, d):
    return sg.scored(_signals(s, d), sg.weights_for("concept", prose=True)).select("query", "id", F.round("score", 6).alias("score"), F.size("contributions").alias("signals"))


@query("confidence_summary", duck(f"WITH {_SIGNALS}, r AS (SELECT query, round(s_bm25 + 0.3 * s_fan_in, 6) AS score FROM y), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC) AS k FROM r) SELECT query, CAST(max(score) AS DOUBLE) AS best, CAST(round(max(score) - coalesce(max(score) FILTER (k = 2), 0), 6) AS DOUBLE) AS gap, CAST(round(median(score), 5) AS DOUBLE) AS median FROM k GROUP BY 1"))
def _(s, d):
    r = sg.scored(_signals(s, d), {"bm25": 1.0, "fan_in": 0.3}).select("query", F.round("score", 6).alias("score"))
    return sg.confidence(r).select("query", "best", F.round("gap", 6).alias("gap"), F.round("median", 5).alias("median"))


def _pack_sql(order: str) -> str:
    return f"""
    WITH RECURSIVE c AS (SELECT p_type AS query, concat('p', p_partkey) AS id, p_brand AS file, p_retailprice AS score, p_size AS cost FROM part),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {order}, id) AS k FROM (SELECT *, max(score) OVER (PARTITION BY query, file) AS lead FROM c)),
    w(query, k, spent, taken, id) AS (SELECT DISTINCT query, 0, 0, false, '' FROM c UNION ALL SELECT o.query, w.k + 1, CASE WHEN w.spent + o.cost <= 60 THEN w.spent + o.cost ELSE w.spent END, w.spent + o.cost <= 60, o.id FROM w JOIN o ON o.query = w.query AND o.k = w.k + 1)
    SELECT query, id FROM w WHERE taken"""


def _costed(s, d):
    return table(s, d, "part").select(F.col("p_type").alias("query"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("file"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("cost"))


@query("pack_top", _pack_sql("score DESC"))
def _(s, d):
    return sg.packed(_costed(s, d), 60, "top")


@query("pack_density", _pack_sql("score / cost DESC"))
def _(s, d):
    return sg.packed(_costed(s, d), 60, "density")


@query("pack_by_file", _pack_sql("lead DESC, file, score DESC"))
def _(s, d):
    return sg.packed(_costed(s, d), 60, "file")


_HITS = f"SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id"


def _hits(s, d, k):
    e = table(s, d, "embeddings")
    return rt.knn(e.where("vec_id % 20 = 0"), e, k)


@query("knn_parents", f"WITH h AS (SELECT query_id, vec_id // 4 AS parent, max(score) AS score FROM ({_HITS}) GROUP BY 1, 2) SELECT query_id, parent, score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent) <= 3")
def _(s, d):
    # Four chunks a parent at most: twelve hits hold three parents.
    return sg.parents(_hits(s, d, 12).select("query_id", F.floor(F.col("vec_id") / 4).alias("parent"), "score"), 3)


@query("cosine_refine", f"""
    WITH h AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_HITS}) QUALIFY r <= 10), p AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS position FROM h)
    SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN position <= 5 THEN 0 ELSE 1 END, CASE WHEN position <= 5 THEN -score END, position) AS INTEGER) AS place FROM p""")
def _(s, d):
    from pyspark.sql.window import Window

    shuffled = Window.partitionBy("query_id").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")
    h = _hits(s, d, 10).withColumn("position", F.row_number().over(shuffled))
    return sg.refined(h, "score", "position", "vec_id", 5, "query_id").select("query_id", "vec_id", "place")
