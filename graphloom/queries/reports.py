"""Roll-up reports over the supply graph, the tables behind it, and the texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import token_estimate
from ..operators import filters as fl
from ..operators import traverse as tr
from ..plans.durable import spread
from ..plans.model import rank
from ..plans.registry import query
from ..sinks import text as sinks
from ..sources import scanners
from ..sources.tables import duck, projection, supply, table
from .graph import RANK_SQL


@query("graph_stats", duck("SELECT 'node' AS what, kind, language AS part, count(*) AS n FROM nodes GROUP BY 2, 3 UNION ALL SELECT 'edge', kind, '', count(*) FROM edges GROUP BY 2"))
def _(s, d):
    g = supply(s, d)
    a = g.nodes.groupBy("kind", F.col("language").alias("part")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "part", "n")
    return a.unionByName(g.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", F.lit("").alias("part"), "n"))


@query("fan_in_out", duck("SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM edges WHERE kind IN ('calls', 'references') UNION ALL SELECT src, 0, 1 FROM edges WHERE kind IN ('calls', 'references')) GROUP BY id"))
def _(s, d):
    e = fl.by_kinds(supply(s, d).edges, ["calls", "references"])
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


_UNITS = "WITH u AS (SELECT id, array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') AS unit FROM nodes), x AS (SELECT DISTINCT a.unit AS f, b.unit AS t FROM edges e JOIN u a ON a.id = e.src JOIN u b ON b.id = e.dst WHERE a.unit <> b.unit)"


@query("coupling_package", duck(_UNITS + ", n AS (SELECT unit, count(*) AS members FROM u GROUP BY 1), ce AS (SELECT f AS unit, count(*) AS ce FROM x GROUP BY 1), ca AS (SELECT t AS unit, count(*) AS ca FROM x GROUP BY 1) SELECT unit, members, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0.0 ELSE round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 6) END AS instability FROM n LEFT JOIN ce USING (unit) LEFT JOIN ca USING (unit)"))
def _(s, d):
    g = supply(s, d)
    u = g.nodes.select("id", F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/").alias("unit"))
    half = g.edges.select("src", "dst").join(u.select(F.col("id").alias("src"), F.col("unit").alias("f")), "src").select("f", "dst").distinct()
    pair = half.join(u.select(F.col("id").alias("dst"), F.col("unit").alias("t")), "dst").where("f <> t").select("f", "t").distinct()
    out = u.groupBy("unit").agg(F.count("*").alias("members")).join(pair.groupBy(F.col("f").alias("unit")).agg(F.count("*").alias("ce")), "unit", "left").join(pair.groupBy(F.col("t").alias("unit")).agg(F.count("*").alias("ca")), "unit", "left").fillna(0, ["ca", "ce"])
    both = F.col("ca") + F.col("ce")
    return out.select("unit", "members", "ca", "ce", F.when(both == 0, F.lit(0.0)).otherwise(F.round(F.col("ce") / both, 6)).alias("instability"))


@query("cross_repo_pairs", duck("SELECT a.repo_prefix AS repo_from, b.repo_prefix AS repo_to, e.kind, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.repo_prefix <> b.repo_prefix GROUP BY 1, 2, 3"))
def _(s, d):
    g = supply(s, d)
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("repo_prefix").alias("repo_from")), g.nodes.select(F.col("id").alias("dst"), F.col("repo_prefix").alias("repo_to"))
    return g.edges.select("src", "dst", "kind").join(a, "src").join(b, "dst").where("repo_from <> repo_to").groupBy("repo_from", "repo_to", "kind").agg(F.count("*").alias("n"))


_DEG = "d AS (SELECT n.id, n.end_line - n.start_line + 1 AS lines, coalesce(i.n, 0) AS fi, coalesce(o.n, 0) AS fo FROM nodes n LEFT JOIN (SELECT dst AS id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('calls', 'references')) GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('calls', 'references')) GROUP BY 1) o USING (id))"


def _degrees(g):
    e = fl.by_kinds(g.edges, ["calls", "references"]).select("src", "dst").distinct()
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    both = ends.groupBy("id").agg(F.sum("i").alias("fi"), F.sum("o").alias("fo"))
    return g.nodes.select("id", "kind", "name", "file_path", (F.col("end_line") - F.col("start_line") + 1).alias("lines")).join(both, "id", "left").fillna(0, ["fi", "fo"])


@query("role_classify", duck(f"WITH {_DEG} SELECT id, CASE WHEN fi = 0 AND fo = 0 THEN 'dead' WHEN fi = 0 THEN 'entry' WHEN fo = 0 AND fi < 3 THEN 'leaf' WHEN fi = 1 AND fo = 1 THEN 'adapter' WHEN fi >= 3 AND fo <= 2 AND lines <= 30 THEN 'utility' ELSE 'core' END AS role FROM d"))
def _(s, d):
    fi, fo = F.col("fi"), F.col("fo")
    role = F.when((fi == 0) & (fo == 0), "dead").when(fi == 0, "entry").when((fo == 0) & (fi < 3), "leaf").when((fi == 1) & (fo == 1), "adapter").when((fi >= 3) & (fo <= 2) & (F.col("lines") <= 30), "utility").otherwise("core")
    return _degrees(supply(s, d)).select("id", role.alias("role"))


@query("health_audit", duck(f"WITH {_DEG}, h AS (SELECT id, round(100 / (1 + (2 * fi + 1.5 * fo) / 20), 1) AS score FROM d) SELECT id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM h"))
def _(s, d):
    score = F.round(100 / (1 + (2 * F.col("fi") + 1.5 * F.col("fo")) / 20), 1)
    rows = _degrees(supply(s, d)).select("id", score.cast("double").alias("score"))
    c = F.col("score")
    return rows.withColumn("grade", F.when(c >= 85, "A").when(c >= 70, "B").when(c >= 55, "C").when(c >= 40, "D").otherwise("F"))


@query("extraction_candidates", duck(f"WITH {_DEG} SELECT id, lines, fi, fo FROM d WHERE lines >= 20 AND fi >= 1 AND fo >= 2"))
def _(s, d):
    return _degrees(supply(s, d)).where("lines >= 20 AND fi >= 1 AND fo >= 2").select("id", "lines", "fi", "fo")


@query("hotspots", duck(f"WITH {_DEG}, x AS (SELECT e.dst AS id, count(*) AS crossings FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.repo_prefix <> b.repo_prefix GROUP BY 1) SELECT id, fi + fo + 2 * coalesce(crossings, 0) AS heat FROM d LEFT JOIN x USING (id) WHERE fi + fo + 2 * coalesce(crossings, 0) > 20"))
def _(s, d):
    g = supply(s, d)
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("repo_prefix").alias("ra")), g.nodes.select(F.col("id").alias("dst"), F.col("repo_prefix").alias("rb"))
    x = g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("ra <> rb").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("x"))
    return _degrees(g).join(x, "id", "left").select("id", (F.col("fi") + F.col("fo") + 2 * F.coalesce("x", F.lit(0))).alias("heat")).where("heat > 20")


@query("edge_audit_tiers", duck("""
    SELECT CASE WHEN origin IN ('lsp_resolved', 'lsp_dispatch') THEN 'semantic' WHEN origin IN ('ast_resolved', 'ast_inferred') THEN 'syntactic' ELSE 'textual' END AS tier, count(*) AS edges, count(*) FILTER (kind = 'calls') AS calls FROM edges GROUP BY 1"""))
def _(s, d):
    tier = F.when(F.col("origin").isin("lsp_resolved", "lsp_dispatch"), "semantic").when(F.col("origin").isin("ast_resolved", "ast_inferred"), "syntactic").otherwise("textual")
    return supply(s, d).edges.groupBy(tier.alias("tier")).agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "calls").alias("calls"))


@query("text_only_targets", duck(f"SELECT dst, count(*) AS n FROM edges GROUP BY dst HAVING max({RANK_SQL}) = 2"))
def _(s, d):
    return supply(s, d).edges.groupBy("dst").agg(F.count("*").alias("n"), F.max(rank(F.col("origin"))).alias("best")).where("best = 2").drop("best")


@query("latency_rollup", "SELECT event_type AS tool, count(*) AS n, round(count(*) FILTER (value < 1) / count(*), 4) AS zero_rate, round(avg(value), 4) AS mean, list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").where("value IS NOT NULL")
    # The nearest rank is read off a cumulated histogram of values: no group is gathered into one array.
    hist = e.groupBy(F.col("event_type").alias("tool"), "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tool")
    run = hist.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("value")))
    q = run.groupBy("tool").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    r = e.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("value") < 1) / F.count("*"), 4).alias("zero_rate"), F.round(F.avg("value"), 4).alias("mean"))
    return r.join(q, "tool")


@query("event_emitters", "SELECT event_type AS topic, count(*) AS events, count(DISTINCT user_id) AS emitters, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("emitters"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("transitions", duck("SELECT src, dst, count(*) AS n, count(DISTINCT user_id) AS users FROM journey WHERE dst IS NOT NULL GROUP BY 1, 2"))
def _(s, d):
    return projection(s, d, "journey").where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("channel_ops", duck("SELECT coalesce(a.ch, b.ch) AS channel, coalesce(sends, 0) AS sends, coalesce(recvs, 0) AS recvs FROM (SELECT src AS ch, count(*) AS sends FROM journey GROUP BY 1) a FULL JOIN (SELECT dst AS ch, count(*) AS recvs FROM journey WHERE dst IS NOT NULL GROUP BY 1) b ON a.ch = b.ch"))
def _(s, d):
    j = projection(s, d, "journey")
    both = j.select(F.col("src").alias("channel"), F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(j.where("dst IS NOT NULL").select(F.col("dst").alias("channel"), F.lit(0).alias("s"), F.lit(1).alias("r")))
    return both.groupBy("channel").agg(F.sum("s").alias("sends"), F.sum("r").alias("recvs"))


@query("ownership_span", "SELECT o_custkey AS author, count(DISTINCT o_orderkey) AS symbols, count(DISTINCT o_orderpriority) AS files, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count_distinct("o_orderkey").alias("symbols"), F.count_distinct("o_orderpriority").alias("files"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))
    return o.where("symbols >= 2")


@query("stale_entities", "SELECT c_custkey, max(o_orderdate) AS last_seen, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1999-01-01') AS days FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1999-01-01') > 365")
def _(s, d):
    last = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    c = table(s, d, "customer").select("c_custkey").join(last, "c_custkey")
    return c.withColumn("days", F.datediff(F.lit("1999-01-01").cast("date"), "last_seen").cast("long")).where("days > 365")


@query("stale_flags", "SELECT p.p_brand AS flag, count(l.l_orderkey) AS callers, max(l.l_shipdate) AS newest, max(l.l_shipdate) IS NULL OR max(l.l_shipdate) < TIMESTAMP '1998-11-01' AS stale FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY 1")
def _(s, d):
    calls = table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey")
    out = table(s, d, "part").select("p_partkey", "p_brand").join(calls, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy(F.col("p_brand").alias("flag")).agg(F.count("l_orderkey").alias("callers"), F.max("l_shipdate").alias("newest"))
    return out.withColumn("stale", F.col("newest").isNull() | (F.col("newest") < F.lit("1998-11-01").cast("timestamp")))


@query("coverage_gaps", "SELECT o_orderkey, count(l_linenumber) AS stmts, CASE WHEN count(l_linenumber) = 0 THEN -1.0 ELSE CAST(round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(l_linenumber), 2) AS DOUBLE) END AS pct FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_linenumber) = 0 OR 100.0 * count(*) FILTER (l_linestatus = 'F') / count(l_linenumber) < 100")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus")
    per = table(s, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("stmts"), F.count_if(F.col("l_linestatus") == "F").alias("hit"))
    pct = F.when(F.col("stmts") == 0, F.lit(-1.0)).otherwise(F.round(100.0 * F.col("hit") / F.col("stmts"), 2))
    return per.withColumn("pct", pct).where((F.col("stmts") == 0) | (F.col("hit") < F.col("stmts"))).select("o_orderkey", "stmts", "pct")


@query("orphan_tables", """
    SELECT o_orderkey AS tbl, 'unreferenced' AS status, CAST(0 AS BIGINT) AS queries FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT l_orderkey, 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def _(s, d):
    li, o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("tbl")), table(s, d, "orders").select(F.col("o_orderkey").alias("tbl"), "o_orderstatus")
    uses = li.select("tbl", F.lit(1).cast("long").alias("queries"), F.lit(0).cast("long").alias("here"), F.lit(False).alias("known"))
    ends = uses.unionByName(o.select("tbl", F.lit(0).cast("long").alias("queries"), F.lit(1).cast("long").alias("here"), F.coalesce(F.col("o_orderstatus") != "P", F.lit(False)).alias("known"))).where("tbl IS NOT NULL")
    per = spread(ends, "tbl").groupBy("tbl").agg(F.sum("queries").alias("queries"), F.sum("here").alias("here"), F.max("known").alias("known")).where("queries = 0 OR NOT known")
    status = F.when(F.col("queries") == 0, "unreferenced").otherwise("orphan").alias("status")
    return per.select("tbl", status, "queries", F.explode(F.array_repeat(F.lit(0), F.when(F.col("queries") == 0, F.col("here")).otherwise(1).cast("int")))).drop("col")


@query("untested_symbols", duck("WITH RECURSIVE tested(node) AS (SELECT id FROM nodes WHERE kind = 'function' UNION SELECT dst FROM tested JOIN edges ON src = node AND kind IN ('calls', 'references')) SELECT n.id, count(e.src) AS fan_in FROM nodes n LEFT JOIN edges e ON e.dst = n.id WHERE n.id NOT IN (SELECT node FROM tested) GROUP BY 1"))
def _(s, d):
    g = supply(s, d)
    seen = tr.reachable(g.edges, g.nodes.where("kind = 'function'").select("id"), "out", ["calls", "references"])
    left = g.nodes.select("id").join(seen.withColumnRenamed("node", "id"), "id", "left_anti")
    return left.join(g.edges.select(F.col("dst").alias("id"), "src"), "id", "left").groupBy("id").agg(F.count("src").alias("fan_in"))


@query("fixes_history", "SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS fixes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY fixes DESC, file LIMIT 20")
def _(s, d):
    return table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("file")).agg(F.count_distinct("l_orderkey").alias("fixes")).orderBy(F.desc("fixes"), "file").limit(20)


@query("missing_fields", "WITH want AS (SELECT DISTINCT o_orderpriority AS field FROM orders), per AS (SELECT DISTINCT o_custkey, o_orderpriority AS field FROM orders) SELECT c.o_custkey AS ctor, string_agg(w.field, ',' ORDER BY w.field) AS missing FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN want w LEFT JOIN per p ON p.o_custkey = c.o_custkey AND p.field = w.field WHERE p.field IS NULL GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders")
    want = o.groupBy().agg(F.collect_set("o_orderpriority").alias("want"))  # the fields of one class: few
    mine = o.groupBy(F.col("o_custkey").alias("ctor")).agg(F.collect_set("o_orderpriority").alias("have"))
    missing = F.array_sort(F.array_except("want", "have"))
    return mine.join(F.broadcast(want)).select("ctor", F.array_join(missing, ",").alias("missing"), F.size(missing).alias("k")).where("k > 0").drop("k")


@query("dead_code", duck("SELECT n.id, n.kind FROM nodes n WHERE n.kind IN ('function', 'method', 'type') AND n.id NOT IN (SELECT dst FROM edges WHERE kind IN ('calls', 'references')) AND NOT regexp_matches(n.name, '^(main|Handle)')"))
def _(s, d):
    g = supply(s, d)
    used = fl.by_kinds(g.edges, ["calls", "references"]).select(F.col("dst").alias("id"))
    return g.nodes.where(F.col("kind").isin("function", "method", "type") & ~F.col("name").rlike("^(main|Handle)")).join(used, "id", "left_anti").select("id", "kind")


@query("connectivity_health", duck("""
    WITH deg AS (SELECT n.id, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i FROM nodes n LEFT JOIN (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1) o USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1) i USING (id))
    SELECT count(*) AS nominal, count(*) FILTER (o + i > 0) AS effective, round(count(*) FILTER (o + i > 0) / count(*), 4) AS ratio, count(*) FILTER (o + i = 0) AS isolated, count(*) FILTER (o + i = 1) AS leaf, count(*) FILTER (o > 0 AND i = 0) AS source_only, count(*) FILTER (o = 0 AND i > 0) AS sink_only FROM deg"""))
def _(s, d):
    g = supply(s, d)
    o, i = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    deg = g.nodes.select("id").join(o, "id", "left").join(i, "id", "left").fillna(0, ["o", "i"])
    n = lambda p: F.count_if(F.expr(p))
    return deg.agg(F.count("*").alias("nominal"), n("o + i > 0").alias("effective"), F.round(n("o + i > 0") / F.count("*"), 4).alias("ratio"), n("o + i = 0").alias("isolated"), n("o + i = 1").alias("leaf"), n("o > 0 AND i = 0").alias("source_only"), n("o = 0 AND i > 0").alias("sink_only"))


@query("architecture_rules", duck("SELECT e.src, e.dst, e.kind FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE (a.repo_prefix, b.repo_prefix) NOT IN (('shop', 'shop'), ('shop', 'supply'), ('supply', 'supply'), ('geo', 'geo'))"))
def _(s, d):
    g = supply(s, d)
    allowed = s.createDataFrame([("shop", "shop"), ("shop", "supply"), ("supply", "supply"), ("geo", "geo")], "la string, lb string")
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("repo_prefix").alias("la")), g.nodes.select(F.col("id").alias("dst"), F.col("repo_prefix").alias("lb"))
    return g.edges.select("src", "dst", "kind").join(a, "src").join(b, "dst").join(F.broadcast(allowed), ["la", "lb"], "left_anti").select("src", "dst", "kind")


@query("max_fan_out_rule", duck("SELECT src, count(DISTINCT dst) AS fan_out FROM edges WHERE kind = 'references' GROUP BY 1 HAVING count(DISTINCT dst) > 5"))
def _(s, d):
    return supply(s, d).edges.where("kind = 'references'").groupBy("src").agg(F.count_distinct("dst").alias("fan_out")).where("fan_out > 5")


@query("co_change_pairs", "SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS together FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = li.count()
    li = spread(li, "l_orderkey", rows=rows).distinct()
    a, b = li.withColumnRenamed("l_partkey", "a"), li.withColumnRenamed("l_partkey", "b")
    pairs = a.join(b, "l_orderkey").where("a < b").select("a", "b")
    return spread(pairs, "a", "b", rows=3 * rows).groupBy("a", "b").agg(F.count("*").alias("together")).where("together >= 2")


@query("return_usage", "SELECT l_partkey AS fn, count(*) AS sites, count(*) FILTER (l_returnflag = 'R') AS discarded, count(*) FILTER (l_returnflag = 'A') AS assigned, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS unclassified FROM lineitem GROUP BY 1")
def _(s, d):
    r = F.col("l_returnflag")
    return table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("fn")).agg(F.count("*").alias("sites"), F.count_if(r == "R").alias("discarded"), F.count_if(r == "A").alias("assigned"), F.count_if(~r.isin("R", "A")).alias("unclassified"))


@query("language_coverage", duck("SELECT language, count(*) AS symbols, count(*) FILTER (id IN (SELECT dst FROM edges)) AS covered FROM nodes GROUP BY 1"))
def _(s, d):
    g = supply(s, d)
    hit = g.edges.select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(True))
    return g.nodes.select("id", "language").join(hit, "id", "left").groupBy("language").agg(F.count("*").alias("symbols"), F.count("hit").alias("covered"))


@query("bottleneck_depth", duck("SELECT e.src AS id, max(CAST(substring(o.dst, 2) AS BIGINT) % 4 + 1) AS worst FROM edges e JOIN edges o ON o.src = e.dst AND o.kind = 'references' WHERE e.kind = 'calls' GROUP BY 1"))
def _(s, d):
    e = supply(s, d).edges
    o = e.where("kind = 'references'").groupBy(F.col("src").alias("dst")).agg(F.max(F.substring("dst", 2, 20).cast("long") % 4 + 1).alias("deep"))
    return e.where("kind = 'calls'").select("src", "dst").join(o, "dst").groupBy(F.col("src").alias("id")).agg(F.max("deep").alias("worst"))


@query("frecency_boosted_recency", "SELECT event_type, round(avg(exp(-ln(2.0) / 30 * (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400)), 6) AS recency FROM events GROUP BY 1")
def _(s, d):
    from ..operators.retrieval import recency

    days = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) * F.lit(1.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg(recency(days)), 6).alias("recency"))


@query("href_edges", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def _(s, d):
    return scanners.hrefs(table(s, d, "pages"))


@query("route_normalise", r"SELECT page_id, 'GET' AS method, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/[0-9]+(\.html)?(/|$)', '/{id}\2', 'g') AS route FROM pages")
def _(s, d):
    return scanners.routes(table(s, d, "pages"))


_MARKED = "concat(text, CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), '// TODO(ann): mend', chr(10), 'FIXME: later') ELSE '' END)"


@query("todo_scan", f"SELECT doc_id, count(*) AS todos FROM (SELECT doc_id, unnest(regexp_extract_all({_MARKED}, '(?:TODO|FIXME|HACK)[(:]')) FROM documents) GROUP BY 1")
def _(s, d):
    marked = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_MARKED).alias("text"))
    return scanners.todos(marked).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("todos"))


@query("license_scan", "SELECT doc_id, regexp_extract(text, 'licensed under (?:the )?([A-Z][A-Za-z0-9 .-]*)', 1, 'i') AS license FROM documents WHERE regexp_matches(text, 'licensed under (?:the )?[A-Z]', 'i')")
def _(s, d):
    return scanners.license_lines(table(s, d, "documents"))


@query("binary_sniff", "SELECT doc_id, contains(left(text, 8000), chr(0)) AS is_binary FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", scanners.is_binary(F.col("text")).alias("is_binary"))


@query("fixture_paths", "SELECT page_id FROM pages WHERE regexp_matches(concat(url, CASE WHEN page_id % 3 = 0 THEN '/testdata/x' ELSE '/contestdata/x' END), '(^|/)(testdata|fixtures?|__fixtures__|golden)(/|$)')")
def _(s, d):
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/testdata/x").otherwise("/contestdata/x"))
    return table(s, d, "pages").where(path.rlike(fl.FIXTURE_PATH)).select("page_id")


@query("content_hash_changes", "SELECT a.doc_id FROM documents a WHERE md5(a.text) <> md5(a.text || CASE WHEN a.n_chars > 3000 THEN '!' ELSE '' END)")
def _(s, d):
    docs = table(s, d, "documents")
    before = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    after = docs.select("doc_id", F.sha2(F.concat("text", F.when(F.col("n_chars") > 3000, "!").otherwise("")), 256).alias("h"))
    return after.join(before, ["doc_id", "h"], "left_anti").select("doc_id")


@query("export_cypher", duck("SELECT 'CREATE (:' || kind || ' {id: ''' || id || ''', name: ''' || replace(replace(name, '\\', '\\\\'), '''', '\\''') || '''})' AS line FROM nodes UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) CREATE (a)-[:' || kind || ']->(b)' FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)"))
def _(s, d):
    return sinks.cypher(supply(s, d))


@query("export_graphml", duck("SELECT '<node id=\"' || id || '\"><data key=\"name\">' || replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</data></node>' AS line FROM nodes UNION ALL SELECT '<edge source=\"' || src || '\" target=\"' || dst || '\"><data key=\"kind\">' || kind || '</data></edge>' FROM edges"))
def _(s, d):
    return sinks.graphml(supply(s, d))


@query("export_mermaid", duck("SELECT '  ' || replace(a.repo_prefix, '-', '_') || ' -->|' || count(*) || '| ' || replace(b.repo_prefix, '-', '_') AS line FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY a.repo_prefix, b.repo_prefix"))
def _(s, d):
    return sinks.mermaid(supply(s, d), "architecture")


@query("cursor_page", duck("WITH r AS (SELECT dst AS id, count(*) AS score FROM edges GROUP BY 1) SELECT id, score FROM r WHERE score < 30 OR (score = 30 AND id > 'p5') ORDER BY score DESC, id LIMIT 25"))
def _(s, d):
    r = supply(s, d).edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("score"))
    return sinks.page_after(r, 30, "p5", 25)


@query("upsert_rows", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(s, d):
    base = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return sinks.upsert(base, base.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("scoped_delete", duck("SELECT src, dst, kind FROM edges WHERE NOT (kind = 'references' AND file_path = 'src/orders/lines.go')"))
def _(s, d):
    return supply(s, d).edges.where("NOT (kind = 'references' AND file_path = 'src/orders/lines.go')").select("src", "dst", "kind")


@query("token_budget_rows", "WITH t AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents), r AS (SELECT doc_id, tokens, CAST(sum(tokens) OVER (ORDER BY tokens, doc_id) AS BIGINT) AS spent FROM t) SELECT doc_id, tokens, spent FROM r WHERE spent <= 5000")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens")).orderBy("tokens", "doc_id").limit(5000)  # the budget admits no more rows
    return t.withColumn("spent", F.sum("tokens").over(Window.orderBy("tokens", "doc_id"))).where("spent <= 5000")


@query("repo_outline", duck("SELECT language, kind, count(*) AS symbols, count(DISTINCT file_path) AS files FROM nodes GROUP BY 1, 2"))
def _(s, d):
    return supply(s, d).nodes.groupBy("language", "kind").agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"))


@query("architecture_rollup", duck("SELECT a.repo_prefix AS f, b.repo_prefix AS t, e.kind, count(*) AS n, count(DISTINCT e.src) AS sources FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1, 2, 3"))
def _(s, d):
    g = supply(s, d)
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("repo_prefix").alias("f")), g.nodes.select(F.col("id").alias("dst"), F.col("repo_prefix").alias("t"))
    # A row for each source, kind and target part: its sources need not be told apart once more.
    per = g.edges.select("src", "dst", "kind").join(b, "dst").groupBy("src", "kind", "t").agg(F.count("*").alias("n"))
    own = a.groupBy("src", "f").agg(F.count("*").alias("copies"))
    return per.join(own, "src").groupBy("f", "t", "kind").agg(F.sum(F.col("n") * F.col("copies")).alias("n"), F.count("*").alias("sources"))


@query("symbol_history", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id", "ts")


@query("pack_delta", "SELECT coalesce(a.p, b.p) AS part, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R') a FULL JOIN (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'A') b ON a.p = b.p")
def _(s, d):
    li = table(s, d, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")).distinct().withColumn("was", F.lit(True))
    b = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("part")).distinct().withColumn("now", F.lit(True))
    return a.join(b, "part", "full").select("part", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("kept").alias("change"))


@query("verify_citation", "SELECT d.doc_id, b.item_id, len(string_split(d.text, b.text)) - 1 AS hits FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(s, d):
    return scanners.citations(table(s, d, "documents"), table(s, d, "benchmark"))


@query("unclosed_channels", "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events) SELECT user_id, day FROM e GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'view') = 0")
def _(s, d):
    per = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("opened"), F.count_if(F.col("event_type") == "view").alias("closed"))
    return per.where("opened > 0 AND closed = 0").select("user_id", "day")


@query("risk_levels", "SELECT o_orderpriority, CASE WHEN n >= 10 OR m >= 10 THEN 'CRITICAL' WHEN n >= 5 OR m >= 5 THEN 'HIGH' WHEN n >= 2 OR m >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS orders FROM (SELECT o_orderkey, o_orderpriority, count(DISTINCT l_suppkey) AS n, count(l_linenumber) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1, 2")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber")
    per = table(s, d, "orders").select("o_orderkey", "o_orderpriority").join(spread(li, "o_orderkey"), "o_orderkey", "left").groupBy("o_orderkey", "o_orderpriority").agg(F.count_distinct("l_suppkey").alias("n"), F.count("l_linenumber").alias("m"))
    return per.groupBy("o_orderpriority", risk(F.col("n"), F.col("m")).alias("risk")).agg(F.count("*").alias("orders"))


def risk(direct, total):
    """Cut-offs that fit all known points: (0,0) and (1,1) LOW, (2,3) MEDIUM, (5,5) HIGH, (10,10) CRITICAL."""
    return F.when((direct >= 10) | (total >= 10), "CRITICAL").when((direct >= 5) | (total >= 5), "HIGH").when((direct >= 2) | (total >= 3), "MEDIUM").otherwise("LOW")
