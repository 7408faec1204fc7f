"""Scans, filters, joins and traversals of the supply graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import filters as fl
from ..operators import traverse as tr
from ..plans import dsl
from ..plans.durable import durable, small, spread
from ..plans.model import DEPENDENCY_KINDS, rank
from ..plans.registry import query
from ..sources.tables import duck, projection, supply, table

RANK_SQL = "CASE origin WHEN 'lsp_resolved' THEN 6 WHEN 'lsp_dispatch' THEN 5 WHEN 'ast_resolved' THEN 4 WHEN 'ast_inferred' THEN 3 WHEN 'text_matched' THEN 2 WHEN 'speculative' THEN 1 ELSE 0 END"


@query("scan_nodes_light", duck("SELECT id, kind, name, repo_prefix FROM nodes"))
def _(s, d):
    return supply(s, d).nodes.select("id", "kind", "name", "repo_prefix")


@query("scan_edges_by_kind", duck("SELECT src, dst, kind, line FROM edges WHERE kind IN ('calls', 'depends_on')"))
def _(s, d):
    return fl.by_kinds(supply(s, d).edges, ["calls", "depends_on", "calls"]).select("src", "dst", "kind", "line")


@query("scan_nodes_by_kind", duck("SELECT * FROM nodes WHERE kind IN ('type', 'interface')"))
def _(s, d):
    return supply(s, d).nodes.where(F.col("kind").isin("type", "interface"))


@query("scan_id_name", duck("SELECT id, name FROM nodes WHERE repo_prefix = 'supply' AND kind IN ('type', 'interface')"))
def _(s, d):
    n = supply(s, d).nodes
    return n.where(fl.in_scope(F.col("repo_prefix"), ["supply"]) & F.col("kind").isin("type", "interface")).select("id", "name")


@query("lookup_batch", duck("SELECT id, name FROM nodes WHERE id IN ('c1', 'o1', 'p7', 'absent')"))
def _(s, d):
    return fl.lookup_ids(supply(s, d).nodes, ["c1", "o1", "p7", "p7", "absent"]).select("id", "name")


@query("page_after_key", duck("SELECT id, name FROM nodes WHERE id > 'c2' AND id <= 'o9' ORDER BY id LIMIT 50"))
def _(s, d):
    return fl.after_key(supply(s, d).nodes, "id", "c2", "o9", 50).select("id", "name")


@query("capability_scan", duck("SELECT e.src, e.dst, e.kind, n.repo_prefix, t.kind AS target_kind FROM edges e JOIN nodes n ON n.id = e.src LEFT JOIN nodes t ON t.id = e.dst WHERE n.repo_prefix IN ('shop', 'geo') AND e.kind IN ('calls', 'member_of')"))
def _(s, d):
    g = supply(s, d)
    src = g.nodes.where(F.col("repo_prefix").isin("shop", "geo")).select(F.col("id").alias("src"), "repo_prefix")
    dst = g.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("target_kind"))
    return fl.by_kinds(g.edges, ["calls", "member_of"]).join(src, "src").join(dst, "dst", "left").select("src", "dst", "kind", "repo_prefix", "target_kind")


@query("name_contains", duck("SELECT id, name FROM nodes WHERE contains(lower(name), 'r_12')"))
def _(s, d):
    return fl.name_contains(supply(s, d).nodes, "r_12").select("id", "name")


@query("name_folded", duck("SELECT id, name FROM nodes WHERE lower(name) = lower('ORDER_77')"))
def _(s, d):
    return fl.folded_name(supply(s, d).nodes, "ORDER_77").select("id", "name")


@query("file_subgraph", duck("SELECT n.id, count(e.src) AS degree FROM nodes n LEFT JOIN (SELECT src AS id, src FROM edges UNION ALL SELECT dst, src FROM edges WHERE src <> dst) e USING (id) WHERE n.file_path = 'src/geo/nation.ts' GROUP BY n.id"))
def _(s, d):
    g = supply(s, d)
    mine = g.nodes.where(F.col("file_path") == "src/geo/nation.ts").select("id")
    ends = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("e")).unionByName(g.edges.where("src <> dst").select(F.col("dst").alias("id"), F.lit(1).alias("e")))
    return mine.join(ends, "id", "left").groupBy("id").agg(F.count("e").alias("degree"))


@query("file_editing_context", duck("""
    WITH own AS (SELECT id FROM nodes WHERE file_path = 'src/geo/nation.ts')
    SELECT 'caller' AS role, e.src AS id, count(*) AS n FROM edges e WHERE e.dst IN (SELECT id FROM own) AND e.src NOT IN (SELECT id FROM own) GROUP BY 2
    UNION ALL SELECT 'callee', e.dst, count(*) FROM edges e WHERE e.src IN (SELECT id FROM own) AND e.dst NOT IN (SELECT id FROM own) GROUP BY 2
    UNION ALL SELECT 'defines', id, 1 FROM own"""))
def _(s, d):
    g = supply(s, d)
    own = durable(g.nodes.where(F.col("file_path") == "src/geo/nation.ts").select("id"), "own")
    own = small(own, own.count())
    a, b = own.withColumnRenamed("id", "src"), own.withColumnRenamed("id", "dst")
    callers = g.edges.join(b, "dst", "left_semi").join(a, "src", "left_anti").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).select(F.lit("caller").alias("role"), "id", "n")
    callees = g.edges.join(a, "src", "left_semi").join(b, "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).select(F.lit("callee").alias("role"), "id", "n")
    return callers.unionByName(callees).unionByName(own.select(F.lit("defines").alias("role"), "id", F.lit(1).cast("long").alias("n")))


@query("import_adjacency", duck("SELECT a.file_path AS file, string_agg(DISTINCT b.file_path, ',' ORDER BY b.file_path) AS imports FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.file_path <> b.file_path GROUP BY 1"))
def _(s, d):
    g = supply(s, d)
    a, b = (g.nodes.select(F.col("id").alias(x), F.col("file_path").alias(f"f_{x}")) for x in ("src", "dst"))
    pairs = g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("f_src <> f_dst").select("f_src", "f_dst").distinct()
    return pairs.groupBy(F.col("f_src").alias("file")).agg(F.array_join(F.sort_array(F.collect_set("f_dst")), ",").alias("imports"))


@query("edge_identity_lookup", duck("WITH k AS MATERIALIZED (SELECT DISTINCT src, dst, kind, file_path, line FROM edges WHERE kind = 'member_of') SELECT e.src, e.dst, e.kind, e.file_path, e.line, e.origin FROM edges e JOIN k USING (src, dst, kind, file_path, line)"))
def _(s, d):
    e = supply(s, d).edges
    key = ["src", "dst", "kind", "file_path", "line"]
    return e.join(e.where("kind = 'member_of'").select(*key).distinct(), key).select(*key, "origin")


@query("incoming_sources", duck("SELECT src, file_path, min(line) AS first_line, count(*) AS n FROM edges WHERE kind = 'references' GROUP BY 1, 2"))
def _(s, d):
    return supply(s, d).edges.where("kind = 'references'").groupBy("src", "file_path").agg(F.min("line").alias("first_line"), F.count("*").alias("n"))


@query("override_dispatch", duck("SELECT c.src, o.src AS override, count(*) AS n FROM edges c JOIN edges o ON c.kind = 'references' AND o.kind = 'depends_on' AND c.dst = o.src GROUP BY 1, 2"))
def _(s, d):
    e = supply(s, d).edges
    # Both ends counted first: a pair meets once, however many edges it has.
    c = e.where("kind = 'references'").select("src", F.col("dst").alias("override"))
    c = spread(c, "override").groupBy("src", "override").agg(F.count("*").alias("calls"))
    o = e.where("kind = 'depends_on'").groupBy(F.col("src").alias("override")).agg(F.count("*").alias("overs"))
    return c.join(o, "override").select("src", "override", (F.col("calls") * F.col("overs")).alias("n"))


@query("field_filter", duck("SELECT id, name FROM nodes WHERE language = 'rust' AND kind IN ('type', 'interface') AND starts_with(file_path, 'src/part/') AND contains(lower(name), 'ring')"))
def _(s, d):
    found, rest = fl.parse_fields("lang:rs kind:type,interface path:src/part/ Ring")
    return fl.name_contains(supply(s, d).nodes.where(fl.field_filter(found)), rest).select("id", "name")


@query("field_relaxed", duck("SELECT id, name, true AS filters_relaxed FROM nodes WHERE contains(lower(name), 'supplier')"))
def _(s, d):
    rows, relaxed = fl.search_fields(supply(s, d).nodes, "lang:cobol supplier")
    return rows.select("id", "name", F.lit(relaxed).alias("filters_relaxed"))


@query("scope_filter", duck("SELECT id FROM nodes WHERE repo_prefix IN ('geo')"))
def _(s, d):
    n = supply(s, d).nodes
    return n.where(fl.in_scope(F.col("repo_prefix"), ["geo"])).select("id").unionByName(n.where(fl.in_scope(F.col("repo_prefix"), [])).select("id"))


@query("path_glob", duck("SELECT id FROM nodes WHERE regexp_matches(file_path, '^src/[^/]*/[^/]*\\.ts$') OR regexp_matches(file_path, '^src/(?:.*/)?f\\.go$')"))
def _(s, d):
    n = supply(s, d).nodes
    return n.where(F.col("file_path").rlike(fl.glob("src/*/*.ts")) | F.col("file_path").rlike(fl.glob("src/**/f.go"))).select("id")


@query("min_tier_filter", duck(f"SELECT src, dst, kind, line, origin FROM edges WHERE {RANK_SQL} >= 4"))
def _(s, d):
    return fl.min_tier(supply(s, d).edges, "ast_resolved").select("src", "dst", "kind", "line", "origin")


@query("min_tier_caveat", duck(f"SELECT count(*) FILTER (r >= 6) AS kept, count(*) FILTER (r < 6) AS below, max(r) FILTER (r < 6) AS best_below FROM (SELECT {RANK_SQL} AS r FROM edges)"))
def _(s, d):
    return fl.tier_caveat(supply(s, d).edges, "lsp_resolved")


@query("suppress_text", duck(f"WITH b AS (SELECT *, max({RANK_SQL}) OVER (PARTITION BY dst) AS best FROM edges) SELECT src, dst, kind, line, origin FROM b WHERE NOT (origin = 'text_matched' AND best > 2)"))
def _(s, d):
    return fl.suppress_text(supply(s, d).edges).select("src", "dst", "kind", "line", "origin")


@query("exclude_targets_in_files", duck("SELECT e.src, e.dst, e.kind FROM edges e WHERE e.dst NOT IN (SELECT id FROM nodes WHERE regexp_matches(file_path, 'orders/f\\.go$'))"))
def _(s, d):
    g = supply(s, d)
    out = g.nodes.where(F.col("file_path").rlike(r"orders/f\.go$")).select(F.col("id").alias("dst"))
    return g.edges.join(out, "dst", "left_anti").select("src", "dst", "kind")


@query("unresolved_histogram", duck("""
    SELECT kind, class, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM (
        SELECT e.kind, CASE WHEN n.id IS NULL THEN 'dangling' WHEN n.repo_prefix = 'geo' THEN 'external' ELSE 'local' END AS class FROM edges e LEFT JOIN nodes n ON n.id = e.dst) GROUP BY 1, 2"""))
def _(s, d):
    g = supply(s, d)
    t = g.nodes.select(F.col("id").alias("dst"), "repo_prefix")
    cls = F.when(F.col("repo_prefix").isNull(), "dangling").when(F.col("repo_prefix") == "geo", "external").otherwise("local")
    per = g.edges.select("dst", "kind").join(t, "dst", "left").groupBy("kind", cls.alias("class")).agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy()))


@query("owner_of_target", duck("SELECT e.src, e.dst, coalesce(n.repo_prefix, '') AS owner FROM edges e LEFT JOIN nodes n ON n.id = e.dst WHERE e.kind = 'depends_on'"))
def _(s, d):
    g = supply(s, d)
    return g.edges.where("kind = 'depends_on'").join(g.nodes.select(F.col("id").alias("dst"), "repo_prefix"), "dst", "left").select("src", "dst", F.coalesce("repo_prefix", F.lit("")).alias("owner"))


@query("unmatched_orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("customers_with_orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("contract_match", """
    SELECT coalesce(p.id, c.id) AS contract, coalesce(p.ws, c.ws) AS workspace, coalesce(p.n, 0) AS providers, coalesce(c.n, 0) AS consumers,
           CASE WHEN p.n IS NULL THEN 'orphan_consumer' WHEN c.n IS NULL THEN 'orphan_provider' ELSE 'matched' END AS status
    FROM (SELECT p_brand AS id, p_size % 3 AS ws, count(*) AS n FROM part GROUP BY 1, 2) p
    FULL JOIN (SELECT p_brand AS id, CAST(l_suppkey % 3 AS INTEGER) AS ws, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) c ON p.id = c.id AND p.ws = c.ws""")
def _(s, d):
    part = table(s, d, "part")
    p = part.groupBy(F.col("p_brand").alias("contract"), (F.col("p_size") % 3).alias("workspace")).agg(F.count("*").alias("providers"))
    c = table(s, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("contract"), (F.col("l_suppkey") % 3).cast("int").alias("workspace")).agg(F.count("*").alias("consumers"))
    status = F.when(F.col("providers").isNull(), "orphan_consumer").when(F.col("consumers").isNull(), "orphan_provider").otherwise("matched")
    return p.join(c, ["contract", "workspace"], "full").select("contract", "workspace", F.coalesce("providers", F.lit(0)).alias("providers"), F.coalesce("consumers", F.lit(0)).alias("consumers"), status.alias("status"))


@query("unique_candidate_bind", "SELECT p_brand, p_name, p_size, CAST(min(p_partkey) AS BIGINT) AS bound FROM part GROUP BY 1, 2, 3 HAVING count(*) = 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_brand", "p_name", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("bound")).where("n = 1").drop("n")


@query("enclosing_range", """
    WITH spans AS (SELECT o_custkey AS owner, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1)
    SELECT o.o_orderkey, s.owner, date_diff('day', CAST(s.lo AS DATE), CAST(o.o_orderdate AS DATE)) AS into_span FROM orders o JOIN spans s ON o.o_custkey = s.owner AND o.o_orderdate BETWEEN s.lo AND s.hi""")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "owner")
    spans = o.groupBy("owner").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return o.join(spans, "owner").where(F.col("o_orderdate").between(F.col("lo"), F.col("hi"))).select("o_orderkey", "owner", F.datediff("o_orderdate", "lo").cast("long").alias("into_span"))


@query("innermost_enclosing", duck("""
    WITH hits AS (SELECT a.id AS line_id, b.id AS symbol, b.end_line - b.start_line AS span FROM nodes a JOIN nodes b ON a.file_path = b.file_path AND a.start_line BETWEEN b.start_line AND b.end_line AND a.kind = 'type')
    SELECT line_id, symbol FROM hits QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY span, symbol) = 1"""))
def _(s, d):
    n = supply(s, d).nodes
    lines = n.where("kind = 'type'").select(F.col("id").alias("line_id"), "file_path", F.col("start_line").alias("at"))
    symbols = n.select(F.col("id").alias("symbol"), "file_path", "start_line", "end_line")
    # Ranges of at most 64 lines meet on blocks of 64, not on whole files.
    a = lines.withColumn("block", (F.col("at") / 64).cast("long"))
    b = symbols.withColumn("block", F.explode(F.sequence((F.col("start_line") / 64).cast("long"), (F.col("end_line") / 64).cast("long"))))
    hit = a.join(b, ["file_path", "block"]).where("at BETWEEN start_line AND end_line")
    return hit.groupBy("line_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "symbol"))["symbol"].alias("symbol"))


@query("motivates_ranked", duck("SELECT dst AS target, src AS reason, kind, row_number() OVER (PARTITION BY dst ORDER BY CASE kind WHEN 'depends_on' THEN 0 ELSE 1 END, src) AS place FROM (SELECT DISTINCT src, dst, kind FROM edges WHERE kind IN ('depends_on', 'member_of'))"))
def _(s, d):
    e = fl.by_kinds(supply(s, d).edges, ["depends_on", "member_of"]).select("src", "dst", "kind").distinct()
    order = Window.partitionBy("dst").orderBy(F.when(F.col("kind") == "depends_on", 0).otherwise(1), "src")
    return e.select(F.col("dst").alias("target"), F.col("src").alias("reason"), "kind", F.row_number().over(order).cast("long").alias("place"))


def _bfs_sql(edges: str, seed: str, depth: int, here: str, there: str, kinds: str) -> str:
    return duck(f"""
    WITH RECURSIVE step AS (SELECT DISTINCT {here} AS here, {there} AS there, kind FROM {edges} WHERE kind IN ({kinds})),
    walk(node, depth) AS (SELECT '{seed}', 0 UNION SELECT there, depth + 1 FROM walk JOIN step ON node = here WHERE depth < {depth}),
    best AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
    SELECT b.node, CAST(b.depth AS INTEGER) AS depth, w.parent, w.kind AS edge_kind FROM best b LEFT JOIN (
        SELECT t.node, p.node AS parent, s.kind FROM best t JOIN step s ON s.there = t.node JOIN best p ON p.node = s.here AND p.depth = t.depth - 1
        QUALIFY row_number() OVER (PARTITION BY t.node ORDER BY p.node, s.kind) = 1) w ON w.node = b.node""")


@query("bfs_depth3_out", _bfs_sql("edges", "c1", 3, "src", "dst", "'calls', 'references', 'depends_on'"))
def _(s, d):
    return tr.bfs(supply(s, d).edges, s.createDataFrame([("c1",)], "id string"), "out", ["calls", "references", "depends_on"], 3)


@query("bfs_depth3_in", _bfs_sql("edges", "s1", 3, "dst", "src", "'calls', 'references', 'depends_on'"))
def _(s, d):
    return tr.bfs(supply(s, d).edges, s.createDataFrame([("s1",)], "id string"), "in", ["calls", "references", "depends_on"], 3)


@query("bfs_cyclic_depth2", _bfs_sql("basket", "p1", 2, "src", "dst", "'calls'"))
def _(s, d):
    return tr.bfs(projection(s, d, "basket"), s.createDataFrame([("p1",)], "id string"), "out", ["calls"], 2)


@query("reachable_forward", duck("WITH RECURSIVE walk(node) AS (SELECT 'c1' UNION SELECT dst FROM walk JOIN edges ON node = src AND kind IN ('calls', 'references', 'depends_on', 'member_of')) SELECT node FROM walk"))
def _(s, d):
    return tr.reachable(supply(s, d).edges, s.createDataFrame([("c1",)], "id string"), "out", ["calls", "references", "depends_on", "member_of"])


@query("hierarchy_up_paths", duck("""
    SELECT c.src AS seed, n.dst AS node, concat(c.src, '>', c.dst, '>', n.dst) AS path FROM edges c JOIN edges n ON n.src = c.dst AND n.kind = 'member_of' WHERE c.kind = 'member_of' AND starts_with(c.src, 'c')
    UNION ALL SELECT src, dst, concat(src, '>', dst) FROM edges WHERE kind = 'member_of' AND starts_with(src, 'c')"""))
def _(s, d):
    g = supply(s, d)
    return tr.hierarchy(g.edges, g.nodes.where("kind = 'function'").select("id"), ["member_of"]).select("seed", "node", F.array_join("path", ">").alias("path"))


@query("frontier_expand", duck("SELECT DISTINCT e.src, e.dst, e.kind, n.kind AS node_kind, n.name FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src IN ('c1', 'c2', 'c3')"))
def _(s, d):
    g = supply(s, d)
    near = g.edges.where(F.col("src").isin("c1", "c2", "c3")).select("src", "dst", "kind").distinct()
    return near.join(g.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("node_kind"), "name"), "dst").select("src", "dst", "kind", "node_kind", "name")


@query("closure_multi_seed", duck("WITH RECURSIVE walk(node, distance) AS (SELECT unnest(['c1', 'c5', 'o3']), 0 UNION SELECT dst, distance + 1 FROM walk JOIN edges ON node = src AND kind IN ('imports', 'calls', 'references', 'depends_on') WHERE distance < 6) SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY node"))
def _(s, d):
    return tr.closure(supply(s, d).edges, s.createDataFrame([("c1",), ("c5",), ("o3",)], "id string"), DEPENDENCY_KINDS)


@query("walk_token_budget", duck("""
    WITH RECURSIVE walk(node, depth) AS (SELECT 'c1', 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON node = src AND kind IN ('calls', 'references') WHERE depth < 3),
    best AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node),
    cost AS (SELECT b.node, b.depth, CAST(sum(ceil(length(n.name) / 4.0)) OVER (ORDER BY b.depth, b.node) AS BIGINT) AS spent FROM best b JOIN nodes n ON n.id = b.node)
    SELECT node, depth, spent FROM cost WHERE spent <= 200"""))
def _(s, d):
    g = supply(s, d)
    found = tr.bfs(g.edges, s.createDataFrame([("c1",)], "id string"), "out", ["calls", "references"], 3)
    costs = found.join(g.nodes.select(F.col("id").alias("node"), F.ceil(F.length("name") / 4).cast("long").alias("tokens")), "node")
    return tr.budgeted(costs, "tokens", 200).select("node", "depth", "spent")


@query("call_ancestors_fanin", duck("WITH RECURSIVE up(node) AS (SELECT 's1' UNION SELECT src FROM up JOIN edges ON dst = node AND kind IN ('calls', 'references', 'depends_on')) SELECT e.dst, count(*) AS fan_in, count(DISTINCT e.src) AS callers FROM edges e JOIN up ON up.node = e.dst WHERE e.kind IN ('calls', 'references', 'depends_on') GROUP BY 1"))
def _(s, d):
    e = tr.call_ancestors(supply(s, d).edges, s.createDataFrame([("s1",)], "id string"), ["calls", "references", "depends_on"])
    return e.groupBy("dst").agg(F.count("*").alias("fan_in"), F.count_distinct("src").alias("callers"))


@query("dataflow_paths_len3", duck("""
    WITH st AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('calls', 'references', 'depends_on')),
    a AS MATERIALIZED (SELECT src, dst FROM st WHERE src = 'c1'), b AS MATERIALIZED (SELECT src, dst FROM st WHERE src IN (SELECT dst FROM a))
    SELECT a.src AS source, c.dst AS sink, CAST(3 AS INTEGER) AS length, concat(a.src, '>', a.dst, '>', b.dst, '>', c.dst) AS path FROM a JOIN b ON b.src = a.dst JOIN st c ON c.src = b.dst WHERE c.dst IN (SELECT id FROM nodes WHERE kind = 'interface')"""))
def _(s, d):
    g = supply(s, d)
    p = tr.paths(g.edges, s.createDataFrame([("c1",)], "id string"), g.nodes.where("kind = 'interface'").select("id"), ["calls", "references", "depends_on"], 3)
    return p.select("source", "sink", "length", F.array_join("path", ">").alias("path"))


@query("find_usages_grouped", duck("SELECT dst, file_path, count(*) AS n, string_agg(src, ',' ORDER BY src) AS uses FROM edges WHERE kind IN ('calls', 'references') GROUP BY 1, 2"))
def _(s, d):
    e = fl.by_kinds(supply(s, d).edges, ["calls", "references"])
    return e.groupBy("dst", "file_path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("src")), ",").alias("uses"))


@query("find_implementations", duck("SELECT e.dst AS interface, e.src AS impl, n.name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'depends_on'"))
def _(s, d):
    g = supply(s, d)
    return g.edges.where("kind = 'depends_on'").join(g.nodes.select(F.col("id").alias("src"), "name"), "src").select(F.col("dst").alias("interface"), F.col("src").alias("impl"), "name")


@query("graph_completion", duck("""
    WITH seed AS (SELECT id FROM nodes WHERE kind = 'package'),
    near AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS position FROM near QUALIFY position <= 8)
    SELECT id, id AS seed, CAST(0 AS INTEGER) AS position FROM seed UNION ALL (SELECT dst, src, CAST(position AS INTEGER) FROM placed QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src, position) = 1)"""))
def _(s, d):
    g = supply(s, d)
    return tr.completion(g.edges, g.nodes.where("kind = 'package'").select("id"))


@query("dsl_traverse", duck("SELECT DISTINCT n.id, n.kind, n.name FROM nodes n JOIN edges e ON e.dst = n.id AND e.kind = 'member_of' JOIN nodes a ON a.id = e.src AND a.kind = 'interface' WHERE n.kind = 'package' AND contains(lower(n.name), 'a')"))
def _(s, d):
    return dsl.run(supply(s, d), "nodes kind:interface | traverse member_of out | filter kind:package name:A").select("id", "kind", "name")


@query("symbols_for_ranges", duck("SELECT n.file_path, n.id FROM nodes n WHERE n.file_path = 'src/orders/f.go' AND n.start_line <= 120 AND n.end_line >= 100"))
def _(s, d):
    asked = s.createDataFrame([("src/orders/f.go", 100, 120)], "file_path string, lo long, hi long")
    return supply(s, d).nodes.join(F.broadcast(asked), "file_path").where("start_line <= hi AND end_line >= lo").select("file_path", "id")


@query("zero_edge_class", duck("""
    SELECT n.id, CASE WHEN coalesce(i.n, 0) > 0 THEN 'none' WHEN coalesce(a.n, 0) > 0 THEN 'likely_unused' ELSE 'possible_extraction_gap' END AS class FROM nodes n
    LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges WHERE kind IN ('calls', 'references') GROUP BY 1) i ON i.id = n.id
    LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) a ON a.id = n.id"""))
def _(s, d):
    g = supply(s, d)
    ends = g.edges.select(F.col("dst").alias("id"), F.col("kind").isin("calls", "references").alias("used")).unionByName(g.edges.select(F.col("src").alias("id"), F.lit(False).alias("used")))
    per = ends.groupBy("id").agg(F.max("used").alias("used"))
    return g.nodes.select("id").join(per, "id", "left").select("id", F.when(F.col("used"), "none").when(F.col("used").isNotNull(), "likely_unused").otherwise("possible_extraction_gap").alias("class"))


@query("impact_by_depth", duck("""
    WITH RECURSIVE up(node, depth) AS (SELECT 's1', 0 UNION SELECT src, depth + 1 FROM up JOIN edges ON dst = node AND kind IN ('calls', 'references', 'depends_on') AND NOT (depth >= 1 AND confidence < 0.6) WHERE depth < 3)
    SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM (SELECT node, min(depth) AS depth FROM up GROUP BY node) WHERE depth > 0 GROUP BY 1"""))
def _(s, d):
    e = fl.by_kinds(supply(s, d).edges, ["calls", "references", "depends_on"])
    first = tr.bfs(e, s.createDataFrame([("s1",)], "id string"), "in", ["calls", "references", "depends_on"], 1)
    near = first.where("depth = 1").select(F.col("node").alias("id"))
    rest = tr.bfs(e.where("confidence >= 0.6"), near, "in", ["calls", "references", "depends_on"], 2)
    far = rest.where("depth > 0").join(first.select("node"), "node", "left_anti").select("node", (F.col("depth") + 1).alias("depth"))
    return first.where("depth > 0").select("node", "depth").unionByName(far).groupBy("depth").agg(F.count("*").alias("n"))


@query("tier_counts", duck(f"SELECT kind, {RANK_SQL} AS tier, count(*) AS n FROM edges GROUP BY 1, 2"))
def _(s, d):
    return supply(s, d).edges.groupBy("kind", rank(F.col("origin")).alias("tier")).agg(F.count("*").alias("n"))
