"""Reports on uses, gaps, risks and rules, over the supply graph and the facts of the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import reports as rp
from ..operators import traverse as tr
from ..plans.durable import spread
from ..plans.model import Graph
from ..plans.registry import query
from ..sources.tables import duck, projection, supply, table

_USES = "SELECT {by}, count(*) AS uses, count(DISTINCT src) AS users, min(line) AS first_line FROM facts WHERE kind = '{kind}'{more} GROUP BY {by}"


@query("spawns_by_mode", duck(_USES.format(by="dst, mode", kind="spawns", more="")))
def _(s, d):
    return rp.users_of(projection(s, d, "facts"), "spawns", ["dst", "mode"])


@query("field_writers", duck(_USES.format(by="dst", kind="writes", more="")))
def _(s, d):
    return rp.users_of(projection(s, d, "facts"), "writes")


@query("config_readers", duck(_USES.format(by="dst", kind="reads_config", more=" AND contains(dst, 'k1')")))
def _(s, d):
    return rp.users_of(projection(s, d, "facts"), "reads_config", name="k1")


@query("annotation_users", duck(_USES.format(by="dst", kind="annotated", more="")))
def _(s, d):
    return rp.users_of(projection(s, d, "facts"), "annotated")


@query("error_surface", duck("SELECT src AS thrower, string_agg(DISTINCT dst, ',' ORDER BY dst) AS throws FROM facts WHERE kind = 'throws' GROUP BY 1"))
def _(s, d):
    return rp.error_surface(projection(s, d, "facts"))


@query("log_events", "SELECT event_type AS context, props AS value, count(*) AS n, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS emitters FROM events GROUP BY 1, 2")
def _(s, d):
    per = table(s, d, "events").groupBy(F.col("event_type").alias("context"), F.col("props").alias("value"))
    return per.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("user_id").cast("string"))), ",").alias("emitters"))


@query("synthesizers", duck("SELECT mode AS synthesizer, kind, count(*) AS edges FROM facts GROUP BY 1, 2"))
def _(s, d):
    return projection(s, d, "facts").groupBy(F.col("mode").alias("synthesizer"), "kind").agg(F.count("*").alias("edges"))


@query("incoming_by_first", duck("""
    SELECT dst, src, file_path, n, CAST(row_number() OVER (PARTITION BY dst ORDER BY first_line, src, file_path) AS INTEGER) AS place
    FROM (SELECT dst, src, file_path, count(*) AS n, min(line) AS first_line FROM facts GROUP BY 1, 2, 3)"""))
def _(s, d):
    return rp.incoming_by_first(projection(s, d, "facts"))


@query("tests_by_symbol", duck("SELECT dst AS key, count(DISTINCT src) AS n, min(src) AS first FROM edges WHERE kind = 'calls' GROUP BY 1"))
def _(s, d):
    return rp.tests_as_edges(supply(s, d).edges.where("kind = 'calls'"), "symbol")


@query("symbols_by_test", duck("SELECT src AS key, count(DISTINCT dst) AS n, min(dst) AS first FROM edges WHERE kind = 'calls' GROUP BY 1"))
def _(s, d):
    return rp.tests_as_edges(supply(s, d).edges.where("kind = 'calls'"), "test")


@query("hotspot_novelty", duck("""
    SELECT dst AS id, round(count(*) * greatest(0.0, least(1.0, 1 - date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') / 30.0)), 6) AS heat FROM facts GROUP BY 1"""))
def _(s, d):
    per = projection(s, d, "facts").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    days = F.datediff(F.lit("2024-02-01").cast("date"), "last")
    return per.select("id", F.round(rp.novelty(F.col("n"), days, 30.0), 6).alias("heat"))


@query("bottleneck_loops", duck("""
    WITH l AS (SELECT id, start_line % 3 AS loop FROM nodes),
    s AS (SELECT id, loop AS total FROM l WHERE starts_with(id, 's')),
    p AS (SELECT l.id, l.loop + coalesce(max(s.total), 0) AS total FROM l LEFT JOIN edges e ON e.src = l.id AND e.kind = 'depends_on' LEFT JOIN s ON s.id = e.dst WHERE starts_with(l.id, 'p') GROUP BY l.id, l.loop),
    o AS (SELECT l.id, l.loop + coalesce(max(p.total), 0) AS total FROM l LEFT JOIN edges e ON e.src = l.id AND e.kind = 'references' LEFT JOIN p ON p.id = e.dst WHERE starts_with(l.id, 'o') GROUP BY l.id, l.loop),
    c AS (SELECT l.id, l.loop + coalesce(max(o.total), 0) AS total FROM l LEFT JOIN edges e ON e.src = l.id AND e.kind = 'calls' LEFT JOIN o ON o.id = e.dst WHERE starts_with(l.id, 'c') GROUP BY l.id, l.loop)
    FROM s UNION ALL FROM p UNION ALL FROM o UNION ALL FROM c"""))
def _(s, d):
    g = supply(s, d)
    ids = g.nodes.where(F.substring("id", 1, 1).isin("c", "o", "p", "s")).select("id", (F.col("start_line") % 3).alias("loop"))
    return rp.deepest_loops(ids, fl.by_kinds(g.edges, ["calls", "references", "depends_on"]))


@query("unimplemented_interfaces", duck("SELECT id FROM nodes WHERE kind = 'method' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'calls' AND origin = 'lsp_resolved')"))
def _(s, d):
    g = supply(s, d)
    return rp.unimplemented(Graph(g.nodes, g.edges.where("origin = 'lsp_resolved'")), "method", "calls")


_TESTED = "CASE WHEN line % 4 < 3 THEN 'src/tests/a.go' ELSE file_path END"


@query("test_only_targets", duck(f"WITH t AS (SELECT dst, regexp_matches({_TESTED}, '{fl.TEST_PATH}') AS t FROM edges) SELECT dst, count(*) AS n FROM t GROUP BY 1 HAVING bool_and(t)"))
def _(s, d):
    return rp.only_from_tests(supply(s, d).edges.withColumn("file_path", F.expr(_TESTED)))


@query("test_paths", rf"""
    WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'src/latest/' WHEN 1 THEN 'src/tests/' WHEN 2 THEN 'pkg/test_' WHEN 3 THEN 'a/contest.' ELSE 'b/x.spec.' END || source AS path FROM documents)
    SELECT doc_id, path, regexp_matches(path, '{fl.TEST_PATH}') AS is_test FROM p""")
def _(s, d):
    stem = F.expr("CASE doc_id % 5 WHEN 0 THEN 'src/latest/' WHEN 1 THEN 'src/tests/' WHEN 2 THEN 'pkg/test_' WHEN 3 THEN 'a/contest.' ELSE 'b/x.spec.' END")
    return table(s, d, "documents").select("doc_id", F.concat(stem, "source").alias("path")).withColumn("is_test", fl.is_test(F.col("path")))


@query("coverage_projection", duck("""
    WITH seg AS (SELECT concat('src/orders/', lower(o_orderstatus), '.go') AS file_path, l_orderkey AS at, CAST(l_quantity AS BIGINT) AS stmts, CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS hits FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    x AS (SELECT n.id, CAST(coalesce(sum(s.stmts), 0) AS BIGINT) AS stmts, CAST(coalesce(sum(s.stmts) FILTER (s.hits > 0), 0) AS BIGINT) AS hit FROM nodes n LEFT JOIN seg s ON s.file_path = n.file_path AND s.at BETWEEN n.start_line AND n.end_line WHERE n.kind = 'method' GROUP BY 1)
    SELECT id, stmts, hit, CASE WHEN stmts = 0 THEN -1.0 ELSE CAST(round(100.0 * hit / stmts, 2) AS DOUBLE) END AS pct FROM x"""))
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("at"), F.concat(F.lit("src/orders/"), F.lower("o_orderstatus"), F.lit(".go")).alias("file_path"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("at"), F.col("l_quantity").cast("long").alias("stmts"), (F.col("l_linestatus") == "F").cast("int").alias("hits"))
    symbols = supply(s, d).nodes.where("kind = 'method'").select("id", "file_path", "start_line", "end_line")
    return rp.covered(symbols, lines.join(o, "at"))


@query("knowledge_gaps", duck("""
    WITH deg AS (SELECT id, count(*) FILTER (w = 'i') AS fan_in FROM (SELECT dst AS id, 'i' AS w FROM edges WHERE kind <> 'references' UNION ALL SELECT src, 'o' FROM edges WHERE kind <> 'references') GROUP BY 1),
    per AS (SELECT file_path AS id, count(*) AS n FROM nodes GROUP BY 1)
    SELECT 'disconnected' AS gap, id, CAST(0 AS BIGINT) AS n FROM nodes WHERE id NOT IN (SELECT id FROM deg)
    UNION ALL SELECT 'untested_hotspot', id, fan_in FROM deg WHERE fan_in >= 5 AND id IN (SELECT id FROM nodes) AND id NOT IN (SELECT dst FROM edges WHERE kind = 'calls')
    UNION ALL SELECT 'thin', id, n FROM per WHERE n < 4
    UNION ALL SELECT 'single_file', id, n FROM per WHERE n >= 4"""))
def _(s, d):
    g = supply(s, d)
    e = g.edges.where("kind <> 'references'")
    return rp.knowledge_gaps(Graph(g.nodes, e), g.nodes.select("id", F.col("file_path").alias("community")), e.where("kind = 'calls'").select(F.col("dst").alias("id")), 5, 4)


_DEADS = """
    WITH e AS (SELECT src, dst, kind FROM edges WHERE NOT (kind = 'calls' AND line % 3 = 0) UNION ALL SELECT src, concat('unresolved::*.order_', line), 'calls' FROM edges WHERE kind = 'calls' AND line % 6 = 0),
    n AS (SELECT id, name, CASE start_line % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'package' END AS visibility FROM nodes),"""


@query("dead_code_rules", duck(_DEADS + """
    used AS (SELECT DISTINCT dst AS id FROM e WHERE kind = 'calls'), saved AS (SELECT DISTINCT src AS id FROM e JOIN used ON used.id = e.dst WHERE e.kind = 'references'),
    loose AS (SELECT DISTINCT regexp_extract(dst, '^unresolved::\\*\\.(.*)$', 1) AS name FROM e WHERE regexp_matches(dst, '^unresolved::\\*\\.'))
    SELECT n.id, CASE WHEN loose.name IS NOT NULL THEN 'coverage_gap' ELSE 'dead' END AS verdict FROM n LEFT JOIN loose ON loose.name = n.name
    WHERE visibility IN ('private', 'package') AND NOT regexp_matches(n.name, '^(main|Customer)') AND n.id NOT IN (SELECT id FROM used) AND n.id NOT IN (SELECT id FROM saved)""".replace("\\\\", "\\")))
def _(s, d):
    g = supply(s, d)
    e = g.edges.where("NOT (kind = 'calls' AND line % 3 = 0)").select("src", "dst", "kind")
    loose = g.edges.where("kind = 'calls' AND line % 6 = 0").select("src", F.concat(F.lit("unresolved::*.order_"), F.col("line").cast("string")).alias("dst"), "kind")
    nodes = g.nodes.select("id", "name", F.expr("CASE start_line % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'package' END").alias("visibility"))
    return rp.dead_code(nodes, e.unionByName(loose), ["calls"], "references", ["private", "package"], "^(main|Customer)")


@query("dead_code_evidence", duck("""
    WITH dem AS (SELECT dst AS i, count(*) AS demand FROM edges WHERE kind = 'member_of' GROUP BY 1),
    per AS (SELECT owner, count(*) AS interfaces, CAST(sum(demand) AS BIGINT) AS demand FROM (SELECT DISTINCT src AS owner, dst AS i FROM edges WHERE kind = 'depends_on') JOIN (SELECT dst AS i, count(*) AS demand FROM edges WHERE kind = 'depends_on' GROUP BY 1) USING (i) GROUP BY 1)
    SELECT n.id, coalesce(interfaces, 0) AS interfaces, coalesce(demand, 0) AS demand FROM nodes n LEFT JOIN per ON per.owner = n.id WHERE n.kind = 'type'"""))
def _(s, d):
    g = supply(s, d)
    e = g.edges.where("kind = 'depends_on'")
    return rp.demand_evidence(g.nodes.where("kind = 'type'").select("id", F.col("id").alias("owner")), e, e)


@query("pr_risk", """
    WITH a AS (SELECT o_orderkey AS pr, least(1.0, count(l_linenumber) / 8.0) AS flow, least(1.0, count(DISTINCT l_suppkey) / 5.0) AS callers, CASE WHEN count(l_linenumber) = 0 THEN 0.0 ELSE 1 - count(*) FILTER (l_linestatus = 'F') / count(l_linenumber) END AS coverage, o_orderpriority
               FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, o_orderpriority),
    w AS (SELECT *, greatest(flow, callers, coverage) AS worst, contains(o_orderpriority, 'URGENT') AS hit FROM a)
    SELECT pr, CASE WHEN worst >= 0.9 THEN 'CRITICAL' WHEN worst >= 0.6 OR hit THEN 'HIGH' WHEN worst >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level,
           array_to_string(list_transform(list_sort(list_filter([{'v': -flow, 'k': 'flow'}, {'v': -callers, 'k': 'callers'}, {'v': -coverage, 'k': 'coverage'}], lambda p: p.v < 0)), lambda p: p.k), ',') AS factors FROM w""")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("pr"), "l_linenumber", "l_suppkey", "l_linestatus")
    n = F.count("l_linenumber")
    per = table(s, d, "orders").select(F.col("o_orderkey").alias("pr"), "o_orderpriority").join(spread(li, "pr"), "pr", "left").groupBy("pr", "o_orderpriority")
    a = per.agg(F.least(F.lit(1.0), n / 8.0).alias("flow"), F.least(F.lit(1.0), F.count_distinct("l_suppkey") / 5.0).alias("callers"), F.when(n == 0, 0.0).otherwise(1 - F.count_if(F.col("l_linestatus") == "F") / n).alias("coverage"))
    level, factors = rp.pr_risk({k: F.col(k) for k in ("flow", "callers", "coverage")}, F.contains("o_orderpriority", F.lit("URGENT")))
    return a.select("pr", level.alias("level"), factors.alias("factors"))


@query("route_risk", """
    WITH r AS (SELECT p_brand AS route, count(l_orderkey) AS consumers, count(*) FILTER (l_discount > 0.09) AS mismatches, bool_or(l_returnflag = 'R' AND l_quantity >= 50) AS breaking FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_size)
    SELECT route, CASE WHEN breaking THEN 'HIGH' ELSE ['LOW', 'MEDIUM', 'HIGH'][least(2, CASE WHEN consumers > 10 THEN 2 WHEN consumers >= 5 THEN 1 ELSE 0 END + CASE WHEN mismatches > 0 THEN 1 ELSE 0 END) + 1] END AS risk, count(*) AS n FROM r GROUP BY 1, 2""")
def _(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_discount", "l_returnflag", "l_quantity")
    per = table(s, d, "part").select("p_partkey", "p_brand", "p_size").join(li, "p_partkey", "left").groupBy(F.col("p_brand").alias("route"), "p_size")
    r = per.agg(F.count("l_orderkey").alias("consumers"), F.count_if(F.col("l_discount") > 0.09).alias("mismatches"), F.coalesce(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50)), F.lit(False)).alias("breaking"))
    return r.groupBy("route", rp.route_risk(F.col("consumers"), F.col("mismatches"), F.col("breaking")).alias("risk")).agg(F.count("*").alias("n"))


_LOOSE = "CASE line % 7 WHEN 0 THEN concat('unresolved::', dst) WHEN 1 THEN concat('unresolved::*.', dst) WHEN 2 THEN concat('external::', dst) WHEN 3 THEN concat('x', dst) ELSE dst END"


@query("resolution_outcomes", duck(f"""
    SELECT e.kind, CASE WHEN n.id IS NOT NULL THEN 'resolved' WHEN starts_with(e.d, 'unresolved::*.') THEN 'ambiguous' WHEN starts_with(e.d, 'unresolved::') THEN 'unresolved' WHEN starts_with(e.d, 'external::') THEN 'external' ELSE 'dangling' END AS outcome, count(*) AS n
    FROM (SELECT kind, {_LOOSE} AS d FROM edges) e LEFT JOIN nodes n ON n.id = e.d GROUP BY 1, 2"""))
def _(s, d):
    g = supply(s, d)
    e = g.edges.select("kind", F.expr(_LOOSE).alias("dst")).join(g.nodes.select(F.col("id").alias("dst"), F.lit(True).alias("found")), "dst", "left")
    return e.groupBy("kind", rp.outcome(F.col("dst"), F.coalesce("found", F.lit(False))).alias("outcome")).agg(F.count("*").alias("n"))


@query("boundary_candidates", duck(f"SELECT regexp_replace(d, '^(unresolved|external)::(\\*\\.)?', '') AS key, count(*) AS sites FROM (SELECT {_LOOSE} AS d FROM edges) WHERE regexp_matches(d, '^(unresolved|external)::') GROUP BY 1".replace("\\\\", "\\")))
def _(s, d):
    e = supply(s, d).edges.select(F.expr(_LOOSE).alias("dst")).where(F.col("dst").rlike(rp.UNRESOLVED))
    return e.groupBy(F.regexp_replace("dst", r"^(unresolved|external)::(\*\.)?", "").alias("key")).agg(F.count("*").alias("sites"))


@query("unresolved_skip", duck(f"SELECT src, dst, kind FROM (SELECT src, {_LOOSE} AS dst, kind FROM edges) WHERE NOT starts_with(dst, 'unresolved::') AND NOT starts_with(dst, 'external::')"))
def _(s, d):
    return fl.walkable(supply(s, d).edges.select("src", F.expr(_LOOSE).alias("dst"), "kind"))


@query("doc_staleness", duck("SELECT DISTINCT src, concat('s', substring(dst, 2)) AS dst FROM edges WHERE kind = 'references' AND concat('s', substring(dst, 2)) NOT IN (SELECT id FROM nodes)"))
def _(s, d):
    g = supply(s, d)
    return rp.dangling(g.edges.where("kind = 'references'").select("src", F.concat(F.lit("s"), F.substring("dst", 2, 20)).alias("dst")), g.nodes)


@query("infra_consumers", duck("SELECT n.id, n.kind, count(e.src) AS consumers FROM nodes n LEFT JOIN edges e ON e.dst = n.id AND e.kind = 'member_of' WHERE n.kind IN ('package', 'module') GROUP BY 1, 2"))
def _(s, d):
    g = supply(s, d)
    per = g.edges.where("kind = 'member_of'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("consumers"))
    return g.nodes.where(F.col("kind").isin("package", "module")).select("id", "kind").join(per, "id", "left").fillna(0, ["consumers"])


@query("suggested_queries", duck("""
    WITH deg AS (SELECT n.id, n.file_path, x.fan_in, x.fan_out FROM nodes n JOIN (SELECT id, count(*) FILTER (w = 0) AS fan_in, count(*) FILTER (w = 1) AS fan_out FROM (SELECT dst AS id, 0 AS w FROM edges UNION ALL SELECT src, 1 FROM edges) GROUP BY 1) x USING (id)),
    u AS (SELECT 0 AS c, 'entry' AS category, id, fan_out AS v FROM deg WHERE fan_in = 0 UNION ALL SELECT 1, 'bridge', id, least(fan_in, fan_out) FROM deg WHERE fan_in > 0 AND fan_out > 0 UNION ALL SELECT 2, 'hub', id, fan_in FROM deg
          UNION ALL SELECT 3, 'subsystem', array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/'), sum(fan_in) FROM deg GROUP BY 3),
    b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY c ORDER BY v DESC, id) <= 3)
    SELECT CAST(row_number() OVER (ORDER BY c, v DESC, id) - 1 AS INTEGER) AS place, category, id FROM b"""))
def _(s, d):
    g = supply(s, d)
    return rp.suggestions(g.nodes, g.edges)


@query("suggest_boundaries", duck("""
    WITH l AS (SELECT id, array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') AS layer FROM nodes), x AS (SELECT DISTINCT a.layer AS a, b.layer AS b FROM edges e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst WHERE a.layer <> b.layer)
    SELECT layer, coalesce(string_agg(b, ',' ORDER BY b), '') AS allowed FROM (SELECT DISTINCT layer FROM l) LEFT JOIN x ON x.a = layer GROUP BY 1"""))
def _(s, d):
    g = supply(s, d)
    return rp.boundaries(g.nodes, g.edges)


@query("callers_outside", duck("""
    WITH i AS (SELECT id FROM nodes WHERE repo_prefix = 'supply')
    SELECT src, dst, kind FROM edges WHERE dst IN (SELECT id FROM i) AND src NOT IN (SELECT id FROM i) AND src IN (SELECT id FROM nodes WHERE start_line % 2 = 0)"""))
def _(s, d):
    g = supply(s, d)
    return rp.callers_outside(g.edges, g.nodes, F.col("repo_prefix") == "supply", g.nodes.where("start_line % 2 = 0").select("id"))


@query("event_rules", """
    WITH e AS (SELECT event_type, concat('u', user_id) AS u FROM events)
    SELECT event_type AS topic, 'producer' AS rule, count(*) AS n FROM e WHERE NOT regexp_matches(u, '^u[0-4]') GROUP BY 1
    UNION ALL SELECT event_type, 'consumer', 0 FROM e GROUP BY 1 HAVING count(*) FILTER (u = 'u999999') = 0 UNION ALL SELECT event_type, 'forbidden', count(*) FROM e WHERE event_type = 'error' GROUP BY 1""")
def _(s, d):
    e = table(s, d, "events").select("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"))
    return rp.event_rules(e, "event_type", "u", "^u[0-4]", ["u999999"], ["error"])


@query("flag_users", duck("SELECT file_path, count(*) AS n, count(DISTINCT src) AS users FROM facts WHERE mode = 'thread' AND kind IN ('spawns', 'writes') GROUP BY 1"))
def _(s, d):
    return projection(s, d, "facts").where(F.col("kind").isin("spawns", "writes") & (F.col("mode") == "thread")).groupBy("file_path").agg(F.count("*").alias("n"), F.count_distinct("src").alias("users"))


_SCORE = "CASE WHEN regexp_matches(name, '^(main|Main)$') THEN 3.0 WHEN regexp_matches(name, '(?i)^(handle|serve|run|customer)') THEN 1.5 WHEN regexp_matches(name, '^(get|set|is)[A-Z_]') THEN 0.3 ELSE 1.0 END"
_ENTRY = f"""deg AS (SELECT n.id, {_SCORE} * coalesce(x.fo, 0) / (1 + coalesce(x.fi, 0)) AS score FROM nodes n LEFT JOIN (SELECT id, count(*) FILTER (w = 0) AS fi, count(*) FILTER (w = 1) AS fo FROM (SELECT dst AS id, 0 AS w FROM edges WHERE kind IN ('calls', 'references') UNION ALL SELECT src, 1 FROM edges WHERE kind IN ('calls', 'references')) GROUP BY 1) x USING (id))"""


def _entries(g):
    d = rp.degrees(fl.by_kinds(g.edges, ["calls", "references"]))
    at = g.nodes.select("id", "name").join(d, "id", "left").fillna(0, ["fan_in", "fan_out"])
    return at.select("id", F.round(rp.entry_score(F.col("fan_in"), F.col("fan_out"), F.col("name")), 6).alias("score"))


@query("entry_point_score", duck(f"WITH {_ENTRY} SELECT id, CAST(round(score, 6) AS DOUBLE) AS score FROM deg"))
def _(s, d):
    return _entries(supply(s, d))


@query("process_discovery", duck(f"""
    WITH RECURSIVE {_ENTRY}, top AS (SELECT id FROM deg WHERE score > 0 ORDER BY round(score, 6) DESC, id LIMIT 3),
    walk(process, node, depth) AS (SELECT id, id, 0 FROM top UNION SELECT process, dst, depth + 1 FROM walk JOIN edges ON src = node AND kind IN ('calls', 'references') WHERE depth < 3),
    b AS (SELECT process, node, min(depth) AS depth FROM walk GROUP BY 1, 2), n AS (SELECT process, count(*) AS steps FROM b GROUP BY 1)
    SELECT process, steps, CASE WHEN steps > 20 THEN 'steps' ELSE '' END AS truncated FROM n WHERE steps >= 2"""))
def _(s, d):
    g = supply(s, d)
    return tr.processes(g.edges, _entries(g).where("score > 0").orderBy(F.desc("score"), "id").limit(3), ["calls", "references"], 3, 20).groupBy("process").agg(F.max("steps").alias("steps"), F.max("truncated").alias("truncated"))


@query("entry_kind_stamp", duck("""
    WITH RECURSIVE down(id, entry_kind) AS (SELECT id, concat('region:', name) FROM nodes WHERE kind = 'module' UNION SELECT e.src, down.entry_kind FROM down JOIN edges e ON e.dst = down.id AND e.kind = 'member_of')
    SELECT id, entry_kind FROM down"""))
def _(s, d):
    g = supply(s, d)
    return tr.stamped(g.edges, g.nodes.where("kind = 'module'").select("id", F.concat(F.lit("region:"), "name").alias("entry_kind")), "entry_kind", ["member_of"])


@query("graded_manifest", duck("""
    WITH x AS (SELECT id, ceil(length(name) / 1.0) AS f, ceil(length(name) / 3.0) AS sk, 1.0 AS nm, row_number() OVER (ORDER BY start_line, id) AS k FROM nodes),
    r AS (SELECT id, f, sk, nm, sum(f) OVER w AS cf, sum(sk) OVER w AS cs, sum(nm) OVER w AS cn FROM x WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT id, CASE WHEN cf <= 100 THEN 'full' WHEN cs <= 200 THEN 'skeleton' WHEN cn <= 300 THEN 'name' END AS grade, f, sk, nm FROM r)
    SELECT id, grade, CAST(CASE grade WHEN 'full' THEN f WHEN 'skeleton' THEN sk ELSE nm END AS BIGINT) AS cost FROM g WHERE grade IS NOT NULL"""))
def _(s, d):
    n = supply(s, d).nodes.select("id", "start_line", F.length("name").cast("long").alias("full"), F.ceil(F.length("name") / 3).cast("long").alias("skeleton"), F.lit(1).cast("long").alias("name"))
    return rp.graded(n, 300, order=("start_line", "id")).select("id", "grade", "cost")


@query("blast_radius", duck("""
    WITH dir AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM edges WHERE kind IN ('references', 'depends_on') GROUP BY 1),
    t AS (SELECT dst AS id, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM (SELECT DISTINCT dst, src FROM edges WHERE kind = 'references' AND line % 2 = 0)),
    c AS (SELECT id, string_agg(src, ',' ORDER BY src) AS tests FROM t WHERE k <= 3 GROUP BY 1)
    SELECT n.id, coalesce(dir.callers, 0) AS callers, coalesce(c.tests, '') AS tests, c.tests IS NULL AS no_tests FROM nodes n LEFT JOIN dir USING (id) LEFT JOIN c USING (id) WHERE n.kind IN ('type', 'interface')"""))
def _(s, d):
    g = supply(s, d)
    return rp.blast_radius(g.nodes.where(F.col("kind").isin("type", "interface")).select("id"), fl.by_kinds(g.edges, ["references", "depends_on"]), g.edges.where("kind = 'references' AND line % 2 = 0"), 3)


@query("content_scan", duck("SELECT id, kind IN ('package', 'module') AS content FROM nodes WHERE kind NOT IN ('type')"))
def _(s, d):
    n = supply(s, d).nodes.where("kind <> 'type'")
    return fl.content(n, True, ("package", "module")).select("id", F.lit(True).alias("content")).unionByName(fl.content(n, False, ("package", "module")).select("id", F.lit(False).alias("content")))


@query("flavor_filter", "SELECT p_partkey, p_type AS flavor FROM part WHERE lower(p_type) = 'economy'")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_type").alias("flavor")).where(fl.field_filter({"flavor": "Economy"}))


@query("path_prefix", duck("SELECT id FROM nodes WHERE starts_with(file_path, 'src/geo/')"))
def _(s, d):
    return fl.under(supply(s, d).nodes, "geo/src/geo/").select("id")


@query("speculative_filter", duck("SELECT src, dst, kind FROM edges WHERE origin <> 'text_matched'"))
def _(s, d):
    e = supply(s, d).edges.withColumn("origin", F.when(F.col("origin") == "text_matched", "speculative").otherwise(F.col("origin")))
    return fl.speculative(e, False).select("src", "dst", "kind")


@query("proxy_exclusion", duck("WITH e AS (SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE kind = 'package') AND dst NOT IN (SELECT id FROM nodes WHERE kind = 'package')) SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1"))
def _(s, d):
    g = supply(s, d)
    e = fl.without(g.edges, g.nodes.where("kind = 'package'").select("id"))
    return rp.degrees(e).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))


@query("node_pattern", duck("SELECT id, name FROM nodes WHERE contains(lower(name), 'ring') AND kind = 'type' AND starts_with(file_path, 'src/part/')"))
def _(s, d):
    return supply(s, d).nodes.where(fl.node_pattern("name:ring kind:type path:src/part/")).select("id", "name")


@query("dead_eligible", duck("SELECT id FROM nodes WHERE kind NOT IN ('package', 'module') AND NOT regexp_matches(name, '^[A-Z]') AND NOT regexp_matches(name, '^order_1$')"))
def _(s, d):
    return fl.may_be_dead(supply(s, d).nodes, ("package", "module"), "^[A-Z]", "^order_1$").select("id")


@query("definition_kinds", duck("SELECT kind, count(*) AS n FROM nodes WHERE kind IN ('function', 'method', 'type', 'interface', 'constant', 'variable', 'macro') GROUP BY 1"))
def _(s, d):
    return supply(s, d).nodes.where(F.col("kind").isin(*fl.DEFINITION_KINDS)).groupBy("kind").agg(F.count("*").alias("n"))


@query("kinds_csv", duck("SELECT src, dst, kind FROM edges WHERE kind IN ('calls', 'member_of')"))
def _(s, d):
    return fl.by_kinds(supply(s, d).edges, fl.parse_kinds(" Calls,,member_of, calls ", ["calls", "member_of", "references"])).select("src", "dst", "kind")


@query("small_side_outer", duck("SELECT n.id, count(*) AS n FROM nodes n JOIN edges e ON e.dst = n.id WHERE n.kind = 'package' GROUP BY 1"))
def _(s, d):
    g = supply(s, d)
    return tr.into_few(g.edges, g.nodes.where("kind = 'package'").select("id")).groupBy("id").agg(F.count("*").alias("n"))


@query("list_parameter_join", duck("SELECT n.id, n.name FROM nodes n JOIN (SELECT unnest(['c3', 'o4', 'p5', 'nope']) AS id) USING (id)"))
def _(s, d):
    return fl.join_list(supply(s, d).nodes, ["c3", "o4", "p5", "nope", "p5"]).select("id", "name")
