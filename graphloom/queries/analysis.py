"""Graph analytics and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import retrieval as rt
from ..operators import traverse as tr
from ..plans.registry import query
from ..sources.tables import duck, projection, supply, table
from ..streaming import events as ev


def _trade(s, d):
    e = projection(s, d, "trade")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return ids, e.select("src", "dst", F.col("w").cast("double").alias("w"))


def _ranks(rounds: int) -> str:
    steps = ["ids AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade)", "tot AS (SELECT src, sum(w) AS total FROM trade GROUP BY 1)", "r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM ids) AS score FROM ids)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS (SELECT i.id, 0.85 * (coalesce(x.v, 0) + (SELECT coalesce(sum(score), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM tot)) / (SELECT count(*) FROM ids)) + 0.15 / (SELECT count(*) FROM ids) AS score FROM ids i LEFT JOIN (SELECT t.dst AS id, sum(CAST(t.w AS DOUBLE) / total * score) AS v FROM trade t JOIN tot USING (src) JOIN r{k} ON r{k}.id = t.src GROUP BY 1) x ON x.id = i.id)")
    return duck("WITH " + ", ".join(steps) + f" SELECT id, round(score, 6) AS score FROM r{rounds}")


@query("pagerank_5", _ranks(5))
def _(s, d):
    ids, e = _trade(s, d)
    return an.pagerank(ids, e, rounds=5).select("id", F.round("score", 6).alias("score"))


def _hits(rounds: int) -> str:
    steps = ["ids AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade)", "h0 AS (SELECT id, 1.0 AS v FROM ids)"]
    for k in range(rounds):
        steps.append(f"a{k + 1} AS (SELECT id, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT t.dst AS id, sum(CAST(t.w AS DOUBLE) * h.v) AS v FROM trade t JOIN h{k} h ON h.id = t.src GROUP BY 1))")
        steps.append(f"h{k + 1} AS (SELECT id, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT t.src AS id, sum(CAST(t.w AS DOUBLE) * a.v) AS v FROM trade t JOIN a{k + 1} a ON a.id = t.dst GROUP BY 1))")
    return duck("WITH " + ", ".join(steps) + f" SELECT i.id, round(coalesce(a.v, 0), 6) AS authority, round(coalesce(h.v, 0), 6) AS hub FROM ids i LEFT JOIN a{rounds} a ON a.id = i.id LEFT JOIN h{rounds} h ON h.id = i.id")


@query("hits_5", _hits(5))
def _(s, d):
    return an.hits(_trade(s, d)[1], 5).select("id", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


def _restarts(rounds: int, seeds: tuple[str, ...]) -> str:
    home = f"CASE WHEN id IN ({', '.join(map(repr, seeds))}) THEN 1.0 / {len(seeds)} ELSE 0.0 END"
    steps = [f"ids AS (SELECT id, {home} AS home FROM (SELECT src AS id FROM trade UNION SELECT dst FROM trade))", "tot AS (SELECT src, sum(w) AS total FROM trade GROUP BY 1)", "r0 AS (SELECT id, home AS score FROM ids)"]
    for k in range(rounds):
        inflow = f"SELECT t.dst AS id, sum(CAST(t.w AS DOUBLE) / total * score) AS v FROM trade t JOIN tot USING (src) JOIN r{k} ON r{k}.id = t.src GROUP BY 1"
        loose = f"(SELECT coalesce(sum(score), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM tot))"
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT i.id, 0.85 * (coalesce(x.v, 0) + {loose} * home) + 0.15 * home AS score FROM ids i LEFT JOIN ({inflow}) x ON x.id = i.id)")
    return "WITH " + ", ".join(steps)


@query("ppr_top5", duck(_restarts(10, ("n1", "n2")) + " SELECT id, CAST(round(score, 6) AS DOUBLE) AS score FROM r10 ORDER BY round(score, 6) DESC, id LIMIT 5"))
def _(s, d):
    ids, e = _trade(s, d)
    return an.pagerank(ids, e, rounds=10, seeds=s.createDataFrame([("n1",), ("n2",)], "id string")).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(5)


@query("closure_proximity", duck(_restarts(10, ("n1",)) + ", near AS (SELECT 'n1' AS node, 0 AS distance UNION SELECT dst, 1 FROM trade WHERE src = 'n1' AND dst <> 'n1') SELECT node, CAST(distance AS INTEGER) AS distance, CAST(round(score, 6) AS DOUBLE) AS proximity FROM near JOIN r10 ON id = node"))
def _(s, d):
    ids, e = _trade(s, d)
    seed = s.createDataFrame([("n1",)], "id string")
    near = tr.closure(e.withColumn("kind", F.lit("calls")), seed, ["calls"], 1)
    rank = an.pagerank(ids, e, rounds=10, seeds=seed).select(F.col("id").alias("node"), F.round("score", 6).alias("proximity"))
    return near.join(rank, "node", "left").select("node", "distance", F.coalesce("proximity", 1.0 / (1 + F.col("distance"))).alias("proximity"))


@query("signal_hits", _hits(5).replace("round(coalesce(a.v, 0), 6) AS authority, round(coalesce(h.v, 0), 6) AS hub", "round(greatest(0.0, least(1.0, round(coalesce(a.v, 0), 6) / (1 + round(coalesce(h.v, 0), 6)))), 5) AS s_hits"))
def _(s, d):
    h = an.hits(_trade(s, d)[1], 5).select("id", F.round("authority", 6).alias("a"), F.round("hub", 6).alias("h"))
    return h.select("id", F.round(rt.hits_signal(F.col("a"), F.col("h")), 5).alias("s_hits"))


@query("personalised_pagerank", duck(_restarts(10, ("n1", "n2")) + " SELECT id, CAST(round(score, 6) AS DOUBLE) AS score FROM r10"))
def _(s, d):
    ids, e = _trade(s, d)
    return an.pagerank(ids, e, rounds=10, seeds=s.createDataFrame([("n1",), ("n2",)], "id string")).select("id", F.round("score", 6).alias("score"))


@query("weak_components", duck("WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'member_of' UNION SELECT dst, src FROM edges WHERE kind = 'member_of'), r(id, root) AS (SELECT id, id FROM nodes WHERE kind = 'module' UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT n.id, coalesce(m.component, n.id) AS component FROM nodes n LEFT JOIN (SELECT r.id, min(x.id) AS component FROM r JOIN (SELECT id, root FROM r) x USING (root) GROUP BY 1) m ON m.id = n.id"))
def _(s, d):
    g = supply(s, d)
    return an.weak_components(g.nodes.select("id"), g.edges.where("kind = 'member_of'"))


@query("strong_components")
def _(s, d):
    e = projection(s, d, "basket")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return an.strong_components(ids, e)


@query("cycles")
def _(s, d):
    e = projection(s, d, "basket")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return an.cycles(ids, e)


@query("k_core")
def _(s, d):
    e = projection(s, d, "basket")
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return an.k_core(ids, e)


@query("communities_lpa")
def _(s, d):
    ids, e = _trade(s, d)
    return an.label_communities(ids, e)


_BETWEEN = """
    WITH e AS MATERIALIZED (SELECT DISTINCT src AS s, dst AS t FROM trade WHERE src <> dst), ids AS (SELECT s AS id FROM e UNION SELECT t FROM e UNION SELECT src FROM trade UNION SELECT dst FROM trade),
    l0 AS (SELECT id AS s, id AS t, 0 AS d, 1.0 AS n FROM ids), l1 AS MATERIALIZED (SELECT s, t, 1 AS d, 1.0 AS n FROM e),
    l2 AS MATERIALIZED (SELECT a.s, e.t, 2 AS d, sum(a.n) AS n FROM l1 a JOIN e ON e.s = a.t WHERE a.s <> e.t AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.s = a.s AND x.t = e.t) GROUP BY 1, 2),
    l3 AS MATERIALIZED (SELECT a.s, e.t, 3 AS d, sum(a.n) AS n FROM l2 a JOIN e ON e.s = a.t WHERE a.s <> e.t AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.s = a.s AND x.t = e.t) AND NOT EXISTS (SELECT 1 FROM l2 x WHERE x.s = a.s AND x.t = e.t) GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3),
    b AS (SELECT a.t AS id, sum(a.n * b.n / st.n) AS score FROM p a JOIN p b ON b.s = a.t AND b.t <> a.s JOIN p st ON st.s = a.s AND st.t = b.t AND st.d = a.d + b.d GROUP BY 1)
    SELECT ids.id, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score FROM ids LEFT JOIN b ON b.id = ids.id"""


@query("communities_resolution")
def _(s, d):
    ids, e = _trade(s, d)
    return an.communities(ids, e, 1.0)


@query("spectral_clusters")
def _(s, d):
    ids, e = _trade(s, d)
    return an.spectral(ids, e)


@query("betweenness", duck(_BETWEEN))
def _(s, d):
    ids, e = _trade(s, d)
    return an.betweenness(ids, e).withColumn("score", F.round("score", 6))


@query("degree_distribution", duck("SELECT degree, count(*) AS nodes FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM basket UNION ALL SELECT dst FROM basket) GROUP BY 1) GROUP BY 1"))
def _(s, d):
    e = projection(s, d, "basket")
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return ev.tumbling(table(s, d, "events"), "1 hour")


@query("sliding_counts", "SELECT b + to_minutes(30 * k) AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events) CROSS JOIN (SELECT unnest([0, -1]) AS k) GROUP BY 1")
def _(s, d):
    return ev.sliding(table(s, d, "events"), "1 hour", "30 minutes")


@query("session_counts", "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k")
def _(s, d):
    return ev.sessions(table(s, d, "events"), "30 minutes")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return ev.run_available(s, f"{d}/events.parquet", lambda e: ev.tumbling(e.withWatermark("ts", "1 day"), "1 hour"), "complete")


@query("overlay_view", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0")
def _(s, d):
    base = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    layer = base.where("c_nationkey = 3 AND c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0))
    return ev.overlay(base, layer, base.where("c_nationkey = 3").select("c_nationkey").distinct(), "c_nationkey").select("c_custkey", "c_acctbal")
