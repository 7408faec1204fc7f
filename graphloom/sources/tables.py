"""Projections of relational tables onto the graph model; the text of each is valid for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..plans.model import Graph

_ORIGIN = "CASE {0} % 5 WHEN 0 THEN 'lsp_resolved' WHEN 1 THEN 'lsp_dispatch' WHEN 2 THEN 'ast_resolved' WHEN 3 THEN 'ast_inferred' ELSE 'text_matched' END AS origin, ({0} % 5 + 5) / CAST(10.0 AS DOUBLE) AS confidence"

NODES = """
SELECT concat('c', c_custkey) AS id, 'function' AS kind, c_name AS name, concat('src/customer/', lower(c_mktsegment), '.go') AS file_path, c_custkey AS start_line, c_custkey + c_custkey % 40 AS end_line, 'go' AS language, 'shop' AS repo_prefix FROM {customer}
UNION ALL SELECT concat('o', o_orderkey), 'method', concat('order_', o_orderkey), concat('src/orders/', lower(o_orderstatus), '.go'), o_orderkey, o_orderkey + o_orderkey % 40, 'go', 'shop' FROM {orders}
UNION ALL SELECT concat('p', p_partkey), 'type', p_name, concat('src/part/', lower(replace(p_brand, '#', '_')), '.rs'), p_partkey, p_partkey + p_partkey % 40, 'rust', 'supply' FROM {part}
UNION ALL SELECT concat('s', s_suppkey), 'interface', s_name, concat('src/supplier/n', s_nationkey, '.py'), s_suppkey, s_suppkey + s_suppkey % 40, 'python', 'supply' FROM {supplier}
UNION ALL SELECT concat('n', n_nationkey), 'package', n_name, 'src/geo/nation.ts', CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 'typescript', 'geo' FROM {nation}
UNION ALL SELECT concat('r', r_regionkey), 'module', r_name, 'src/geo/region.ts', CAST(r_regionkey AS BIGINT), CAST(r_regionkey AS BIGINT), 'typescript', 'geo' FROM {region}"""

EDGES = f"""
SELECT concat('c', o_custkey) AS src, concat('o', o_orderkey) AS dst, 'calls' AS kind, concat('src/orders/', lower(o_orderstatus), '.go') AS file_path, o_orderkey AS line, {_ORIGIN.format("o_orderkey")} FROM {{orders}}
UNION ALL SELECT concat('o', l_orderkey), concat('p', l_partkey), 'references', 'src/orders/lines.go', CAST(l_linenumber AS BIGINT), {_ORIGIN.format("l_linenumber")} FROM {{lineitem}}
UNION ALL SELECT DISTINCT concat('p', l_partkey), concat('s', l_suppkey), 'depends_on', 'src/part/supply.rs', l_suppkey, {_ORIGIN.format("l_suppkey")} FROM {{lineitem}}
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 'member_of', 'src/customer/geo.go', c_custkey, {_ORIGIN.format("c_custkey")} FROM {{customer}}
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'member_of', 'src/supplier/geo.py', s_suppkey, {_ORIGIN.format("s_suppkey")} FROM {{supplier}}
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'member_of', 'src/geo/nation.ts', CAST(n_nationkey AS BIGINT), {_ORIGIN.format("n_nationkey")} FROM {{nation}}"""

#: Parts on consecutive lines of an order: cyclic, with parallel edges.
BASKET = f"""
SELECT concat('p', a.l_partkey) AS src, concat('p', b.l_partkey) AS dst, 'calls' AS kind, concat('src/', lower(a.l_returnflag), '/', lower(a.l_linestatus), '.rs') AS file_path, CAST(a.l_linenumber AS BIGINT) AS line, {_ORIGIN.format("a.l_linenumber")}
FROM {{lineitem}} a JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""

#: Nations trading with each other; w counts the lines.
TRADE = """
SELECT concat('n', s_nationkey) AS src, concat('n', c_nationkey) AS dst, count(*) AS w
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2"""

#: One row per event with the next event of its user.
JOURNEY = """
SELECT user_id, ts, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events}"""

#: What users do to keys: one edge an event, of five kinds, with a mode.
FACTS = """
SELECT concat('u', user_id) AS src, concat('k', regexp_extract(props, '([0-9]+)', 1)) AS dst,
       CASE event_type WHEN 'view' THEN 'reads_config' WHEN 'click' THEN 'writes' WHEN 'error' THEN 'throws' WHEN 'signup' THEN 'spawns' ELSE 'annotated' END AS kind,
       CASE event_id % 3 WHEN 0 THEN 'thread' WHEN 1 THEN 'task' ELSE 'process' END AS mode, concat('svc/u', user_id % 7, '.go') AS file_path, event_id AS line, ts
FROM {events}"""

TEXTS = {"nodes": NODES, "edges": EDGES, "basket": BASKET, "trade": TRADE, "journey": JOURNEY, "facts": FACTS}

#: What Spark reads instead of a text: the same rows, told apart by their keys before they are written out.
LEAN = {"edges": EDGES.replace("SELECT DISTINCT concat", "SELECT concat")}
LEAN["edges"] = re.sub(r"(l_suppkey % 5 \+ 5[^\n]*) FROM \{lineitem\}", r"\1 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem})", LEAN["edges"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = LEAN.get(name, TEXTS[name])
    used = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **used)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers call orders, which reference parts, which depend on suppliers; nations and regions on top."""
    return Graph(projection(spark, sf_dir, "nodes"), projection(spark, sf_dir, "edges"))


def duck(body: str) -> str:
    """SQL for DuckDB: the projections that ``body`` names, as common table expressions before it."""
    named = [n for n in TEXTS if re.search(rf"\b{n}\b", body)]
    ctes = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', TEXTS[n])})" for n in named]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[len("WITH RECURSIVE") :].strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:].strip()])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
