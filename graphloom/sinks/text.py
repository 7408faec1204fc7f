"""Sinks and encodings: graph scripts as lines of text, hashes, pages, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import Graph


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cypher(graph: Graph) -> DataFrame:
    """One CREATE a node, one MATCH ... CREATE an edge; edges without both ends are left out."""
    ids = graph.nodes.select("id")
    nodes = graph.nodes.select(F.concat(F.lit("CREATE (:"), "kind", F.lit(" {id: "), _quoted(F.col("id")), F.lit(", name: "), _quoted(F.col("name")), F.lit("})")).alias("line"))
    whole = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = whole.select(F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("src")), F.lit("}), (b {id: "), _quoted(F.col("dst")), F.lit("}) CREATE (a)-[:"), "kind", F.lit("]->(b)")).alias("line"))
    return nodes.unionByName(edges)


def graphml(graph: Graph) -> DataFrame:
    """The elements of nodes and edges, escaped; :func:`write_graphml` puts them between head and foot."""
    nodes = graph.nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="name">'), _xml(F.col("name")), F.lit("</data></node>")).alias("line"))
    edges = graph.edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="kind">'), _xml(F.col("kind")), F.lit("</data></edge>")).alias("line"))
    return nodes.unionByName(edges)


def mermaid(graph: Graph, scope: str, unit: str = "repo_prefix") -> DataFrame:
    """Arrows between units of the graph with their counts; an unknown scope is an error."""
    if scope not in ("architecture", "communities", "processes", "all"):
        raise ValueError(f"unknown scope {scope}")
    a, b = (graph.nodes.select(F.col("id").alias(x), F.translate(unit, "-", "_").alias(f"u_{x}")) for x in ("src", "dst"))
    n = graph.edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy("u_src", "u_dst").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit("  "), "u_src", F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), "u_dst").alias("line"))


def ddl(columns: DataFrame) -> DataFrame:
    """(table_name, ddl) of (table_name, column_name, data_type, position)."""
    rows = columns.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("position", F.concat_ws(" ", "column_name", "data_type").alias("c")))).alias("cs"))
    return rows.select("table_name", F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n  "), F.array_join("cs.c", ",\n  "), F.lit("\n);")).alias("ddl"))


def etag(rows: DataFrame) -> str:
    """A hash of a result that doesn't depend on the order of its rows; one pass, one number a partition."""
    r = rows.select(F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    import hashlib

    return hashlib.sha256(f"{rows.columns}|{r[0]}|{r[1]}".encode()).hexdigest()


def page_after(rows: DataFrame, score: float, key: str, limit: int) -> DataFrame:
    """The page behind a cursor (score, id), best first."""
    return rows.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("id") > key))).orderBy(F.desc("score"), "id").limit(limit)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def compact(rows: DataFrame) -> DataFrame:
    """Rows as tab-separated lines after one line of column names, for wire formats."""
    cols = [F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")) for c in rows.columns]
    return rows.select(F.concat_ws("\t", *cols).alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def toon(rows: DataFrame, order: list[str], budget: int) -> DataFrame:
    """(line): comma-separated rows in an order while the running tokens (four characters each) fit the budget; quotes where needed."""
    from ..plans.durable import ranked

    def cell(c: str) -> Column:
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(t.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)

    lines = ranked(rows, order, "__at").select("__at", F.concat_ws(",", *[cell(c) for c in rows.columns]).alias("line")).orderBy("__at").limit(budget)
    spent = F.sum(F.ceil((F.length("line") + 1) / 4)).over(Window.orderBy("__at"))
    return lines.withColumn("__spent", spent).where(F.col("__spent") <= budget).select("line")


def flow_chart(steps: DataFrame) -> DataFrame:
    """(function, chart): a control flow (function, src, dst, label) as Mermaid text."""
    label = F.when(F.col("label") != "", F.concat(F.lit("|"), "label", F.lit("|"))).otherwise(F.lit(""))
    line = F.concat(F.lit("  "), "src", F.lit(" -->"), label, F.lit(" "), "dst")
    return steps.groupBy("function").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("chart"))


def etag_row(rows: DataFrame) -> DataFrame:
    """(rows, tag): the count of a result and a hash that doesn't depend on the order of its rows."""
    text = F.md5(F.to_json(F.struct(*sorted(rows.columns))))
    return rows.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(text, 1, 8), 16, 10).cast("long")).alias("tag"))
