"""The pipeline language: ``nodes <filters> | traverse <kinds> [in|out|both] | filter <filters>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import field_filter, name_contains, parse_fields
from ..operators.traverse import oriented
from .model import Graph

MOST_STAGES = 5
KINDS = ("calls", "references", "defines", "contains", "member_of", "imports", "re_exports", "implements", "extends", "overrides", "composes", "aliases", "instantiates", "typed_as", "returns", "param_of", "captures", "reads", "writes", "accesses_field", "value_flow", "arg_of", "returns_to", "spawns", "sends", "recvs", "throws", "tests", "covered_by", "similar_to", "co_change", "provides", "consumes", "matches", "bridges", "handles_route", "emits", "listens_on", "queries", "reads_config", "uses_env", "depends_on", "annotated", "owns", "licensed_as", "motivates")


class QueryError(ValueError):
    """A pipeline that can't be read; the message names the stage."""


def parse(text: str) -> list[tuple[str, object]]:
    """Stages as (name, argument); everything wrong is an error before anything runs."""
    stages = [p.strip() for p in text.split("|")]
    if not text.strip():
        raise QueryError("the query is empty")
    if len(stages) > MOST_STAGES:
        raise QueryError(f"{len(stages)} stages; at most {MOST_STAGES} are allowed")
    out: list[tuple[str, object]] = []
    for i, stage in enumerate(stages):
        if not stage:
            raise QueryError(f"stage {i + 1} is empty")
        name, _, rest = stage.partition(" ")
        if (i == 0) != (name == "nodes"):
            raise QueryError("a query begins with nodes, once" if i == 0 else f"stage {i + 1}: nodes only begins a query")
        if name in ("nodes", "filter"):
            fields, words = parse_fields(rest)
            if name == "filter" and not fields and not words:
                raise QueryError(f"stage {i + 1}: filter what?")
            out.append((name, (fields, words)))
        elif name == "traverse":
            args = rest.split()
            if not args:
                raise QueryError(f"stage {i + 1}: traverse which kinds?")
            way = args[1] if len(args) > 1 else "out"
            if way not in ("in", "out", "both") or len(args) > 2:
                raise QueryError(f"stage {i + 1}: a direction is in, out or both")
            kinds = [k.strip().lower() for k in args[0].split(",") if k.strip()]
            if bad := [k for k in kinds if k not in KINDS]:
                raise QueryError(f"stage {i + 1}: unknown edge kind {bad[0]}")
            out.append((name, (kinds, way)))
        else:
            raise QueryError(f"stage {i + 1}: unknown stage {name}")
    return out


def run(graph: Graph, text: str) -> DataFrame:
    """The nodes that a pipeline ends with; a traversal replaces the set by its neighbours."""
    nodes = graph.nodes
    for name, arg in parse(text):
        if name in ("nodes", "filter"):
            fields, words = arg
            nodes = nodes.where(field_filter(fields))
            nodes = name_contains(nodes, words) if words else nodes
        else:
            kinds, way = arg
            steps = oriented(graph.edges, way, kinds).join(nodes.select(F.col("id").alias("here")), "here", "left_semi")
            nodes = graph.nodes.join(steps.select(F.col("there").alias("id")), "id", "left_semi")
    return nodes
