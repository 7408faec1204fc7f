"""The property graph: two DataFrames, and the lattice of edge provenance."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust in an edge by origin; what isn't listed ranks 0.
RANK = {"lsp_resolved": 6, "lsp_dispatch": 5, "ast_resolved": 4, "ast_inferred": 3, "text_matched": 2, "speculative": 1}
#: Weight of an edge in rankings; the most common sure origin weighs most, those of a language server less.
WEIGHT = {"ast_resolved": 1.0, "ast_inferred": 0.7, "lsp_resolved": 0.5, "lsp_dispatch": 0.5, "text_matched": 0.3, "speculative": 0.3}
USE_KINDS = ["calls", "references"]
DEPENDENCY_KINDS = ["imports", "calls", "references", "depends_on"]


@dataclass
class Graph:
    """nodes(id, kind, name, file_path, start_line, end_line, language, repo_prefix), edges(src, dst, kind, file_path, line, origin, confidence); edges are a multigraph."""

    nodes: DataFrame
    edges: DataFrame


def lookup(values: dict[str, float | int], column: Column, default: float | int) -> Column:
    table = F.create_map(*map(F.lit, chain(*values.items())))
    return F.coalesce(table[column], F.lit(default))


def rank(origin: Column) -> Column:
    return lookup(RANK, origin, 0)


def weight(origin: Column) -> Column:
    return F.when(origin.isNull(), F.lit(max(WEIGHT.values()))).otherwise(lookup(WEIGHT, origin, 0.3))
