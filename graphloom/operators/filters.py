"""Scans and predicates over nodes and edges."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Graph, rank

LANGUAGE_ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "rs": "rust"}
FIELDS = {"kind", "flavor", "lang", "language", "path", "repo", "project", "name"}
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|_test\.[a-z]+$|(^|/)test_[^/]*$|\.(test|spec)\.[a-z]+$"
FIXTURE_PATH = r"(^|/)(testdata|fixtures?|__fixtures__|golden)(/|$)"
DEFINITION_KINDS = ("function", "method", "type", "interface", "constant", "variable", "macro")


def by_kinds(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Rows of the kinds asked for; an empty set is an error, as a scan of everything is never meant."""
    if not kinds:
        raise ValueError("name at least one kind")
    return edges.where(F.col("kind").isin(*dict.fromkeys(kinds)))


def parse_kinds(text: str, known: Sequence[str]) -> list[str]:
    """A comma-separated list of kinds: trimmed, lower-cased, without blanks and repeats; an unknown kind is an error."""
    out = list(dict.fromkeys(x for x in (p.strip().lower() for p in text.split(",")) if x))
    if bad := [x for x in out if x not in known]:
        raise ValueError(f"unknown kinds: {', '.join(bad)}")
    return out


def lookup_ids(nodes: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Nodes of a literal list of ids; missing ones are absent, repeated ones count once."""
    return nodes.where(F.col("id").isin(*set(ids)))


def after_key(rows: DataFrame, key: str, after: str, high: str, limit: int) -> DataFrame:
    """The page of rows behind a key, up to a high-water mark."""
    return rows.where((F.col(key) > after) & (F.col(key) <= high)).orderBy(key).limit(limit)


def name_contains(nodes: DataFrame, text: str) -> DataFrame:
    """Case-insensitive and literal: no wildcard has a meaning."""
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower())))


def folded_name(nodes: DataFrame, text: str) -> DataFrame:
    """Names equal under Unicode case folding."""
    return nodes.where(F.collate("name", "UTF8_LCASE") == F.collate(F.lit(text), "UTF8_LCASE"))


def parse_fields(text: str) -> tuple[dict[str, str], str]:
    """``field:value`` clauses and the rest; the last repeat wins, and what isn't a known field with a value stays text."""
    found, rest = {}, []
    for token in text.split():
        m = re.fullmatch(r"(\w+):(?!:)(.+)", token)
        if m and m[1].lower() in FIELDS:
            found["lang" if m[1].lower() == "language" else m[1].lower()] = m[2]
        else:
            rest.append(token)
    return found, " ".join(rest)


def field_filter(fields: dict[str, str]) -> Column:
    """All clauses at once; kind is a list, path a prefix, name contained in any case."""
    out = F.lit(True)
    for field, value in fields.items():
        if field == "kind":
            out &= F.col("kind").isin(*[v.strip() for v in value.split(",")])
        elif field == "lang":
            out &= F.lower("language") == LANGUAGE_ALIASES.get(value.lower(), value.lower())
        elif field == "path":
            out &= F.startswith(F.col("file_path"), F.lit(value))
        elif field == "repo":
            out &= F.col("repo_prefix") == value
        elif field == "name":
            out &= F.contains(F.lower("name"), F.lit(value.lower()))
        elif field == "flavor":
            out &= F.lower(F.coalesce("flavor", F.lit(""))) == value.lower()
        elif field == "project":
            out &= F.col("project_id") == value
    return out


def search_fields(nodes: DataFrame, text: str) -> tuple[DataFrame, bool]:
    """Nodes by clauses and text; if the clauses leave nothing, by text alone, and True."""
    fields, rest = parse_fields(text)
    named = name_contains(nodes, rest) if rest else nodes
    strict = named.where(field_filter(fields))
    if fields and strict.isEmpty():
        return named, True
    return strict, False


def in_scope(column: Column, allowed: Sequence[str] | None) -> Column:
    """None: everything; an empty list: nothing."""
    return F.lit(True) if allowed is None else column.isin(*allowed) if allowed else F.lit(False)


def glob(pattern: str) -> str:
    """A path pattern as a regular expression: ``*`` stays in a segment, ``**`` crosses segments."""
    out = ""
    for piece in re.findall(r"\*\*/?|\*|\?|[^*?]+", pattern):
        out += {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece))
    return f"^{out}$"


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def min_tier(edges: DataFrame, origin: str) -> DataFrame:
    """Edges of that origin or a better one; the empty origin passes everything."""
    least = rank(F.lit(origin)) if origin else F.lit(0)
    return edges.where(rank(F.col("origin")) >= least)


def tier_caveat(edges: DataFrame, origin: str) -> DataFrame:
    """One row: edges kept, edges below the tier, and the best rank among those."""
    level = rank(F.col("origin"))
    below = level < rank(F.lit(origin))
    return edges.agg(F.count_if(~below).alias("kept"), F.count_if(below).alias("below"), F.max(F.when(below, level)).alias("best_below"))


def suppress_text(edges: DataFrame) -> DataFrame:
    """Drops text matches to a target that better evidence also reaches; edges without an origin stay.

    Targets with better evidence are combined before they move, and of the edges only text matches do.
    """
    text = F.col("origin") == "text_matched"
    better = edges.where(rank(F.col("origin")) > rank(F.lit("text_matched"))).select("dst").distinct()
    return edges.where(~text | F.col("origin").isNull()).unionByName(edges.where(text).join(better, "dst", "left_anti").select(*edges.columns))


def scope_graph(graph: Graph, keep: Column) -> Graph:
    """The nodes that pass, and the edges with both ends among them."""
    nodes = graph.nodes.where(keep)
    ids = nodes.select("id")
    edges = graph.edges.join(ids, graph.edges["src"] == ids["id"], "left_semi").join(ids, graph.edges["dst"] == ids["id"], "left_semi")
    return Graph(nodes, edges)


CONTENT_KINDS = ("doc", "section", "artifact", "asset")


def content(nodes: DataFrame, wanted: bool, kinds: Sequence[str] = CONTENT_KINDS) -> DataFrame:
    """Nodes that hold content, or those that don't."""
    inside = F.col("kind").isin(*kinds)
    return nodes.where(inside if wanted else ~inside)


def walkable(edges: DataFrame) -> DataFrame:
    """Edges whose target was resolved inside."""
    return edges.where(~F.startswith("dst", F.lit("unresolved::")) & ~F.startswith("dst", F.lit("external::")))


def under(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes below a path, which may begin with the name of their repository."""
    inside = F.when(F.startswith(F.lit(prefix), F.concat("repo_prefix", F.lit("/"))), F.substring(F.lit(prefix), F.length("repo_prefix") + 2, F.lit(len(prefix)))).otherwise(F.lit(prefix))
    return nodes.where(F.startswith("file_path", inside))


def speculative(edges: DataFrame, wanted: bool) -> DataFrame:
    """Speculative edges only come when asked for; an edge without origin isn't one."""
    return edges if wanted else edges.where(F.coalesce("origin", F.lit("")) != "speculative")


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with neither end among nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def node_pattern(text: str) -> Column:
    """``name:`` contained in any case, ``exact:``, ``kind:``, ``path:`` a prefix; all of them, and an empty pattern fits nothing."""
    fits = {
        "name": lambda v: F.contains(F.lower("name"), F.lit(v.lower())), "exact": lambda v: F.col("name") == v,
        "kind": lambda v: F.col("kind").isin(*v.split(",")), "path": lambda v: F.startswith("file_path", F.lit(v)),
    }
    parts = [p.partition(":") for p in text.split()]
    if not parts:
        return F.lit(False)
    if bad := [k for k, _, v in parts if k not in fits or not v]:
        raise ValueError(f"unknown or empty: {', '.join(bad)}")
    out = F.lit(True)
    for k, _, v in parts:
        out &= fits[k](v)
    return out


def may_be_dead(nodes: DataFrame, kinds: Sequence[str], exported: str, entries: str) -> DataFrame:
    """Nodes that could be dead code: not of these kinds, not exported, not an entry point."""
    return nodes.where(~F.col("kind").isin(*kinds) & ~F.col("name").rlike(exported) & ~F.col("name").rlike(entries))


def join_list(nodes: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Nodes of a list of ids given as one array parameter."""
    given = nodes.sparkSession.range(1).select(F.explode(F.array_distinct(F.array(*map(F.lit, ids)))).alias("id"))
    return nodes.join(given, "id")
