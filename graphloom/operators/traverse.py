"""Bounded traversals: each hop is a join of the frontier with the edges, each visited node is joined out once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import durable, small
from ..plans.model import Graph


def oriented(edges: DataFrame, direction: str, kinds: Sequence[str]) -> DataFrame:
    """(here, there, kind): where a step leads."""
    mine = edges.where(F.col("kind").isin(*kinds)) if kinds else edges.where(F.lit(False))
    out = mine.select(F.col("src").alias("here"), F.col("dst").alias("there"), "kind")
    back = mine.select(F.col("dst").alias("here"), F.col("src").alias("there"), "kind")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, direction: str = "out", kinds: Sequence[str] = ("calls",), depth: int | None = 3, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth, parent, edge_kind): the shortest way to each node, ties to the smallest parent, then kind; seeds at depth 0.

    Without ``depth`` hops go on until nothing is new.  The steps are written once; each hop sends out its measured frontier
    where that is small, so edges aren't shuffled, and joins by key where it isn't.
    """
    steps = oriented(edges, direction, kinds)
    if depth is None or depth > 1:
        steps = durable(steps, "steps")
    start = seeds.select(F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("edge_kind")).distinct()
    visited = frontier = durable(start, "bfs")
    n, level = frontier.count(), 0
    while n and (depth is None or level < depth):
        level += 1
        hop = steps.join(small(frontier.select(F.col("node").alias("here")), n), "here").groupBy(F.col("there").alias("node")).agg(F.min(F.struct(F.col("here").alias("parent"), F.col("kind").alias("edge_kind"))).alias("way"))
        fresh = hop.join(visited.select("node"), "node", "left_anti")
        if nodes is not None:
            fresh = fresh.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
        frontier = durable(fresh.select("node", F.lit(level).alias("depth"), "way.parent", "way.edge_kind"), "bfs")
        n = frontier.count()
        if n:
            visited = visited.unionByName(frontier)
    return visited


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "out", kinds: Sequence[str] = ("calls",)) -> DataFrame:
    """The nodes that any number of steps reach, seeds included."""
    return bfs(edges, seeds, direction, kinds, None).select("node")


def closure(edges: DataFrame, seeds: DataFrame, kinds: Sequence[str], depth: int = 6, most: int | None = None) -> DataFrame:
    """(node, distance) to the nearest seed; with ``most`` nodes are admitted in the order of distance and id."""
    found = bfs(edges.where(~F.col("dst").rlike("^(unresolved|external)::")), seeds, "out", kinds, depth).select("node", F.col("depth").alias("distance"))
    return found if most is None else found.orderBy("distance", "node").limit(most)


def paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame | None, kinds: Sequence[str], depth: int) -> DataFrame:
    """(source, sink, length, path): all simple paths of at most ``depth`` steps, a node being the way to itself.

    Only steps within reach of the sources are told apart and written.  With sinks a path only goes on to nodes from which
    a sink can still be reached in the steps left.
    """
    ahead = bfs(edges, sources, "out", kinds, max(depth - 1, 0)).select(F.col("node").alias("here"))
    steps = edges.where(F.col("kind").isin(*kinds)).select(F.col("src").alias("here"), F.col("dst").alias("there"))
    steps = durable(steps.join(small(ahead, ahead.count()), "here", "left_semi").distinct(), "steps")
    left = None
    if sinks is not None:
        back = steps.select(F.col("here").alias("src"), F.col("there").alias("dst"), F.lit("step").alias("kind"))
        left = durable(bfs(back, sinks, "in", ["step"], depth).select(F.col("node").alias("here"), F.col("depth").alias("need")), "need")
    level = sources.select(F.col("id").alias("source"), F.col("id").alias("here"), F.array("id").alias("path"))
    if left is not None:
        level = level.join(left, "here", "left_semi").select("source", "here", "path")
    found = [level]
    for k in range(1, depth + 1):
        level = level.join(steps, "here").where(~F.array_contains("path", F.col("there"))).select("source", F.col("there").alias("here"), F.array_append("path", F.col("there")).alias("path"))
        if left is not None:
            level = level.join(left.where(F.col("need") <= depth - k), "here", "left_semi").select("source", "here", "path")
        level = durable(level, "paths")
        found.append(level)
        if level.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found).select("source", F.col("here").alias("sink"), (F.size("path") - 1).alias("length"), "path")
    return out if sinks is None else out.join(sinks.select(F.col("id").alias("sink")), "sink", "left_semi").select(*out.columns)


def hierarchy(edges: DataFrame, seeds: DataFrame, kinds: Sequence[str], up: bool = True, depth: int | None = None) -> DataFrame:
    """(seed, node, path, edge_kinds): the chain of each seed through a hierarchy, every ancestor (or heir) once, by its first way; to its end without ``depth``."""
    steps = oriented(edges, "out" if up else "in", kinds).distinct()
    level = seeds.select(F.col("id").alias("seed"), F.col("id").alias("here"), F.array("id").alias("path"), F.array().cast("array<string>").alias("kinds"))
    seen, found = level.select("seed", F.col("here").alias("node")), []
    while depth is None or len(found) < depth:
        hop = level.join(steps, "here").groupBy("seed", F.col("there").alias("node")).agg(F.min(F.struct(F.array_append("path", F.col("there")).alias("path"), F.array_append("kinds", F.col("kind")).alias("kinds"))).alias("way"))
        hop = durable(hop.join(seen, ["seed", "node"], "left_anti").select("seed", "node", "way.path", "way.kinds"), "hierarchy")
        if hop.isEmpty():
            break
        found.append(hop)
        seen = seen.unionByName(hop.select("seed", "node"))
        level = hop.withColumnRenamed("node", "here")
    if not found:
        return level.limit(0).select("seed", F.col("here").alias("node"), "path", F.col("kinds").alias("edge_kinds"))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("kinds", "edge_kinds")


def call_ancestors(edges: DataFrame, targets: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The edges into the inverse closure of the targets, repeated ones kept for fan-in."""
    inside = reachable(edges, targets, "in", kinds)
    mine = edges.where(F.col("kind").isin(*kinds))
    return mine.join(inside.select(F.col("node").alias("dst")), "dst", "left_semi")


def dispatching(edges: DataFrame, least_rank: int = 0) -> DataFrame:
    """Calls, and steps from an overridden method to those that override it."""
    from ..plans.model import rank

    calls = edges.where(F.col("kind") == "calls")
    over = edges.where((F.col("kind") == "overrides") & (rank(F.col("origin")) >= least_rank))
    flipped = over.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return calls.unionByName(flipped)


def completion(edges: DataFrame, seeds: DataFrame, per_seed: int = 8, limit: int | None = None) -> DataFrame:
    """Seeds, and up to ``per_seed`` new neighbours of each; a seed stays a seed. (id, seed, position)."""
    near = edges.select("src", "dst").distinct().join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    new = near.join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    placed = new.withColumn("position", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("position") <= per_seed)
    first = placed.groupBy("dst").agg(F.min(F.struct(F.col("src").alias("seed"), "position")).alias("by"))
    out = seeds.select("id", F.col("id").alias("seed"), F.lit(0).alias("position")).unionByName(first.select(F.col("dst").alias("id"), "by.seed", "by.position"))
    return out if limit is None else out.orderBy("position", "seed", "id").limit(limit)


def budgeted(found: DataFrame, tokens: str, budget: int) -> DataFrame:
    """Nodes in the order of a traversal (depth, node) while their tokens fit the budget; the order is total, the set that a walk returns is small."""
    run = Window.orderBy("depth", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("spent", F.sum(tokens).over(run)).where(F.col("spent") <= budget)


def processes(edges: DataFrame, entries: DataFrame, kinds: Sequence[str], depth: int, most: int) -> DataFrame:
    """(process, node, depth, steps, truncated): what each entry (id) reaches in ``depth`` steps, at least one; ``steps`` counts all of it, and
    of more than ``most`` the nearest are returned and the reason told."""
    steps = durable(oriented(edges, "out", kinds), "steps")
    level = entries.select(F.col("id").alias("process"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    seen = level = durable(level, "process")
    for k in range(1, depth + 1):
        hop = level.join(steps.withColumnRenamed("here", "node"), "node").select("process", F.col("there").alias("node")).distinct()
        level = durable(hop.join(seen.select("process", "node"), ["process", "node"], "left_anti").withColumn("depth", F.lit(k)), "process")
        seen = seen.unionByName(level)
    total = seen.groupBy("process").agg(F.count("*").alias("steps")).where("steps >= 2")
    order = Window.partitionBy("process").orderBy("depth", "node")
    kept = seen.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k")
    return kept.join(total, "process").withColumn("truncated", F.when(F.col("steps") > most, "steps").otherwise(""))


def stamped(edges: DataFrame, roots: DataFrame, label: str, kinds: Sequence[str]) -> DataFrame:
    """(id, label): the roots' labels, and what all below them inherit."""
    steps = durable(oriented(edges, "in", kinds), "steps")
    seen = level = durable(roots.select("id", label).distinct(), "stamped")
    while not level.isEmpty():
        hop = level.join(steps.withColumnRenamed("here", "id"), "id").select(F.col("there").alias("id"), label).distinct()
        level = durable(hop.join(seen, ["id", label], "left_anti"), "stamped")
        seen = seen.unionByName(level)
    return seen


def into_few(edges: DataFrame, few: DataFrame) -> DataFrame:
    """(src, id): edges into few nodes (id), which go out to the edges once their number is known."""
    few = durable(few, "few")
    return edges.select("src", F.col("dst").alias("id")).join(small(few, few.count()), "id")


DEPENDENCIES = ("imports", "calls", "references", "depends_on")


def dependencies(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """What seeds depend on, or with ``in`` what depends on them, over the kinds that are dependencies."""
    return bfs(edges, seeds, direction, DEPENDENCIES, depth)


def inside_communities(edges: DataFrame, communities: DataFrame, structural: Sequence[str]) -> DataFrame:
    """Edges within a community (id, community), and those of structural kinds."""
    free = edges.where(F.col("kind").isin(*structural))
    bound = edges.where(~F.col("kind").isin(*structural))
    a, b = communities.toDF("src", "__a"), communities.toDF("dst", "__b")
    return free.unionByName(bound.join(a, "src").join(b, "dst").where("__a = __b").select(*edges.columns))


def traced(edges: DataFrame, sources: DataFrame, sinks: DataFrame, kinds: Sequence[str], depth: int) -> DataFrame:
    """:func:`paths` with the product of their steps' confidences, the best of parallel edges counting."""
    found = paths(edges, sources, sinks, kinds, depth).withColumn("__id", F.monotonically_increasing_id())
    found = durable(found, "traced")
    best = edges.where(F.col("kind").isin(*kinds)).groupBy("src", "dst").agg(F.max("confidence").alias("c"))
    steps = found.select("__id", F.posexplode(F.slice("path", 1, 1_000_000)).alias("k", "src"), "path").where(F.col("k") < F.size("path") - 1)
    each = steps.select("__id", "src", F.get("path", F.col("k") + 1).alias("dst")).join(best, ["src", "dst"])
    product = each.groupBy("__id").agg(F.exp(F.sum(F.log("c"))).alias("confidence"))
    return found.join(product, "__id", "left").drop("__id")


def gap(edges: DataFrame, sources: DataFrame, sinks: DataFrame, kinds: Sequence[str], depth: int) -> DataFrame:
    """(forward, backward, furthest, nearest, reason), one row for sources and sinks that no path joins: how far each side gets."""
    ahead, back = bfs(edges, sources, "out", kinds, depth), bfs(edges, sinks, "in", kinds, depth)
    met = ahead.join(back.select("node"), "node", "left_semi").agg((F.count("*") > 0).alias("met"))
    f = ahead.agg(F.count("*").alias("forward"), F.max("depth").alias("furthest"))
    b = back.agg(F.count("*").alias("backward"), F.max("depth").alias("nearest"))
    reason = F.when(F.col("met"), "connected").when(F.col("furthest") == 0, "no_way_out").when(F.col("nearest") == 0, "no_way_in").otherwise("apart")
    return f.join(F.broadcast(b)).join(F.broadcast(met)).withColumn("reason", reason).drop("met")  # one row each


def tainted(graph: Graph, source: Column, sink: Column, kinds: Sequence[str], depth: int) -> DataFrame:
    """:func:`paths` from nodes that fit one pattern to those of another; ``place`` ranks those of a sink, shortest first."""
    found = paths(graph.edges, graph.nodes.where(source).select("id"), graph.nodes.where(sink).select("id"), kinds, depth).where("length > 0")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("sink").orderBy("length", F.array_join("path", ">"))))


def by_site(uses: DataFrame) -> DataFrame:
    """One row a call site of uses (…, sites); a use without sites stays one row."""
    return uses.withColumn("line", F.explode_outer("sites")).drop("sites")


def bounded(edges: DataFrame, seeds: DataFrame, kinds: Sequence[str], depth: int = 2, most: int = 4096) -> DataFrame:
    """(node, depth, truncated): the nearest ``most`` nodes both ways, and whether there were more."""
    found = bfs(edges, seeds, "both", kinds, depth).select("node", "depth")
    n = found.count()
    return found.orderBy("depth", "node").limit(most).withColumn("truncated", F.lit(n > most))


def paged(found: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of each depth of (node, depth)."""
    k = F.row_number().over(Window.partitionBy("depth").orderBy("node"))
    return found.withColumn("__k", k).where((F.col("__k") > offset) & (F.col("__k") <= offset + limit)).drop("__k")


def import_path(nodes: DataFrame, language: str) -> DataFrame:
    """(name, path): the shortest path that defines a name in a language."""
    return nodes.where(F.col("language") == language).groupBy("name").agg(F.min_by("file_path", F.struct(F.length("file_path"), "file_path")).alias("path"))


def terminal(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(id, terminal): where the chain of each node's only edge (of several the one to the least) ends; its length doubles each round.

    A chain that runs into a ring has no end: those nodes end where they stand after as many steps as there are nodes.
    """
    out = durable(edges.where(F.col("kind").isin(*kinds)).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("terminal")), "terminal")
    steps, most = 1, out.count()
    while steps <= most:
        ahead = out.select(F.col("id").alias("terminal"), F.col("terminal").alias("next"))
        joined = durable(out.join(ahead, "terminal", "left").select("id", F.coalesce("next", "terminal").alias("terminal"), F.col("next").isNotNull().alias("moved")), "terminal")
        if joined.where("moved").isEmpty():
            break
        out, steps = joined.select("id", "terminal"), steps * 2
    return out
