"""Whole-graph analytics as iterated joins; every step's state is a table in the shared folder."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import BROADCAST_ROWS, durable, fixpoint, small


def outgoing(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """(src, dst, w): parallel edges summed once, before any iteration."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return edges.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(ids: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 40, seeds: DataFrame | None = None) -> DataFrame:
    """(id, score) of weighted PageRank over ``edges`` (src, dst, w); the mass of nodes without edges is spread evenly.

    With ``seeds`` (id) the walk restarts there, and nodes that it can't reach have score 0.
    """
    n = ids.count()
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    share = durable(edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "pagerank-edges")
    home = ids.select("id", F.lit(1.0 / max(n, 1)).alias("home"))
    if seeds is not None:
        k = max(seeds.distinct().count(), 1)
        home = ids.join(seeds.select("id", F.lit(1.0 / k).alias("home")).distinct(), "id", "left").fillna(0.0, ["home"])
    home = durable(home.join(total.select(F.col("src").alias("id"), F.lit(True).alias("flows")), "id", "left"), "pagerank-home")
    state = home.select("id", F.col("home").alias("score"))
    loose = not home.where("flows is null").isEmpty()
    for k in range(rounds):
        inflow = share.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("inflow"))
        both = home.join(inflow, "id", "left")
        if loose:  # the mass of nodes without edges: one row, joined to every node
            both = both.join(F.broadcast(state.join(home.where("flows is null"), "id", "left_semi").agg(F.sum("score").alias("loose"))))
        mass = F.coalesce("loose", F.lit(0.0)) if loose else F.lit(0.0)
        state = both.select("id", (F.lit(damping) * (F.coalesce("inflow", F.lit(0.0)) + mass * F.col("home")) + F.lit(1 - damping) * F.col("home")).alias("score"))
        if loose or k % 5 == 4:
            state = durable(state, "pagerank")
    return state


def hits(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, authority, hub) over weighted edges; hubs follow the new authorities, both have length 1."""
    edges = durable(edges, "hits-edges")
    hub = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("hub", F.lit(1.0))
    authority = hub

    def unit(rows: DataFrame, name: str) -> DataFrame:
        rows = durable(rows, "hits")
        length = (rows.agg(F.sum(F.col(name) * F.col(name))).first()[0] or 0.0) ** 0.5
        return rows.withColumn(name, F.col(name) / length) if length else rows

    for _ in range(rounds):
        authority = unit(edges.join(hub.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("hub")).alias("authority")), "authority")
        hub = unit(edges.join(authority.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("authority")).alias("hub")), "hub")
    return authority.join(hub, "id", "full").fillna(0.0, ["authority", "hub"])


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without self-loops and repeats."""
    e = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def weak_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable along edges in any direction; star contraction, logarithmic in the diameter."""

    def step(state: DataFrame) -> DataFrame:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = moved.groupBy("a").agg(F.min("b").alias("low"))
        near = moved.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        return near.unionByName(low.select("a", F.col("low").alias("b"))).distinct()

    stars = fixpoint(undirected(edges).where("a > b"), step, name="components")
    return ids.join(stars.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def strong_components(ids: DataFrame, edges: DataFrame, small_edges: int = BROADCAST_ROWS) -> DataFrame:
    """(id, component), by the smallest id of each.

    Nodes without a way in or out are components of their own.  Of the rest the smallest id of a colour's backward reach closes
    a component a colour and round; once at most ``small_edges`` edges are left, one task finishes them.
    """
    left = durable(ids.select("id").distinct(), "scc")
    edge = durable(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    n, done = edge.count(), None
    while not left.isEmpty():
        # Trimming goes on while it takes a tenth of the edges at least: it ends what has no cycles without any colour.
        before = None
        while n > small_edges and n and (before is None or n < 0.9 * before):
            on_both = edge.select(F.col("src").alias("id")).intersect(edge.select(F.col("dst").alias("id")))
            mine = durable(left.join(on_both, "id", "left_semi"), "scc")
            alone = left.join(mine, "id", "left_anti").select("id", F.col("id").alias("component"))
            done = alone if done is None else done.unionByName(alone)
            left = mine
            edge = durable(edge.join(mine.select(F.col("id").alias("src")), "src", "left_semi").join(mine.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc-edges")
            before, n = n, edge.count()
        if n <= small_edges or not n:
            last = _in_one_task(edge, _tarjan, "id string, component string")
            closed = left.join(last, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
            return closed if done is None else done.unionByName(closed)
        # Colour: the smallest id from which a node can be reached.
        colour = _spread(left.select("id", F.col("id").alias("colour")), edge, "src", "dst")
        same = durable(edge.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst"), "scc-edges")
        # Back from the colour's own node, inside the colour.
        back = _spread(colour.select("id", F.when(F.col("id") == F.col("colour"), F.col("colour")).alias("colour")), same, "dst", "src")
        closed = back.where("colour is not null").select("id", F.col("colour").alias("component"))
        done = closed if done is None else done.unionByName(closed)
        left = durable(back.where("colour is null").select("id"), "scc")
        edge = durable(same.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc-edges")
        n = edge.count()
    return done if done is not None else ids.select("id", F.col("id").alias("component"))


def _in_one_task(edge: DataFrame, solve: Callable[[list[tuple[str, str]]], dict[str, object]], schema: str) -> DataFrame:
    """``solve`` over edges whose number was measured to be small, in an executor."""

    def run(frames):
        pairs = [p for f in frames for p in zip(f.iloc[:, 0].tolist(), f.iloc[:, 1].tolist())]
        found = solve(pairs)
        if not found:  # a frame of no rows isn't a batch
            return
        names = [c.split()[0] for c in schema.split(", ")]
        yield pd.DataFrame({names[0]: pd.Series(list(found), dtype=object), names[1]: list(found.values())})

    return edge.coalesce(1).mapInPandas(run, schema)


def _tarjan(pairs: list[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    index, low, held, stack, found = {}, {}, set(), [], {}
    for root in {n for p in pairs for n in p}:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    held.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in held:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                        held.discard(own[-1])
                    least = min(own)
                    found.update(dict.fromkeys(own, least))
    return found


def _spread(state: DataFrame, edge: DataFrame, here: str, there: str) -> DataFrame:
    """(id, colour) when each node has the smallest colour among itself and all before it; a node sends only when its colour has changed."""
    state = durable(state.withColumn("moved", F.col("colour").isNotNull()), "scc-colour")
    while n := state.where("moved").count():
        told = state.where("moved").select(F.col("id").alias(here), "colour")
        sent = edge.join(small(told, n), here).groupBy(F.col(there).alias("id")).agg(F.min("colour").alias("sent"))
        state = durable(state.join(sent, "id", "left").select("id", F.least("colour", "sent").alias("colour"), F.coalesce(F.col("sent") < F.col("colour"), F.col("sent").isNotNull()).alias("moved")), "scc-colour")
    return state.drop("moved")


def k_core(ids: DataFrame, edges: DataFrame, small_edges: int = BROADCAST_ROWS) -> DataFrame:
    """(id, k): the coreness.  Up to ``small_edges`` edges one task peels them; beyond, it is the fixpoint of the h-index of the neighbours' values."""
    near = durable(undirected(edges), "kcore-edges")
    if near.count() <= 2 * small_edges:
        cores = _in_one_task(near, _peeled, "id string, k int")
    else:
        cores = fixpoint(near.groupBy(F.col("a").alias("id")).agg(F.count("*").cast("int").alias("k")), lambda s: _h_index(s, near), name="kcore")
    return ids.join(cores, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k"))


def _h_index(state: DataFrame, near: DataFrame) -> DataFrame:
    seen = near.join(state.select(F.col("id").alias("b"), "k"), "b").groupBy("a", "k").agg(F.count("*").alias("n"))
    run = seen.withColumn("over", F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("k"))))
    h = run.groupBy(F.col("a").alias("id")).agg(F.max(F.least(F.col("k").cast("long"), F.col("over"))).cast("int").alias("h"))
    return state.join(h, "id", "left").select("id", F.least("k", F.coalesce("h", F.lit(0))).alias("k"))


def _peeled(pairs: list[tuple[str, str]]) -> dict[str, int]:
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    degree = {v: len(n) for v, n in near.items()}
    heap, core, k = [(d, v) for v, d in degree.items()], {}, 0
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v in core or d > degree[v]:
            continue
        k = max(k, d)
        core[v] = k
        for w in near[v]:
            if w not in core:
                degree[w] -= 1
                heapq.heappush(heap, (degree[w], w))
    return core


def label_communities(ids: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation with weights; ties to the smallest label, so that reruns agree."""
    w = outgoing(edges.where("src <> dst"), F.col("w"))
    both = durable(w.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(w.select(F.col("dst").alias("a"), F.col("src").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "labels-edges")

    def step(state: DataFrame) -> DataFrame:
        # A node's own label weighs as its heaviest neighbour, which keeps pairs from swapping for ever.
        own = both.groupBy("a").agg(F.max("w").alias("w")).join(state.select(F.col("id").alias("a"), "community"), "a").select("a", "community", "w")
        votes = both.join(state.select(F.col("id").alias("b"), "community"), "b").select("a", "community", "w").unionByName(own).groupBy("a", "community").agg(F.round(F.sum("w"), 9).alias("w"))
        best = votes.groupBy(F.col("a").alias("id")).agg(F.min(F.struct((-F.col("w")).alias("w"), "community"))["community"].alias("best"))
        return state.join(best, "id", "left").select("id", F.coalesce("best", "community").alias("community"))

    return fixpoint(ids.select("id", F.col("id").alias("community")), step, most=rounds, name="labels")


def communities(ids: DataFrame, edges: DataFrame, resolution: float = 1.0, small_edges: int = BROADCAST_ROWS) -> DataFrame:
    """(id, community) by greedy modularity at a resolution: larger ones give more communities; each is connected and named by its least node.

    A graph of more than ``small_edges`` edges is contracted by label propagation first, as often as it takes; one task moves the rest.
    """
    near = durable(outgoing(edges.where("src <> dst"), F.col("w")), "communities")
    placed, rounds = ids.select("id", F.col("id").alias("community")), 0
    loops = near.select("src", "dst", "w").limit(0)
    while near.count() > small_edges:
        nodes = placed.select(F.col("community").alias("id")).distinct()
        labels = durable(label_communities(nodes, near), "communities")
        a, b = labels.toDF("src", "ca"), labels.toDF("dst", "cb")
        joined = durable(near.unionByName(loops).join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("w").alias("w")), "communities")
        placed = durable(placed.join(labels.toDF("community", "up"), "community").select("id", F.col("up").alias("community")), "communities")
        loops, fewer = joined.where("src = dst"), joined.where("src <> dst")
        if fewer.count() == near.count():
            raise ValueError("label propagation doesn't contract this graph any further")
        near, rounds = fewer, rounds + 1
    whole = near.unionByName(loops)

    def run(frames):
        rows = pd.concat([pd.DataFrame(columns=["src", "dst", "w"]), *frames])
        if rows.empty:
            return
        found = _louvain(list(zip(rows.iloc[:, 0], rows.iloc[:, 1], rows.iloc[:, 2].astype(float))), resolution)
        yield pd.DataFrame({"community": pd.Series(list(found), dtype=object), "up": pd.Series(list(found.values()), dtype=object)})

    moved = whole.coalesce(1).mapInPandas(run, "community string, up string")
    final = placed.join(moved, "community", "left").select("id", F.coalesce("up", "community").alias("group"))
    least = final.groupBy("group").agg(F.min("id").alias("community"))
    return final.join(least, "group").select("id", "community")


def _louvain(rows: list[tuple[str, str, float]], resolution: float) -> dict[str, str]:
    """Local moves and contraction until modularity no longer grows; communities that fell apart are split at the end."""
    weight: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in rows:
        weight[a][b] += w
        weight[b][a] += w
    first = {v: dict(n) for v, n in weight.items()}
    of = {v: v for v in weight}
    total = sum(sum(n.values()) for n in weight.values())
    while weight and total:
        degree = {v: sum(n.values()) for v, n in weight.items()}
        label, held, changed = {v: v for v in weight}, dict(degree), False
        for _ in range(100):
            still = True
            for v in sorted(weight):
                links: dict[str, float] = defaultdict(float)
                for u, w in weight[v].items():
                    if u != v:
                        links[label[u]] += w
                own = label[v]
                held[own] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - resolution * degree[v] * held[c] / total  # noqa: B023, E731
                best = min(sorted({own, *links}), key=lambda c: (-round(gain(c), 9), c != own, c))
                held[best] += degree[v]
                if best != own:
                    label[v], still, changed = best, False, True
            if still:
                break
        of = {v: label[c] for v, c in of.items()}
        if not changed:
            break
        fewer: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for v, near in weight.items():
            for u, w in near.items():
                fewer[label[v]][label[u]] += w
        weight = fewer
    out: dict[str, str] = {}
    for v in sorted(of):
        if v not in out:
            stack, own = [v], {v}
            while stack:
                for u in first[stack.pop()]:
                    if u not in own and of[u] == of[v]:
                        own.add(u)
                        stack.append(u)
            out.update(dict.fromkeys(own, v))
    return out


def spectral(ids: DataFrame, edges: DataFrame, least: int = 6, small_edges: int = BROADCAST_ROWS) -> DataFrame:
    """(id, cluster) by halving at the Fiedler vector while modularity grows; groups of fewer than ``least`` nodes stay whole.

    One task solves it; graphs of more than ``small_edges`` edges are an error, contract them with :func:`communities` first.
    """
    near = durable(outgoing(edges.where("src <> dst"), F.col("w")), "spectral")
    if near.count() > small_edges:
        raise ValueError("contract the graph first")

    def run(frames):
        import numpy as np

        rows = pd.concat([pd.DataFrame(columns=["src", "dst", "w"]), *frames])
        if rows.empty:
            return
        names = sorted({*rows.iloc[:, 0], *rows.iloc[:, 1]})
        at = {v: i for i, v in enumerate(names)}
        w = np.zeros((len(names), len(names)))
        for a, b, v in zip(rows.iloc[:, 0], rows.iloc[:, 1], rows.iloc[:, 2].astype(float)):
            w[at[a], at[b]] += v
            w[at[b], at[a]] += v
        total, degree, done, work = w.sum(), w.sum(axis=1), [], [np.arange(len(names))]
        while work:
            own = work.pop()
            part = w[np.ix_(own, own)]
            if len(own) >= least:
                side = np.linalg.eigh(np.diag(part.sum(axis=1)) - part)[1][:, 1] > 0
                a, b = own[side], own[~side]
                if len(a) and len(b) and degree[a].sum() * degree[b].sum() / total > w[np.ix_(a, b)].sum():
                    work += [a, b]
                    continue
            done.append(own)
        found = {names[i]: names[min(own)] for own in done for i in own.tolist()}
        yield pd.DataFrame({"id": pd.Series(list(found), dtype=object), "cluster": pd.Series(list(found.values()), dtype=object)})

    parts = near.coalesce(1).mapInPandas(run, "id string, cluster string")
    return ids.join(parts, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (id, community) of the undirected weighted graph."""
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return 0.0
    inside = edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst").where("cs = cd").agg(F.sum("w")).first()[0] or 0.0
    ends = edges.select(F.col("src").alias("id"), "w").unionByName(edges.select(F.col("dst").alias("id"), "w"))
    squares = ends.join(labels, "id").groupBy("community").agg(F.sum("w").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return inside / total - resolution * squares / (2 * total) ** 2


def _leaning(chosen: DataFrame, near: DataFrame) -> DataFrame:
    """(id, score) of Brandes' sums from all pivots at once: levels forward by joins, then back."""
    level = durable(chosen.select(F.col("id").alias("pivot"), "id", F.lit(1.0).alias("ways")), "between")
    seen, levels = level.select("pivot", "id"), [level]
    while True:
        hop = level.join(near.withColumnRenamed("src", "id"), "id").groupBy("pivot", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
        level = durable(hop.join(seen, ["pivot", "id"], "left_anti"), "between")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("pivot", "id"))
    lean, out = None, None
    for depth in range(len(levels) - 1, 0, -1):
        own = levels[depth].withColumn("lean", F.lit(0.0)) if lean is None else levels[depth].join(lean, ["pivot", "id"], "left").fillna(0.0, ["lean"])
        own = durable(own, "between")
        out = own.select("id", "lean") if out is None else out.unionByName(own.select("id", "lean"))
        told = own.select("pivot", F.col("id").alias("dst"), F.col("ways").alias("below"), F.col("lean").alias("under")).join(near, "dst")
        lean = told.join(levels[depth - 1].withColumnRenamed("id", "src"), ["pivot", "src"]).groupBy("pivot", F.col("src").alias("id")).agg(F.sum(F.col("ways") / F.col("below") * (1 + F.col("under"))).alias("lean"))
    if out is None:
        return chosen.select("id", F.lit(0.0).alias("score"))
    return out.groupBy("id").agg(F.sum("lean").alias("score"))


def betweenness(ids: DataFrame, edges: DataFrame, pivots: int = 256, small_edges: int = BROADCAST_ROWS) -> DataFrame:
    """(id, score): Brandes from each node, or from ``pivots`` chosen by hash and scaled; the adjacency goes out only below a checked size, beyond it levels are joins."""
    near = durable(edges.select("src", "dst").where("src <> dst").distinct(), "between-edges")
    n = ids.count()
    chosen = ids.select("id") if n <= pivots else ids.select("id").orderBy(F.xxhash64("id"), "id").limit(pivots)
    if near.count() > small_edges:
        part = _leaning(chosen, near).withColumn("score", F.col("score") * (n / min(n, pivots)))
        return ids.join(part, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    adjacency: dict[str, list[str]] = defaultdict(list)
    for r in near.orderBy("src", "dst").collect():  # at most BROADCAST_ROWS rows
        adjacency[r[0]].append(r[1])
    scale = n / min(n, pivots) if n else 1.0

    def brandes(frames):
        score: dict[str, float] = defaultdict(float)
        for frame in frames:
            for s in frame["id"]:
                order, before, count, dist, queue = [], defaultdict(list), {s: 1.0}, {s: 0}, deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for t in adjacency.get(v, ()):
                        if t not in dist:
                            dist[t] = dist[v] + 1
                            queue.append(t)
                        if dist[t] == dist[v] + 1:
                            count[t] = count.get(t, 0.0) + count[v]
                            before[t].append(v)
                lean: dict[str, float] = defaultdict(float)
                for t in reversed(order):
                    for v in before[t]:
                        lean[v] += count[v] / count[t] * (1 + lean[t])
                    if t != s:
                        score[t] += lean[t] * scale
        if score:
            yield pd.DataFrame({"id": pd.Series(list(score), dtype=object), "score": pd.Series(list(score.values()), dtype=float)})

    part = chosen.repartition("id").mapInPandas(brandes, "id string, score double").groupBy("id").agg(F.sum("score").alias("score"))
    return ids.join(part, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def cycles(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size): strong components with more than one node, and self-loops."""
    parts = strong_components(ids, edges).groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    loops = edges.where("src = dst").select(F.col("src").alias("component"), F.lit(1).cast("long").alias("size")).distinct()
    return parts.unionByName(loops.join(parts, "component", "left_anti"))


__all__ = ["betweenness", "communities", "cycles", "hits", "k_core", "label_communities", "modularity", "outgoing", "pagerank", "small", "spectral", "strong_components", "undirected", "weak_components"]
