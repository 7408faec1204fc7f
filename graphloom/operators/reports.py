"""Reports over edges and nodes: users of things, gaps, risks and rules.  Each is a few joins and map-side combined sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import durable, fixpoint, ranked
from ..plans.model import Graph, rank
from .analytics import strong_components
from .filters import is_test

UNRESOLVED = r"^(unresolved|external)::"


def users_of(edges: DataFrame, kind: str, by: Sequence[str] = ("dst",), name: str | None = None, resolved: bool = True) -> DataFrame:
    """Uses of one kind grouped by target (and mode): how many, how many users, the first line; unresolved targets are left out."""
    mine = edges.where(F.col("kind") == kind)
    if resolved:
        mine = mine.where(~F.col("dst").rlike(UNRESOLVED))
    if name is not None:
        mine = mine.where(F.contains("dst", F.lit(name)))
    return mine.groupBy(*by).agg(F.count("*").alias("uses"), F.count_distinct("src").alias("users"), F.min("line").alias("first_line"))


def error_surface(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(thrower, throws): the different targets of each, in order."""
    return edges.where("kind = 'throws'").groupBy(F.col("src").alias("thrower")).agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("throws"))


def incoming_by_first(edges: DataFrame) -> DataFrame:
    """(dst, src, file_path, n, place): sources of each target in the order of their first edge there."""
    per = edges.groupBy("dst", "src", "file_path").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
    order = Window.partitionBy("dst").orderBy("first_line", "src", "file_path")
    return per.select("dst", "src", "file_path", "n", F.row_number().over(order).alias("place"))


def novelty(heat: Column, days: Column, window: float) -> Column:
    """Heat that fades to nothing over ``window`` days; without a date there is none."""
    return F.coalesce(heat * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / window)), F.lit(0.0))


def deepest_loops(ids: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, total) of ids (id, loop) over calls (src, dst): own loops and the most that lies below; a cycle counts its deepest member once."""
    calls = durable(calls.select("src", "dst").distinct(), "loops-calls")
    component = durable(strong_components(ids.select("id"), calls), "loops")
    own = ids.join(component, "id").groupBy("component").agg(F.max("loop").cast("long").alias("own"))
    a, b = component.toDF("src", "ca"), component.toDF("dst", "cb")
    dag = durable(calls.join(a, "src").join(b, "dst").where("ca <> cb").select("ca", "cb").distinct(), "loops-dag")

    def step(state: DataFrame) -> DataFrame:
        below = dag.join(state.select(F.col("component").alias("cb"), "total"), "cb").groupBy(F.col("ca").alias("component")).agg(F.max("total").alias("below"))
        return state.join(below, "component", "left").select("component", "own", (F.col("own") + F.coalesce("below", F.lit(0))).alias("total"))

    done = fixpoint(own.select("component", "own", F.col("own").alias("total")), step, name="loops")
    return component.join(done, "component").select("id", "total")


def unimplemented(graph: Graph, kind: str, by: str) -> DataFrame:
    """(id) of nodes of a kind that no edge of kind ``by`` leads to."""
    return graph.nodes.where(F.col("kind") == kind).select("id").join(graph.edges.where(F.col("kind") == by).select(F.col("dst").alias("id")), "id", "left_anti")


def only_from_tests(edges: DataFrame) -> DataFrame:
    """(dst, n) of targets that are used in tests alone."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.bool_and(is_test(F.col("file_path"))).alias("all")).where("all").select("dst", "n")


def covered(symbols: DataFrame, segments: DataFrame, block: int = 64) -> DataFrame:
    """(id, stmts, hit, pct) of symbols (id, file_path, start_line, end_line) by segments (file_path, at, stmts, hits); none: -1.

    Ranges and lines meet on blocks of lines, not on whole files.
    """
    at = segments.withColumn("block", (F.col("at") / block).cast("long"))
    spans = symbols.withColumn("block", F.explode(F.sequence((F.col("start_line") / block).cast("long"), (F.col("end_line") / block).cast("long"))))
    inside = spans.join(at, ["file_path", "block"]).where("at BETWEEN start_line AND end_line")
    sums = inside.groupBy("id").agg(F.sum("stmts").alias("stmts"), F.sum(F.when(F.col("hits") > 0, F.col("stmts")).otherwise(0)).alias("hit"))
    out = symbols.select("id").join(sums, "id", "left").fillna(0, ["stmts", "hit"])
    return out.withColumn("pct", F.when(F.col("stmts") == 0, F.lit(-1.0)).otherwise(F.round(100.0 * F.col("hit") / F.col("stmts"), 2)))


def tests_as_edges(edges: DataFrame, by: str = "symbol") -> DataFrame:
    """Tests grouped by the symbol they cover, or symbols by test."""
    key, other = ("dst", "src") if by == "symbol" else ("src", "dst")
    return edges.groupBy(F.col(key).alias("key")).agg(F.count_distinct(other).alias("n"), F.min(other).alias("first"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out), repeats counted."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def knowledge_gaps(graph: Graph, groups: DataFrame, tested: DataFrame, hot: int, thin: int) -> DataFrame:
    """(gap, id, n): nodes without edges, hot nodes without tests, groups (id, community) with few members, and of one file."""
    d = degrees(graph.edges)
    alone = graph.nodes.select("id").join(d, "id", "left_anti").select(F.lit("disconnected").alias("gap"), "id", F.lit(0).cast("long").alias("n"))
    hotspots = d.where(F.col("fan_in") >= hot).join(graph.nodes.select("id"), "id", "left_semi").join(tested.select("id"), "id", "left_anti").select(F.lit("untested_hotspot").alias("gap"), "id", F.col("fan_in").alias("n"))
    per = groups.join(graph.nodes.select("id", "file_path"), "id").groupBy(F.col("community").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))
    few = per.where(F.col("n") < thin).select(F.lit("thin").alias("gap"), "id", "n")
    single = per.where((F.col("n") >= thin) & (F.col("files") == 1)).select(F.lit("single_file").alias("gap"), "id", "n")
    return alone.unionByName(hotspots).unionByName(few).unionByName(single)


def dead_code(nodes: DataFrame, edges: DataFrame, uses: Sequence[str], overrides: str, hidden: Sequence[str], entries: str) -> DataFrame:
    """(id, verdict) of nodes (id, name, visibility) that no use reaches: dead, or a coverage gap if an unresolved call names it.

    Visible ones, entry points by name, and what overrides a used node are alive.
    """
    used = edges.where(F.col("kind").isin(*uses)).select(F.col("dst").alias("id")).distinct()
    saved = edges.where(F.col("kind") == overrides).select(F.col("src").alias("id"), F.col("dst").alias("up")).join(used.withColumnRenamed("id", "up"), "up").select("id").distinct()
    loose = edges.where(F.col("dst").rlike(r"^unresolved::\*\.")).select(F.regexp_extract("dst", r"^unresolved::\*\.(.*)$", 1).alias("name"), F.lit(True).alias("named")).distinct()
    left = nodes.where(F.col("visibility").isin(*hidden) & ~F.col("name").rlike(entries)).join(used, "id", "left_anti").join(saved, "id", "left_anti")
    return left.join(loose, "name", "left").select("id", F.when(F.col("named"), "coverage_gap").otherwise("dead").alias("verdict"))


def demand_evidence(methods: DataFrame, implements: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, owners, demand) of methods (id, owner): calls that reach an interface which the method's owner implements."""
    demand = calls.groupBy(F.col("dst").alias("interface")).agg(F.count("*").alias("demand"))
    per = implements.select(F.col("src").alias("owner"), F.col("dst").alias("interface")).distinct().join(demand, "interface").groupBy("owner").agg(F.count("*").alias("interfaces"), F.sum("demand").alias("demand"))
    return methods.join(per, "owner", "left").select("id", F.coalesce("interfaces", F.lit(0)).alias("interfaces"), F.coalesce("demand", F.lit(0)).alias("demand"))


def pr_risk(axes: dict[str, Column], keyword: Column) -> tuple[Column, Column]:
    """(level, factors) from axes between 0 and 1: the worst axis decides, a keyword raises to HIGH at least, factors come worst first."""
    worst = F.greatest(*axes.values())
    order = F.when(worst >= 0.9, 3).when((worst >= 0.6) | keyword, 2).when(worst >= 0.3, 1).otherwise(0)
    pairs = F.array(*[F.struct((-v).alias("v"), F.lit(k).alias("k")) for k, v in axes.items()])
    named = F.transform(F.array_sort(F.filter(pairs, lambda p: p["v"] < 0)), lambda p: p["k"])
    return F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), order + 1), F.array_join(named, ",")


def route_risk(consumers: Column, mismatches: Column, breaking: Column) -> Column:
    """More than 10 consumers: HIGH, 5 or more: MEDIUM; a mismatch raises by a level, a breaking change to HIGH."""
    base = F.when(consumers > 10, 2).when(consumers >= 5, 1).otherwise(0) + F.when(mismatches > 0, 1).otherwise(0)
    return F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.when(breaking, 3).otherwise(F.least(base, F.lit(2)) + 1))


def outcome(dst: Column, found: Column) -> Column:
    """What became of an edge's target."""
    return F.when(found, "resolved").when(dst.rlike(r"^unresolved::\*\."), "ambiguous").when(dst.rlike("^unresolved::"), "unresolved").when(dst.rlike("^external::"), "external").otherwise("dangling")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of reasons whose target is gone."""
    return edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def suggestions(nodes: DataFrame, edges: DataFrame, per: int = 3) -> DataFrame:
    """(place, category, id): entries, bridges, hubs and subsystems worth a look, in that order."""
    d = degrees(edges).join(nodes.select("id", "file_path"), "id")
    entry = d.where("fan_in = 0").select(F.lit(0).alias("c"), F.lit("entry").alias("category"), "id", F.col("fan_out").alias("v"))
    bridge = d.where("fan_in > 0 AND fan_out > 0").select(F.lit(1).alias("c"), F.lit("bridge").alias("category"), "id", F.least("fan_in", "fan_out").alias("v"))
    hub = d.select(F.lit(2).alias("c"), F.lit("hub").alias("category"), "id", F.col("fan_in").alias("v"))
    system = d.groupBy(F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/").alias("id")).agg(F.sum("fan_in").alias("v")).select(F.lit(3).alias("c"), F.lit("subsystem").alias("category"), "id", "v")
    best = None
    for part in (entry, bridge, hub, system):
        top = part.orderBy(F.desc("v"), "id").limit(per)
        best = top if best is None else best.unionByName(top)
    return best.select((F.row_number().over(Window.orderBy("c", F.desc("v"), "id")) - 1).alias("place"), "category", "id")  # 4 x per rows


def boundaries(nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(layer, allowed): layers by directory, and the layers that each is seen to use."""
    layer = nodes.select("id", F.array_join(F.slice(F.split("file_path", "/"), 1, depth), "/").alias("layer"))
    half = edges.select("src", "dst").join(layer.toDF("src", "a"), "src").select("a", "dst").distinct()
    cross = half.join(layer.toDF("dst", "b"), "dst").where("a <> b").groupBy(F.col("a").alias("layer")).agg(F.array_join(F.sort_array(F.collect_set("b")), ",").alias("allowed"))
    return layer.select("layer").distinct().join(cross, "layer", "left").select("layer", F.coalesce("allowed", F.lit("")).alias("allowed"))


def callers_outside(edges: DataFrame, nodes: DataFrame, selected: Column, changed: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): edges into the selected nodes from others; with ``changed`` (id) only those from it."""
    inside = nodes.where(selected).select("id")
    into = edges.select("src", "dst", "kind").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").join(inside.withColumnRenamed("id", "src"), "src", "left_anti")
    return (into if changed is None else into.join(changed.select(F.col("id").alias("src")), "src", "left_semi")).select("src", "dst", "kind")


def event_rules(events: DataFrame, topic: str, actor: str, producers: str, required: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """(topic, rule, n): events of actors outside the producers' pattern, topics without a required actor, and forbidden topics that occur."""
    wrong = events.where(~F.col(actor).rlike(producers)).groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n")).select("topic", F.lit("producer").alias("rule"), "n")
    have = events.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"), *[F.max((F.col(actor) == r).cast("int")).alias(f"r{i}") for i, r in enumerate(required)])
    for i in range(len(required)):
        wrong = wrong.unionByName(have.where(F.col(f"r{i}") == 0).select("topic", F.lit("consumer").alias("rule"), F.lit(0).cast("long").alias("n")))
    return wrong.unionByName(have.where(F.col("topic").isin(*forbidden)).select("topic", F.lit("forbidden").alias("rule"), "n"))


def entry_score(fan_in: Column, fan_out: Column, name: Column) -> Column:
    """How much a node looks like an entry point: calls out lift, callers lower, names of handlers lift, accessors sink."""
    boost = F.when(name.rlike("^(main|Main)$"), 3.0).when(name.rlike("(?i)^(handle|serve|run|customer)"), 1.5).when(name.rlike("^(get|set|is)[A-Z_]"), 0.3).otherwise(1.0)
    return boost * fan_out / (1 + fan_in)


def graded(rows: DataFrame, budget: int, full: str = "full", skeleton: str = "skeleton", name: str = "name", order: Sequence[str] = ("place",)) -> DataFrame:
    """Adds ``grade`` and ``cost``: full while a third of the budget lasts, skeletons to two thirds, names to the end; what is beyond goes."""
    placed = ranked(rows, list(order), "__at")
    run = lambda c: F.sum(c).over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    few = placed.orderBy("__at").limit(budget)  # every row costs a token at least
    costed = few.withColumns({"__f": run(full), "__s": run(skeleton), "__n": run(name)})
    grade = F.when(F.col("__f") <= budget / 3, "full").when(F.col("__s") <= 2 * budget / 3, "skeleton").when(F.col("__n") <= budget, "name")
    out = costed.withColumn("grade", grade).where("grade IS NOT NULL")
    cost = F.when(F.col("grade") == "full", F.col(full)).when(F.col("grade") == "skeleton", F.col(skeleton)).otherwise(F.col(name))
    return out.withColumn("cost", cost).drop("__f", "__s", "__n", "__at")


def worst_tier(origins: Column) -> Column:
    return F.array_min(F.transform(origins, rank))


def blast_radius(ids: DataFrame, uses: DataFrame, tests: DataFrame, most: int = 3) -> DataFrame:
    """(id, callers, tests, no_tests): a row for each id, with its first covering tests."""
    callers = uses.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("src"))
    first = tests.select(F.col("dst").alias("id"), "src").distinct().withColumn("k", place).where(F.col("k") <= most)
    named = first.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("src")), ",").alias("tests"))
    out = ids.join(callers, "id", "left").join(named, "id", "left")
    return out.select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("tests", F.lit("")).alias("tests"), F.col("tests").isNull().alias("no_tests"))
