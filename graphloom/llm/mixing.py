"""Mixing sources to target weights with nested hash-threshold histograms; DataFrame functions only.

Targets come from water filling: sources share all words by weight, none above ``repeat`` times its own words.
A source whose target is ``r`` times its words takes each document ``floor(r)`` times, and once more those documents
whose hash lies under a threshold.  The threshold is found level by level: words are summed by source and hash bucket,
buckets that fit the budget are taken, the boundary bucket alone is refined by the next bits.  Nothing is sorted.

Defined results: a null or wordless text has size 0; null is a source of its own, last in order; repeated rows are told
apart by their place in their file, whatever the partitions of a scan, once their hashes agree to the last level; an empty
table gives an empty result; other columns are ignored by :func:`mix` and kept by :func:`mixed`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, placed, small_side

WEIGHTS, REPEAT = (1, 2, 3), 3
#: Bits of a level; levels 0 to 2 take the hash of id and text, 3 and 4 that of the row's place.
BITS, LEVELS = 10, 5


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target; ``sizes`` has source and size.  Its windows run over sources, never over documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(float(repeat)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = weighed.withColumns({
        "__total": F.sum("source_size").over(everything).cast("double"),
        "__capped": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    water = (F.col("__total") - F.col("__capped")) / F.col("__open")
    # With the sources in order of cap per weight, the level rises while sources are filled to their cap and falls after.
    fits = level.withColumn("__level", F.max(water).over(everything))
    target = F.least(F.col("cap"), F.col("__level") * F.col("weight"))
    return fits.select("source", "source_size", target.alias("target"))


def sized(file: Column, row: Column) -> list[Column]:
    """The columns doc_id, source, size and the bucket of each level; ``file`` and ``row`` tell repeated rows apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = F.xxhash64(F.lit("mix"), "doc_id", F.xxhash64("text"))
    place = F.xxhash64(F.lit("place"), file, row)
    bits = lambda h, k: F.shiftrightunsigned(h, 64 - BITS * (k + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    levels = [bits(own, k) for k in range(3)] + [bits(place, k) for k in range(LEVELS - 3)]
    return [F.col("doc_id"), F.col("source"), size.alias("size"), *[x.alias(f"b{k}") for k, x in enumerate(levels)]]


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source and cut0..cut4: a document is under the threshold if its buckets come before the cuts in that order.

    ``budgets``: source, budget (words still to take).  In the last level the bucket at the boundary is taken if that comes nearer.
    """
    n = budgets.count()
    cuts = budgets.select("source", "budget")
    for k in range(LEVELS):
        inside = F.lit(True)
        for j in range(k):
            inside = inside & (F.col(f"b{j}") == F.col(f"cut{j}"))
        named = cuts.withColumnRenamed("source", "__source")
        at = rows.join(small_side(named, n), F.col("source").eqNullSafe(F.col("__source")) & inside)
        sums = at.groupBy("__source", f"b{k}").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("__source").orderBy(f"b{k}")  # at most 2**BITS rows a source
        upto = sums.withColumn("__upto", F.sum("words").over(run))
        known = named.select(F.col("__source").alias("__own"), "budget")
        found = upto.join(small_side(known, n), F.col("__source").eqNullSafe(F.col("__own"))).drop("__own")
        over = (F.col("__upto") > F.col("budget")) if k < LEVELS - 1 else (F.col("__upto") - F.col("budget") > F.col("words") / 2)
        step = found.groupBy("__source").agg(
            F.coalesce(F.min(F.when(over, F.col(f"b{k}"))), F.lit(1 << BITS)).alias(f"cut{k}"),
            F.coalesce(F.max(F.when(~over, F.col("__upto"))), F.lit(0)).alias("__fits"),
        )
        merged = cuts.join(small_side(step, n), F.col("source").eqNullSafe(F.col("__source")), "left")
        cuts = merged.select("source", *[f"cut{j}" for j in range(k)], F.coalesce(f"cut{k}", F.lit(1 << BITS)).alias(f"cut{k}"), (F.col("budget") - F.coalesce("__fits", F.lit(0))).alias("budget"))
        cuts = materialize(cuts, f"cuts{k}")
    return cuts


def laws(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> tuple[DataFrame, int]:
    """For each source (column __own) its size, target, whole copies and cuts; and the number of sources.  ``rows`` has the columns of :func:`sized`."""
    goals = materialize(targets(rows, weights, repeat), "targets")
    n = goals.count()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    budget = F.when(F.col("whole") >= repeat, F.lit(0.0)).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    budgets = goals.withColumn("whole", F.least(F.floor(ratio), F.lit(repeat))).withColumn("budget", budget)
    cuts = thresholds(rows, budgets).drop("budget").withColumnRenamed("source", "__source")
    law = budgets.join(small_side(cuts, n), F.col("source").eqNullSafe(F.col("__source")))
    return law.select(F.col("source").alias("__own"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), *[F.col(f"cut{k}").alias(f"__cut{k}") for k in range(LEVELS)]), n


def copies(bucket: list[Column], law: Callable[[str], Column], repeat: int = REPEAT) -> Column:
    """How often a document is taken, by its buckets and the law of its source (whole, cut0, cut1, ...)."""
    under = F.lit(False)
    for k in reversed(range(LEVELS)):
        under = (bucket[k] < law(f"cut{k}")) | ((bucket[k] == law(f"cut{k}")) & under)
    return (law("whole") + F.when(under & (law("whole") < repeat), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, taken; then source and copies, the number of times a document is taken."""
    docs, file, row = placed(docs, "mix-input")
    rows = materialize(docs.select(*sized(file, row)), "sizes")
    law, n = laws(rows, weights, repeat)
    times = copies([F.col(f"b{k}") for k in range(LEVELS)], lambda name: F.col(f"__{name}"), repeat)
    out = rows.join(small_side(law, n), F.col("source").eqNullSafe(F.col("__own"))).withColumn("copies", times)
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    docs, file, row = placed(docs, "mix-input")
    columns = sized(file, row)
    law, n = laws(materialize(docs.select(*columns), "sizes"), weights, repeat)
    held, own, rule, copy = (fresh(docs.columns, name) for name in ("buckets__", "own__", "rule__", "copy__"))
    at = docs.select("*", F.struct(*columns[3:]).alias(held))
    ruled = at.join(small_side(law.select(F.col("__own").alias(own), F.struct(*[F.col(f"__{c}").alias(c) for c in ("whole", *[f"cut{k}" for k in range(LEVELS)])]).alias(rule)), n), F.col("source").eqNullSafe(F.col(own)))
    times = copies([F.col(held)[f"b{k}"] for k in range(LEVELS)], lambda name: F.col(rule)[name], repeat)
    return ruled.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), times)).alias(copy)).drop(copy)
