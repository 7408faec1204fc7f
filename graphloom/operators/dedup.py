"""Near duplicates: MinHash signatures, banded candidates, exact verification, clusters; and a count-min sketch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, small
from .analytics import weak_components

STRATA = ((0, 80), (50, 160), (100, 320), (200, 640), (400, None))


def keyed(docs: DataFrame) -> DataFrame:
    """(id, .., key, set) of docs (id, shingles, ..), written once: the sorted 64-bit hashes of the shingles (hashes already or texts), and the key of equal sets, null without shingles.

    Only hashes move from here on.  Two of a pair's shingles fall together with a chance of n * n / 2**65 (3e-12 for 10,000).
    """
    if "key" in docs.columns:
        return docs
    rest = [c for c in docs.columns if c != "shingles"]
    hashed = F.col("shingles") if dict(docs.dtypes)["shingles"] == "array<bigint>" else F.transform("shingles", lambda g: F.xxhash64(g))
    once = docs.select(*rest, F.explode(F.array(F.sort_array(hashed))).alias("set"))  # exploded, so that it is computed once
    return durable(once.select(*rest, F.when(F.size("set") > 0, F.xxhash64("set")).alias("key"), "set"), "sets")


def heads(docs: DataFrame) -> DataFrame:
    """(id): the least id of each class of equal sets of :func:`keyed` docs."""
    return durable(docs.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")).select("id"), "heads")


def signatures(docs: DataFrame, hashes: int = 64) -> DataFrame:
    """(id, sig, n, parity) of :func:`keyed` docs: the least hash of the set under each of ``hashes`` seeds, its size, and the parities of 1,024 cells; combined before anything moves; none without shingles."""
    each = docs.select("id", F.explode("set").alias("h"))
    bit = lambda i: F.bit_xor(F.when(F.col("h").bitwiseAND(15) == i, F.expr("shiftleft(1L, CAST((h >> 4) & 63 AS INT))")).otherwise(F.lit(0).cast("long")))
    least = each.groupBy("id").agg(F.count("*").alias("n"), *[F.min(F.xxhash64(F.lit(i), "h")).alias(f"m{i}") for i in range(hashes)], *[bit(i).alias(f"p{i}") for i in range(16)])
    return least.select("id", F.array(*[f"m{i}" for i in range(hashes)]).alias("sig"), "n", F.array(*[f"p{i}" for i in range(16)]).alias("parity"))


def most_similar(na: Column, nb: Column, pa: Column, pb: Column) -> Column:
    """What the Jaccard similarity of two sets can be at most by their sizes and parities: a cell of different parity holds an element of one of them alone."""
    apart = F.aggregate(F.zip_with(pa, pb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return F.least(F.least(na, nb) / F.greatest(na, nb), (na + nb - apart) / (na + nb + apart))


def verified(pairs: DataFrame, marks: tuple[DataFrame, DataFrame], docs: tuple[DataFrame, DataFrame], threshold: float, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, similarity) of candidate pairs (a, b) that are similar, exactly: sets of :func:`keyed` docs, one for each end, move only for pairs whose marks (id, n, parity) allow it."""
    end = lambda m, x: m.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    near = pairs.join(end(marks[0], a), a).join(end(marks[1], b), b).where(most_similar(F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"p{a}"), F.col(f"p{b}")) >= threshold)
    near = durable(near.select(a, b), "near")
    n = near.count()
    body = lambda d, x: d.select(F.col("id").alias(x), F.col("set").alias(f"s{x}")).join(small(near.select(x).distinct(), n), x, "left_semi")
    both = F.size(F.array_intersect(f"s{a}", f"s{b}"))
    score = small(near, n).join(body(docs[0], a), a).join(body(docs[1], b), b).select(a, b, F.size(f"s{a}").alias("na"), F.size(f"s{b}").alias("nb"), both.alias("both"))
    return score.select(a, b, (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold)


def similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return same / F.size(a)


def bands(sig: Column, rows: int = 4) -> Column:
    """(band, bucket) of each run of ``rows`` places."""
    count = (F.size(sig) / rows).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(sig, i * rows + 1, rows)).alias("bucket")))


def strata(length: Column) -> Column:
    """Numbers of the overlapping length classes of a body; an unknown length is in all."""
    inside = [F.when(length.isNull() | ((length >= lo) & (F.lit(True) if hi is None else length < hi)), F.lit(i)) for i, (lo, hi) in enumerate(STRATA)]
    return F.array_compact(F.array(*inside))


def near_pairs(docs: DataFrame, threshold: float = 0.8, hashes: int = 64, rows: int = 4) -> DataFrame:
    """(a, b, similarity) of docs (id, shingles), a < b: candidates share a band, and are verified exactly.

    Equal shingle sets are one class, named by its least id, so copies never meet in pairs; :func:`members` has the classes.
    """
    docs = keyed(docs)
    marks = durable(signatures(docs, hashes).join(heads(docs), "id", "left_semi"), "marks")
    rungs = durable(marks.select("id", F.explode(bands(F.col("sig"), rows)).alias("k")).select("id", "k.band", "k.bucket"), "bands")
    left, right = rungs.withColumnRenamed("id", "a"), rungs.withColumnRenamed("id", "b")
    pairs = left.join(right, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    return verified(pairs, (marks, marks), (docs, docs), threshold)


def members(docs: DataFrame) -> DataFrame:
    """(id, class) of each of docs (id, shingles): the least id with an equal shingle set; without shingles the doc's own id."""
    own = keyed(docs).select("id", "key")
    least = own.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("class"))
    return durable(own.join(least, "key", "left").select("id", F.coalesce("class", "id").alias("class")), "members")


def all_pairs(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b, similarity) of classes with those of each class and its other members (id, class); any pair of docs follows from them."""
    copies = held.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies)


def placed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(id, cluster, links) of each member: its cluster (of the transitive closure), and how many docs it has pairs with, copies among them."""
    sizes = held.groupBy("class").agg(F.count("*").alias("n"))
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    far = ends.join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("n").alias("far"))
    groups = clusters(pairs).withColumnRenamed("id", "class")
    out = held.join(sizes, "class").join(far, "class", "left").join(groups, "class", "left")
    return out.select("id", F.coalesce("cluster", "class").alias("cluster"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster) of the transitive closure of pairs (a, b)."""
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return weak_components(ids, edges).withColumnRenamed("component", "cluster")


def _cells(column: str, width: int, depth: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), column), F.lit(width)).alias("cell")) for i in range(depth)])).alias("k")


def sketch(items: DataFrame, column: str, width: int = 65536, depth: int = 4) -> DataFrame:
    """(row, cell, n): a count-min sketch as a table; sketches add up by summing n."""
    return items.select(_cells(column, width, depth)).groupBy("k.row", "k.cell").agg(F.count("*").alias("n"))


def estimate(asked: DataFrame, column: str, table: DataFrame, width: int = 65536, depth: int = 4) -> DataFrame:
    """(column, estimate): never below the true count."""
    return asked.select(column, _cells(column, width, depth)).select(column, "k.row", "k.cell").join(table, ["row", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0).cast("long"))).alias("estimate"))


def settled(estimates: DataFrame, items: DataFrame, column: str, less: DataFrame | None = None, width: int = 65536, depth: int = 4) -> DataFrame:
    """(column, estimate): the estimates (column, estimate) of the different items, those counted from the rows (less the rows ``less``, not below 0) that share every cell with another item.

    An item that has a cell to itself is estimated by its own count, since no other cell is below that.
    """
    mine = estimates.select(column, _cells(column, width, depth)).select(column, "k.row", "k.cell")
    sole = mine.groupBy("row", "cell").agg(F.count("*").alias("n"), F.min(column).alias(column)).where("n = 1").select(column)
    shared = durable(estimates.select(column).join(sole.withColumnRenamed(column, "__own"), F.col(column).eqNullSafe(F.col("__own")), "left_anti").withColumnRenamed(column, "__own"), "shared")
    rows = items.select(column, F.lit(1).cast("long").alias("v"))
    rows = rows if less is None else rows.unionByName(less.select(column, F.lit(-1).cast("long").alias("v")))
    counted = rows.join(shared, F.col(column).eqNullSafe(F.col("__own")), "left_semi").groupBy(F.col(column).alias("__own")).agg(F.greatest(F.sum("v"), F.lit(0).cast("long")).alias("exact"))
    return estimates.join(counted, F.col(column).eqNullSafe(F.col("__own")), "left").select(column, F.coalesce("exact", "estimate").alias("estimate"))


def frequent_shingles(docs: DataFrame, share: float = 0.01, cells: int = 1 << 20) -> DataFrame:
    """(shingle, df) of shingles in more than ``share`` of the docs (id, shingles).

    Counted by hash cell first: a cell holds each of its shingles at least as often, so texts only move for cells above the bar, and are counted by themselves then.
    """
    bar = share * docs.count()
    each = docs.select(F.explode("shingles").alias("shingle")).withColumn("cell", F.pmod(F.xxhash64("shingle"), F.lit(cells)).cast("int"))
    often = durable(each.groupBy("cell").agg(F.count("*").alias("df")).where(F.col("df") > bar).select("cell"), "often")
    return each.join(small(often, often.count()), "cell", "left_semi").groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") > bar)


def stratified_pairs(docs: DataFrame, threshold: float = 0.8, hashes: int = 64, rows: int = 4) -> DataFrame:
    """:func:`near_pairs` of docs (id, shingles, length) that share a length class: a band's bucket is split by class, so long runs are shorter."""
    docs = keyed(docs)
    marks = durable(signatures(docs, hashes).join(heads(docs), "id", "left_semi"), "marks")
    classes = docs.select("id", F.explode(strata(F.col("length"))).alias("stratum"))
    rungs = durable(marks.select("id", F.explode(bands(F.col("sig"), rows)).alias("k")).join(classes, "id").select("id", "stratum", "k.band", "k.bucket"), "bands")
    pairs = rungs.withColumnRenamed("id", "a").join(rungs.withColumnRenamed("id", "b"), ["stratum", "band", "bucket"]).where("a < b").select("a", "b").distinct()
    return verified(pairs, (marks, marks), (docs, docs), threshold)


def band_index(docs: DataFrame, hashes: int = 64, rows: int = 4) -> DataFrame:
    """(id, band, bucket, n, parity) of docs (id, shingles): an index to which rows are added by union and from which they go by id; n and parity stand in band 0."""
    marks = signatures(keyed(docs), hashes).select("id", F.explode(bands(F.col("sig"), rows)).alias("k"), "n", "parity")
    first = lambda c: F.when(F.col("k.band") == 0, F.col(c)).alias(c)
    return marks.select("id", "k.band", "k.bucket", first("n"), first("parity"))


def index_change(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The index without removed and replaced ids (id), and with the rows of added docs (id, shingles)."""
    gone = None if added is None else added.select("id")
    if removed is not None:
        gone = removed.select("id") if gone is None else gone.unionByName(removed.select("id"))
    out = index if gone is None else index.join(gone.distinct(), "id", "left_anti").select(*index.columns)
    return out if added is None else out.unionByName(band_index(added))


def index_query(index: DataFrame, docs: DataFrame, asked: DataFrame, threshold: float = 0.8, asked_index: DataFrame | None = None) -> DataFrame:
    """(query, id, similarity): indexed docs that are similar to the asked ones (id, shingles), verified; a doc isn't its own.

    ``asked_index``: the asked docs' own rows of :func:`band_index`, where they are at hand.
    """
    docs, asked = keyed(docs), keyed(asked)
    own = band_index(asked) if asked_index is None else asked_index
    met = own.select(F.col("id").alias("query"), "band", "bucket").join(index.select("id", "band", "bucket"), ["band", "bucket"]).where("query <> id").select("query", "id").distinct()
    return verified(met, (own.where("band = 0"), index.where("band = 0")), (asked, docs), threshold, "query", "id")


def decremented(table: DataFrame, other: DataFrame) -> DataFrame:
    """A sketch less another one, no cell below 0."""
    less = other.withColumnRenamed("n", "less")
    return table.join(less, ["row", "cell"], "left").select("row", "cell", F.greatest(F.col("n") - F.coalesce("less", F.lit(0)), F.lit(0).cast("long")).alias("n"))


def clone_report(held: DataFrame, pairs: DataFrame, dead: DataFrame, least: float = 0.0, dead_only: bool = False) -> DataFrame:
    """(cluster, members, dead, similarity): clusters (id, cluster) of two or more, with their dead members (id) and the mean similarity of their pairs (a, b, similarity)."""
    flagged = held.join(dead.select("id", F.lit(1).alias("is_dead")), "id", "left")
    size = flagged.groupBy("cluster").agg(F.count("*").alias("members"), F.count("is_dead").alias("dead")).where("members > 1")
    mean = pairs.where(F.col("similarity") >= least).join(held.withColumnRenamed("id", "a"), "a").groupBy("cluster").agg(F.avg("similarity").alias("similarity"))
    out = size.join(mean, "cluster")
    return out.where("dead > 0") if dead_only else out
