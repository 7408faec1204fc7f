"""Exact top-k inner products by no-random-access aggregation.

Each dimension of a block of candidates is a list sorted by value; a query reads it from the top where its own component is
positive and from the bottom where it is negative.  All lists are read to the same depth, in growing steps.  What was
read is known, what wasn't is bounded by the last value read, so each candidate has an upper and a lower bound.  A query
stops reading once few candidates of the block can still reach its k-th best score; those get their final scores.  The bounds
of all queries and candidates of a block are matrix products over what was read, with the last value read in place of what
wasn't; they are exact in floating point as all numbers are small integers.

Queries go out in chunks of bounded size, each against all candidates, block by block, after a pilot: the first block of every
partition, read whole, whose k-th best scores no outsider may stay below.

Defined results: vectors that are null, or hold null or non-finite components, take no part; of vectors of different
lengths the common components count; a query row excludes itself alone, not rows that repeat its id; ties go to the
smaller vec_id, null last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, materialize

TOP, STEP, SCALE = 20, 20, 64
#: Queries sent out at a time; candidates of a block; depths, as shares of a list; share of a block's candidates few enough to finish.
CHUNK, BLOCK, DEPTHS, FEW = 8192, 2048, (0.02, 0.1, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0), 0.03
PARTIAL = "query long, score long, vec_id long, rid long"


def whole(embedding: Column) -> Column:
    """floor(64 x) of each component, or null if the vector takes no part."""
    sound = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(sound, F.transform(embedding, lambda x: F.floor(SCALE * x.cast("double")).cast("long")))


def square(rows: list, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix, cut or filled with zeros to one width."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : min(width, len(row))] = row[:width]
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.empty(0)
    if len(column) and (lengths == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return square(column.to_pylist(), width)


class Best:
    """The k best (score, vec_id, rid) of each query so far."""

    def __init__(self, queries: int, k: int, bar: np.ndarray | None = None):
        self.k, self.bar = k, np.full(queries, -np.inf) if bar is None else bar.astype(float)
        self.query, self.score, self.vec_id, self.rid = (np.empty(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, rid: np.ndarray) -> None:
        query, score, vec_id, rid = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.vec_id, vec_id), (self.rid, rid)))
        order = np.lexsort((rid, vec_id, -score, query))
        query = query[order]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = place < self.k
        last = place == self.k - 1
        order = order[keep]
        self.query, self.score, self.vec_id, self.rid = query[keep], score[order], vec_id[order], rid[order]
        np.maximum.at(self.bar, query[last], score[order[last[keep]]])


def read_lists(x: np.ndarray, q: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray], best: Best) -> list[tuple[float, int, int]]:
    """Takes a block of candidates ``x`` (with ids and rids) into ``best``; ``own``: ids, rids and query rids.

    Returns for each depth reached its share of the lists, the queries that stopped there, and the scores resolved for them.
    """
    ids, rids, query_rids = own
    n, k = len(x), best.k
    ordered = np.sort(x, axis=0)
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    reading, log, before = np.arange(len(q)), [], 0
    for share in DEPTHS:
        depth = min(n, max(1, int(np.ceil(share * n))))
        if depth == before or not len(reading):
            continue
        before, high, low = depth, ordered[n - depth], ordered[depth - 1]
        top, bottom = x >= high, x <= low  # what has been read from either end
        # No candidate's upper bound is below that of one of which nothing was read; where that reaches the bar, reading goes on.
        unseen = up[reading] @ high.astype(kind) + down[reading] @ low.astype(kind)
        able = (unseen < best.bar[reading]) | ~np.isfinite(best.bar[reading]) | (depth == n)
        tried, waiting = reading[able], reading[~able]
        if not len(tried):
            continue
        bar = best.bar[tried]
        upper = up[tried] @ np.where(top, x, high).T.astype(kind) + down[tried] @ np.where(bottom, x, low).T.astype(kind)
        if depth < n and n > k + 1 and not np.isfinite(bar).all():
            lower = up[tried] @ np.where(top, x, ordered[0]).T.astype(kind) + down[tried] @ np.where(bottom, x, ordered[-1]).T.astype(kind)
            bar = np.maximum(bar, np.partition(lower, n - k - 1, axis=1)[:, n - k - 1])  # one more than k, as the query itself may be there
        elif depth == n and n > k:
            bar = np.maximum(bar, np.partition(upper, n - k - 1, axis=1)[:, n - k - 1])
        alive = upper >= bar[:, None]
        stop = np.full(len(tried), True) if depth == n else alive.sum(axis=1) <= max(k + 1, FEW * n)
        row, column = np.nonzero(alive & stop[:, None])
        if depth == n:
            score = upper[row, column].astype(np.int64)
            row = tried[row]
        else:
            row, score = tried[row], np.empty(len(row), np.int64)
            for a in range(0, len(row), 1 << 16):
                score[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[row[a : a + (1 << 16)]], x[column[a : a + (1 << 16)]])
        other = query_rids[row] != rids[column]
        row, column, score = row[other], column[other], score[other]
        best.add(row, score, ids[column], rids[column])
        log.append((share, int(stop.sum()), len(row)))
        reading = np.concatenate([waiting, tried[~stop]])
    return log


#: Stands for a null vec_id, so that it comes last.
_LAST = (1 << 63) - 1


def _search(batches: Iterator[pa.RecordBatch], q: np.ndarray, query_rids: np.ndarray, k: int, bar: np.ndarray | None = None, pilot: bool = False) -> Iterator[pa.RecordBatch]:
    best = Best(len(q), k, bar)
    for batch in batches:
        ids = batch.column(0).fill_null(_LAST).to_numpy()
        rids = batch.column(1).to_numpy()
        x = matrix(batch.column(2), q.shape[1])
        for a in range(0, len(x), BLOCK):
            read_lists(x[a : a + BLOCK], q, (ids[a : a + BLOCK], rids[a : a + BLOCK], query_rids), best)
            if pilot:
                break
        if pilot and len(x):
            break
    yield pa.RecordBatch.from_arrays([pa.array(query_rids[best.query]), pa.array(best.score), pa.array(best.vec_id), pa.array(best.rid)], names=["query", "score", "vec_id", "rid"])


def _bars(found: DataFrame, query_rids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query of a chunk among the partial results; minus infinity for fewer."""
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    last = found.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("query", "score").toArrow()  # a row a query
    bar = np.full(len(query_rids), -np.inf)
    sorter = np.argsort(query_rids)
    bar[sorter[np.searchsorted(query_rids, last.column("query").to_numpy(), sorter=sorter)]] = last.column("score").to_numpy()
    return bar


def top_k(vectors: DataFrame, k: int = TOP, step: int = STEP, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` rows for each row whose vec_id is divisible by ``step``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("rid"), whole(F.col("embedding")).alias("x")).where("x is not null")
    rows = materialize(rows, "vectors")
    asked = rows.where(F.col("vec_id") % step == 0)
    n = asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks = -(-n // chunk)
    folder = fresh_path(spark, "queries")
    asked.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int")).write.partitionBy("chunk").parquet(folder)
    asked = spark.read.schema("vec_id long, rid long, x array<long>, chunk int").parquet(folder)
    out = fresh_path(spark, "best")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")
    for c in range(chunks):
        part = asked.where(F.col("chunk") == c).select("rid", "x").toArrow()  # about `chunk` queries
        width = max([1, *(len(v) for v in part.column("x").to_pylist())])
        q, query_rids = square(part.column("x").to_pylist(), width), part.column("rid").to_numpy()
        if len(query_rids):
            bar = _bars(rows.mapInArrow(lambda it, q=q, r=query_rids: _search(it, q, r, k, pilot=True), PARTIAL), query_rids, k)
            found = rows.mapInArrow(lambda it, q=q, r=query_rids, b=bar: _search(it, q, r, k, b), PARTIAL)
            found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).write.mode("append").parquet(out)
    merged = spark.read.schema(PARTIAL + ", rank int").parquet(out)
    named = asked.select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"))
    return merged.join(named, "query").select("query_id", "rank", F.when(F.col("vec_id") != _LAST, F.col("vec_id")).alias("vec_id"), "score")
