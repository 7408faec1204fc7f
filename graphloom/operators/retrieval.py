"""Ranked retrieval: BM25, trigrams, vectors, fusion, and the signals of the reranker."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trigrams
from ..plans.durable import ranked


def bm25(docs: DataFrame, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of docs (id, tokens) that hold a query token; only tokens of the query leave the scan."""
    terms = sorted(set(query))
    sized = docs.select("id", F.size("tokens").alias("n"), "tokens")
    stats = sized.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    tf = sized.select("id", "n", F.explode(F.filter("tokens", lambda t: t.isin(*terms))).alias("term")).groupBy("id", "term").agg(F.first("n").alias("n"), F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    each = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))  # as many rows as query terms, and one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return each.groupBy("id").agg(F.sum(part).alias("score"))


def trigram_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Docs (id, text) that hold every trigram of a text; shorter texts leave every doc a candidate."""
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    keep = F.lit(True)
    for g in grams:
        keep &= F.contains("text", F.lit(g))
    return docs.where(keep).select("id")


def trigram_postings(docs: DataFrame) -> DataFrame:
    """(gram, id) of docs (id, text)."""
    return docs.select("id", F.explode(trigrams(F.col("text"))).alias("gram"))


def grep(docs: DataFrame, pattern: str, literal: bool = True, limit: int | None = None) -> DataFrame:
    """(id, line, text): lines that hold a text or match a pattern."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = lines.where(F.contains("text", F.lit(pattern)) if literal else F.col("text").rlike(pattern)).select("id", (F.col("line") + 1).alias("line"), "text")
    return found if limit is None else found.orderBy("id", "line").limit(limit + 1)


def disclosed(rows: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of a result that was fetched with one more, and ``truncated``: whether there was one."""
    more = rows.agg((F.count("*") > limit).alias("truncated"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(more))  # one row


def fuse(ranks: DataFrame, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (id, text_rank, vector_rank), -1 for absent; alpha 0 is text alone."""
    a = min(1.0, max(0.0, alpha))
    part = lambda c, w: F.when(F.col(c) >= 0, F.lit(w) / (k + F.col(c) + 1)).otherwise(0.0)
    return ranks.withColumn("score", part("text_rank", 1 - a) + part("vector_rank", a))


def query_class(text: str) -> str:
    """path, symbol, signature or concept."""
    t = text.strip()
    if not t:
        return "unknown"
    if re.search(r"\w\(.*\)|->|=>", t) or re.match(r"(func|def|fn)\s+\w", t):
        return "signature"
    if "/" in t and " " not in t or re.fullmatch(r"[\w.-]+\.(go|py|ts|tsx|js|rs|java|md|json|ya?ml)", t):
        return "path"
    if " " not in t and re.fullmatch(r"[\w.:#]+", t) and (re.search(r"[_.:#]", t) or re.search(r"[a-z][A-Z]", t) or t[:1].isupper()):
        return "symbol"
    return "concept"


ALPHA = {"path": 0.2, "symbol": 0.3, "signature": 0.4, "concept": 0.5, "unknown": 0.5}


def norm_log(count: Column, most: Column) -> Column:
    return F.when(most > 0, F.log1p(count) / F.log1p(most)).otherwise(F.lit(0.0))


def recency(days: Column, half_life: float = 30.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) / half_life * F.greatest(days, F.lit(0.0)))


def rank_signal(position: Column) -> Column:
    return F.when(position >= 0, F.lit(61.0) / (F.lit(60.0) + position + 1)).otherwise(F.lit(0.0))


def hits_signal(authority: Column, hub: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), authority / (1 + hub)))


#: Signals of the reranker: name to a column of the candidates; others may be added.
SIGNALS: dict[str, Callable[[], Column]] = {
    "bm25": lambda: rank_signal(F.col("text_rank")),
    "semantic": lambda: rank_signal(F.col("vector_rank")),
    "fan_in": lambda: norm_log(F.col("fan_in"), F.max("fan_in").over(Window.partitionBy("query"))),
    "recency": lambda: recency(F.col("days")),
}
WEIGHTS = {"bm25": 1.0, "semantic": 0.5, "fan_in": 0.3, "recency": 0.2}


def rerank(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds each signal with a weight as ``s_<name>``, and the weighted sum ``score``; a zero weight skips a signal."""
    used = {k: w for k, w in (weights or WEIGHTS).items() if w}
    out = candidates.withColumns({f"s_{k}": SIGNALS[k]() for k in used})
    score = F.lit(0.0)
    for k, w in used.items():
        score = score + F.lit(w) * F.col(f"s_{k}")
    return out.withColumn("score", score)


def per_group_ranks(rows: DataFrame, group: str, rank: str, key: str) -> DataFrame:
    """Numbers ranks again inside each group, where more than one group has rows; -1 stays."""
    order = Window.partitionBy(group, F.col(rank) >= 0).orderBy(rank, key)
    return rows.withColumn(rank, F.when(F.col(rank) >= 0, F.row_number().over(order) - 1).otherwise(F.col(rank)))


def diversify(rows: DataFrame, group: str, position: str, key: str, cap: int) -> DataFrame:
    """Adds ``place``: the first ``cap`` rows of a group keep their order, the rest follow all of them; 0 is off, empty groups are never over."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(position, key))
    over = (F.lit(cap) > 0) & (F.col(group) != "") & (within > cap)
    return ranked(rows.withColumn("__over", over), ["__over", position, key], "place").withColumn("place", F.col("place") + 1).drop("__over")


def pack(items: Sequence[tuple[str, int]], budget: int) -> list[str]:
    """Greedy in order, skipping what doesn't fit and going on."""
    out, left = [], budget
    for key, cost in items:
        if cost <= left:
            out.append(key)
            left -= cost
    return out


def frecency(events: DataFrame, key: str, ts: str, now: str, half_life_days: float = 3.0) -> DataFrame:
    """(key, score): each event decays by half in ``half_life_days``."""
    days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)) / 86400.0
    return events.groupBy(key).agg(F.sum(F.exp(-F.log(F.lit(2.0)) / half_life_days * days)).alias("score"))


def knn(queries: DataFrame, vectors: DataFrame, k: int, chunk: int = 4096) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` vectors with the largest dot product (rounded to 4 places), malformed ones left out.

    Queries go out in chunks of bounded size, each against one scan of the vectors; every partition returns k rows a query.
    """
    import numpy as np
    import pandas as pd

    n = queries.count()
    chunks = max(1, -(-n // chunk))
    numbered = queries.select("vec_id", "embedding").where("embedding IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    out = None
    for c in range(chunks):
        rows = numbered.where(F.col("chunk") == c).collect()  # about `chunk` rows
        if not rows:
            continue
        ids, q = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)

        def search(frames, ids=ids, q=q):
            # A few hundred queries meet a block at a time: what a task holds is their scores, and k hits of each query.
            parts = [slice(lo, lo + 256) for lo in range(0, len(ids), 256)]
            held = [(np.full((len(ids[p]), 0), -np.inf), np.empty((len(ids[p]), 0), np.int64)) for p in parts]
            for frame in frames:
                frame = frame[frame["embedding"].map(lambda v: v is not None and len(v) == q.shape[1])]
                for at in range(0, len(frame), 1024):
                    block = frame.iloc[at : at + 1024]
                    own = block["vec_id"].to_numpy()
                    vec = np.stack(block["embedding"].to_numpy()).astype(float).T if len(block) else np.empty((q.shape[1], 0))
                    for i, p in enumerate(parts):
                        score = np.round(q[p] @ vec, 4)
                        score[ids[p, None] == own[None, :]] = -np.inf
                        score, mine = np.hstack([held[i][0], score]), np.hstack([held[i][1], np.broadcast_to(own, score.shape)])
                        if score.shape[1] > k:  # all that reach the k-th best, then the smaller ids among equals
                            order = np.lexsort((mine, -score), axis=1)[:, :k]
                            score, mine = np.take_along_axis(score, order, 1), np.take_along_axis(mine, order, 1)
                        held[i] = score, mine
            held_score, held_id = np.vstack([h[0] for h in held]), np.vstack([h[1] for h in held])
            keep = np.isfinite(held_score)
            yield pd.DataFrame({"query_id": np.repeat(ids, held_score.shape[1]).reshape(held_score.shape)[keep], "vec_id": held_id[keep], "score": held_score[keep]})

        part = vectors.select("vec_id", "embedding").mapInPandas(search, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("query_id", "vec_id", "score")
