"""Bounded training sets from the table of labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, lean

#: Most labelled rows that a model is fitted on; with more, those whose hash comes first.
MAX_LABELLED = 20_000


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, y: one row per labelled id that isn't held out; an id with several labels has their rounded mean."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    mine = known.where(id_crc("doc_id") % modulus != held_out)
    return mine.groupBy("doc_id").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text, y of the chosen labels; ``chosen`` is bounded, so it is broadcast."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.join(F.broadcast(chosen), "doc_id")


def matrix(rows: DataFrame, features: Callable[[bytes], list[float]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, features, y) of labelled texts, on the driver in the order of ids: at most ``MAX_LABELLED`` ids."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [features(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "y"])

    table = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "y").mapInArrow(lean(run), "doc_id long, x array<double>, y double").toArrow()
    ids, y = table.column("doc_id").to_numpy(), table.column("y").to_numpy()
    x = np.array(table.column("x").combine_chunks().values.to_numpy()).reshape(-1, width) if len(ids) else np.empty((0, width))
    order = np.lexsort((*x.T, ids)) if len(ids) else np.empty(0, np.int64)
    return ids[order], x[order], y[order]
