"""Event streams: windows, sessions, incremental maintenance.  Each transformation takes batch and streaming frames alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import shared_dir


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events without a pause of ``gap``; what a file watcher's debounce is on a stream."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def overlay(base: DataFrame, layer: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """The base without the rows of touched keys, and the layer's rows instead."""
    return base.join(touched.select(key), key, "left_anti").select(*base.columns).unionByName(layer.select(*base.columns))


def run_available(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Streams what files are there through ``transform``, with a checkpoint in the shared folder, and returns the last state."""
    schema = spark.read.parquet(path).schema
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = path if Path(path).is_dir() else str(Path(path).parent)
    reader = spark.readStream.schema(schema)
    if source != path:
        reader = reader.option("pathGlobFilter", Path(path).name)
    name = "out" + uuid.uuid4().hex

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/{epoch}")  # a retried epoch replaces itself

    rows = reader.parquet(source)
    plain = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]  # watermarks need an instant; the session's zone is UTC
    out = transform(rows.withColumns({c: F.col(c).cast("timestamp") for c in plain}))
    out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    epochs = sorted((r.getPath().getName() for r in _listed(spark, f"{folder}/{name}")), key=int)
    wanted = epochs[-1:] if mode == "complete" else epochs
    return spark.read.schema(out.schema).parquet(*[f"{folder}/{name}/{e}" for e in wanted]) if wanted else spark.createDataFrame([], out.schema)


def _listed(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)


def replace_files(current: DataFrame, batch: DataFrame, key: str = "file_path") -> DataFrame:
    """Evicts the rows of every file in a batch and takes the batch's rows instead."""
    return overlay(current, batch, batch.select(key).distinct(), key)


def changed(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change) by content hash: added, removed or changed."""
    a = before.select(key, F.sha2(content, 256).alias("was"))
    b = after.select(key, F.sha2(content, 256).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(key, change.alias("change"))


def alive(acks: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """(key) whose latest acknowledgement is younger than a time to live."""
    last = acks.groupBy("key").agg(F.max("ts").alias("last"))
    return last.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") < ttl_seconds).select("key")


def affected(nodes: DataFrame, edges: DataFrame, files: DataFrame, kinds: list[str]) -> DataFrame:
    """(file_path): changed files (file_path), and those with nodes that depend on nodes of changed files."""
    mine = nodes.join(files, "file_path", "left_semi").select(F.col("id").alias("dst"))
    users = edges.where(F.col("kind").isin(*kinds)).join(mine, "dst", "left_semi").select(F.col("src").alias("id"))
    return nodes.join(users, "id", "left_semi").select("file_path").unionByName(files.select("file_path")).distinct()


def recent(events: DataFrame, key: str, most: int, now: str, half_life_days: float) -> DataFrame:
    """(key, kept, score): a bounded history of the newest events of each key, decayed."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts")) / 86400.0
    return events.withColumn("__k", k).where(F.col("__k") <= most).groupBy(key).agg(F.count("*").alias("kept"), F.sum(F.exp(-F.log(F.lit(2.0)) / half_life_days * days)).alias("score"))


STREAKS = "user_id long, n long, streak long, worst long"


def streaks(events: DataFrame, bad: str) -> DataFrame:
    """(user_id, n, streak, worst) as they stand: events of a session's user, ``bad`` ones in a row at the end, and the longest such run; state is three numbers a user."""
    import pandas as pd

    def update(key, frames, state):
        n, streak, worst = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            n, streak = n + 1, streak + 1 if kind == bad else 0
            worst = max(worst, streak)
        state.update((n, streak, worst))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "streak": [streak], "worst": [worst]})

    slim = events.select("user_id", "ts", "event_id", "event_type")
    return slim.groupBy("user_id").applyInPandasWithState(update, STREAKS, "n long, streak long, worst long", "update", "NoTimeout")
