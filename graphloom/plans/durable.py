"""Cutting the lineage of iterative plans through tables in a folder that executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a measured side is broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_made: list[tuple[SparkSession, str]] = []


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes and rereads a table: what is lost with an executor is read again, not computed again.  It goes with :func:`release`."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the intermediate tables of this driver, at the latest when it ends; frames that still read them can't be used any more."""
    while _made:
        spark, path = _made.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone; whoever owns the shared folder clears it then
            return


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a side whose measured row count is small; otherwise leaves the join to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str, rows: int | None = None, each: int = 250_000) -> DataFrame:
    """By key over so many partitions that one holds about ``each`` of the ``rows`` (counted if not given), so that a task's memory doesn't grow with the table."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), *keys)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None = None, name: str = "fix") -> DataFrame:
    """Repeats ``step`` until the rows stay the same, compared by count and hash sum; ``most``: only where a bound is what the caller asks for."""
    state, before, rounds = durable(state, name), None, 0
    while most is None or rounds < most:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64(*state.columns).cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, rounds = mark, rounds + 1
        state = durable(step(state), name)
    return state


def ranked(rows: DataFrame, order: list, out: str, name: str = "ranked") -> DataFrame:
    """Adds the place (from 0) of each row in a total order; no task sees more than its range of it."""
    sorted_ = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()}), name)
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sorted_.groupBy("__pid").agg(F.count("*").alias("__n"), F.min("__mid").alias("__first")).select("__pid", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return sorted_.join(F.broadcast(starts), "__pid").withColumn(out, F.col("__start") + F.col("__mid") - F.col("__first")).drop("__pid", "__mid", "__first", "__start")
