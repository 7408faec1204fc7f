"""Helpers shared by the corpus operators: durable intermediate tables, checked broadcasts, distributed ranks."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a small side is broadcast; beyond, the join is left to the optimizer (sort-merge with skew splitting).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only where that is unset and everything runs in one process, a temporary one."""
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


_made: list[tuple[object, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes with :func:`release`, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Deletes all intermediate tables of this driver; frames that still read them can't be used any more."""
    while _made:
        try:
            delete(*_made.pop())
        except Exception:  # the JVM may be gone; whoever owns the shared folder clears it then
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage and survives the loss of executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a side whose row count was measured and is within the limit."""
    return F.broadcast(df) if rows <= limit else df


def fresh(taken: Sequence[str], name: str) -> str:
    """A column name that no column in ``taken`` has."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def placed(docs: DataFrame, name: str) -> tuple[DataFrame, Column, Column]:
    """The rows with two columns, file and row, that tell them apart and are the same in every scan.

    They are a file's hash and a row's number in it.  Rows that don't come straight from files are written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs, name)
    at = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(at["file_path"]), at["row_index"]


#: Bytes of bitmaps of rows that are broadcast; a bitmap has 4 KB for 32,768 rows.
BITMAPS = 1 << 26


def at_places(docs: DataFrame, file: Column, row: Column, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` at the places of ``chosen`` (file, row), all columns.

    One bit a row goes out where all bits are within ``BITMAPS``, so texts aren't shuffled; beyond, a semi-join.
    """
    names = [fresh(docs.columns, n) for n in ("file__", "row__", "bucket__", "bits__")]
    f, r, bucket, bits = names
    at = docs.select("*", file.alias(f), row.alias(r))
    maps = materialize(chosen.groupBy(F.col("file").alias(f), F.bitmap_bucket_number("row").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias(bits)), "places")
    if maps.count() * 4096 > BITMAPS:
        return at.join(chosen.select(F.col("file").alias(f), F.col("row").alias(r)), [f, r], "left_semi").drop(f, r)
    place = F.bitmap_bit_position(r)
    octet = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr(f"1 << int(bitmap_bit_position(`{r}`) % 8)").bitwiseAND(octet) != 0
    return at.withColumn(bucket, F.bitmap_bucket_number(r)).join(F.broadcast(maps), [f, bucket]).where(held).select(*[F.col(f"`{c}`") for c in docs.columns])


Batches = Iterator[pa.RecordBatch]
#: Rows of a batch that an operator takes at once, where each row's work needs room.
SLICE = 512
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from one task to the next, until :func:`begin` lets it go."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def begin() -> None:
    """At a task's start: what the worker kept goes, and freed memory back to the system."""
    _kept.clear()
    give_back()


def give_back() -> None:
    """Freed memory that Arrow and the C library hold for later goes back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow in a worker that other operators use too: nothing of theirs stays beside it, and little of its own after it."""

    def task(batches: Batches) -> Batches:
        begin()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Batches:
    """A batch in parts of at most so many rows."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def id_crc(doc_id: Column | str) -> Column:
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def with_position(df: DataFrame) -> DataFrame:
    """Adds ``pid`` and ``mid``, the place of a row; they only stay the same once the result is materialized."""
    return df.withColumns({"pid": F.spark_partition_id(), "mid": F.monotonically_increasing_id()})


def offset_in(df: DataFrame, keys: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Adds the exclusive running count (or sum of ``weight``) of each row among the rows of its key.

    ``df`` holds the columns of :func:`with_position`, materialized.  No task ever holds a whole key: ranks
    are taken inside one input partition and shifted by the totals of the partitions before it.
    """
    value = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    by = [*keys, "pid"]
    totals = df.groupBy(*by).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by).orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(starts, by).withColumn(out, F.col("__start") + F.col("__inside")).drop("__start", "__inside")
