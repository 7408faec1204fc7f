"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of the ring.  A document belongs to the first point clockwise from the hash of its id;
a document that meets a full shard goes on clockwise to the next shard with room.  Loads are counted in bytes.
The ring is walked over a histogram of fixed size (arcs times size classes); only the few cells in which a shard
fills up are divided among shards, row by row.

Law ``bytes``: no shard exceeds its share of all bytes by more than one document.

Defined results: a null text has size 1 and crc 0; a null id hashes like any other key; repeated rows, or one id
holding a third of all rows, are divided like other rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, offset_in, small_side, with_position

#: Places of the ring (a power of two), points of each shard.
SLOTS, SHARDS, POINTS = 4096, 8, 64


def ring(shards: int, points: int = POINTS) -> tuple[list[int], list[int]]:
    """(arc of each of the SLOTS places of the ring, owner of each arc); a shard's points don't depend on the other shards."""
    made = sorted((int.from_bytes(hashlib.sha256(f"{s}/{p}".encode()).digest()[:8], "big") % SLOTS, s) for s in range(shards) for p in range(points))
    arcs, at = [], 0
    for slot in range(SLOTS):
        while at < len(made) and made[at][0] < slot:
            at += 1
        arcs.append(at % len(made))
    return arcs, [s for _, s in made]


def walk(cells: list[tuple[int, int, int]], owners: list[int], shards: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(arc, size class, bytes) to [(shard, upper bound of the running bytes of the cell)]; bounded loads, clockwise.

    Large documents find their shard first, so that shards fill up with small ones.
    """
    total = sum(c[2] for c in cells)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = {}
    for arc, sub, size in sorted(cells, key=lambda c: (-c[1], c[0])):
        quotas, done, at = [], 0, arc
        while done < size:
            while not room[owners[at % len(owners)]]:
                at += 1
            shard = owners[at % len(owners)]
            taken = min(size - done, room[shard])
            room[shard] -= taken
            done += taken
            quotas.append((shard, done))
        out[arc, sub] = quotas
    return out


def _assign(rows: DataFrame, shards: int, points: int, out: str) -> DataFrame:
    spark = rows.sparkSession
    arcs, owners = ring(shards, points)
    table = F.split(F.lit(",".join(map(str, arcs))), ",").cast("array<int>")  # folded to one literal
    arc = F.get(table, F.shiftrightunsigned("h", 64 - SLOTS.bit_length() + 1).cast("int"))
    rows = rows.withColumn("arc", arc)
    rows = materialize(rows.withColumn("sub", F.floor(F.log2("size")).cast("int")), "shard-cells")
    cells = [tuple(r) for r in rows.groupBy("arc", "sub").agg(F.sum("size").alias("size")).collect()]  # at most shards x points x 32 rows
    quotas = walk(cells, owners, shards)
    whole = [(a, b, q[0][0]) for (a, b), q in quotas.items() if len(q) == 1]
    split = [(a, b, q) for (a, b), q in quotas.items() if len(q) > 1]
    whole_df = small_side(spark.createDataFrame(whole, "arc int, sub int, " + out + " int"), len(whole))
    placed = rows.join(whole_df, ["arc", "sub"])
    if not split:
        return placed.select(*[c for c in rows.columns if c not in ("arc", "sub")], out)
    split_df = small_side(spark.createDataFrame(split, "arc int, sub int, quotas array<struct<shard:int,upto:bigint>>"), len(split))
    parts = offset_in(rows.join(split_df, ["arc", "sub"]), ["arc", "sub"], "__begun", weight="size")
    chosen = F.element_at(F.filter("quotas", lambda q: q["upto"] > F.col("__begun") + (F.col("size") / 2).cast("long")), 1)["shard"]
    keep = [c for c in rows.columns if c not in ("arc", "sub")]
    return placed.select(*keep, out).unionByName(parts.select(*keep, chosen.alias(out)))


def shard(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = with_position(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.lit(1), "doc_id").alias("h")))
    placed = _assign(rows, shards, points, "shard")
    placed = materialize(placed.drop("h"), "sharded")
    slotted = offset_in(placed, ["shard"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
