"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint's 64 bits get random vectors of ``radius + 1`` bits.  For each of the 2**(radius + 1) - 1 non-zero
vectors v there is a table whose mask keeps the bits with odd inner product with v.  Any ``radius`` bits lie in a
hyperplane, so some mask drops all bits in which two linked fingerprints differ: they collide in that table, always.

Work is done on distinct fingerprints; copies never meet in pairs.  Colliding runs stream in sorted order: short ones are
compared and leave a spanning forest, longer ones go to a second, third and fourth set of masks within the run; what then
still collides has a dozen free bits at most, so its runs are some thousands long and are compared whole.  Components come from star contraction over the links, in the cluster.

Defined results: a null, empty or wordless text has fingerprint 0 and links like any other; a null id never becomes a
component's id while another id is there; repeated rows stay one row each; an empty table gives an empty result;
very long texts are hashed in parts; other columns are ignored.

At 64 bits, texts that share four fifths of their shingles differ in about 9 bits, out of reach for the masks.  So
:func:`keep_dissimilar` takes SimHash fingerprints of 512 bits, each octet of them a table, and verifies what is close by its shingles.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_places, begin, give_back, lean, materialize, placed, slices, small_side

WIDTH, RADIUS, SHINGLE = 64, 4, 4
#: Words of a shingle and similarity of near duplicates where op1's contract doesn't rule.
STAGE_SHINGLE, SIMILAR = 5, 0.8
#: Octets of a wide fingerprint; 64-bit words of it that are compared, and bits that may differ in the first half of them and in all.
#: Of sets of similarity 0.8 a bit differs with a chance of 0.16 (0.185 for four shingles and five): no octet agrees with a chance
#: of 2e-8 (9e-7), and more bits differ with less than 1e-7.
OCTETS, WORDS, FAR_HALF, FAR = 64, 4, 48, 80
#: Longest run that is compared in memory; shingles of a text that are hashed at once.
RUN, PART = 2048, 1 << 16
#: Shingles of the sets that share a spot, about; what a set counts besides its own, so a spot of small sets is no crowd of pairs.
SPOT, ASIDE = 1 << 19, 512
_LOWER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: The bits of an octet, each in an octet of its own; 255 of these can be added.
_SPREAD = _BITS.astype(np.uint8).view("<u8").ravel()


def hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of the runs of ``shingle`` words of a text in UTF-8 (of fewer words the whole), up to ``PART`` at once."""
    from xxhash import xxh64_intdigest as digest

    words = text.translate(_LOWER).split()  # bytes.split() cuts at 0x20 and 0x09 to 0x0D alone
    if words:
        joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        ends = ends[min(shingle, len(words)) - 1 :]
        for at in range(0, n, PART):
            yield np.array([digest(joined[a:b], 42) for a, b in zip(begins[at : min(n, at + PART)].tolist(), ends[at : at + PART].tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    ones, n = np.zeros(WIDTH, np.int64), 0
    for found in hashes(text, shingle):
        octets, n = found.astype("<u8").view(np.uint8).reshape(-1, 8), n + len(found)
        for j in range(8):
            ones[8 * j : 8 * j + 8] += np.bincount(octets[:, j], minlength=256) @ _BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a signed long)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """Covering masks, as signed longs: any ``radius`` bits are all dropped by one of them."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1, 1 << (radius + 1)) for _ in range(WIDTH)]
    out = []
    for v in range(1, 1 << (radius + 1)):
        kept = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of a signed number numpy would count those of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (a, b) that keep the components of a run of distinct fingerprints together; at most one a member."""
    n = len(fps)
    label = np.arange(n)
    out = []
    for i in range(1, n):
        near = np.flatnonzero(apart(fps[:i], fps[i]) <= radius)
        roots, first = np.unique(label[near], return_index=True)
        for root, k in zip(roots.tolist(), first.tolist()):
            out.append((int(fps[near[k]]), int(fps[i])))
            label[label == root] = i
    return out


def _runs(batches: Iterator[pa.RecordBatch], radius: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp), sorted, to rows (a, b, k): links, or with a null b the members of runs longer than ``longest``."""
    names = ["a", "b", "k"]

    def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = ([p[i] for p in pairs] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=names)

    def members(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(k)], names=names)

    def solve(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(starts, len(k)))
        two = starts[sizes == 2]
        two = two[apart(fp[two], fp[two + 1]) <= radius]
        pairs = list(zip(fp[two].tolist(), fp[two + 1].tolist()))
        for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if m <= longest:
                pairs += forest(fp[s : s + m], radius)
            else:
                yield members(k[s : s + m], fp[s : s + m])
        if pairs:
            yield links(pairs)

    k, fp, long_key = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        k, fp = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate((k, fp)))
        if long_key is not None:
            n = int(np.searchsorted(k != long_key, True)) if (k != long_key).any() else len(k)
            if n:
                yield members(k[:n], fp[:n])
            k, fp = k[n:], fp[n:]
            if len(k):
                long_key = None
        if not len(k):
            continue
        last = int(np.argmax(k == k[-1]))
        yield from solve(k[:last], fp[:last])
        k, fp = k[last:], fp[last:]
        if len(k) > longest:  # a long run is passed on as it comes, not gathered
            long_key = k[0]
            yield members(k, fp)
            k, fp = k[:0], fp[:0]
    yield from solve(k, fp)


def links(fps: DataFrame, radius: int = RADIUS, longest: int = RUN) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that keep exactly the components of all linked pairs."""
    rows, out = fps.select(F.lit(0).cast("long").alias("k"), "fp"), None
    # Each level keeps half of the bits that the level before left free, so the fourth meets a dozen free bits at most.
    for level in range(4):
        table = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks(radius, level + 1)])).alias("v", "mask")
        keyed = rows.select("k", "fp", table).select(F.xxhash64("k", "v", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "fp")
        limit = longest if level < 3 else 1 << 62
        found = keyed.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(lambda it, limit=limit: _runs(it, radius, limit), "a long, b long, k long")
        found = materialize(found, f"links{level}")
        near = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = near if out is None else out.unionByName(near)
        rows = found.where("b is null").select("k", F.col("a").alias("fp")).distinct()
        if rows.isEmpty():
            break
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of ``edges`` (a, b), without the roots; star contraction."""
    state, before = materialize(edges.select("a", "b").where("a <> b").distinct(), "stars"), None
    while True:
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # Every larger neighbour of a node moves to the node's smallest neighbour.
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Now a > b; the smaller neighbours of a node, and itself, move to the smallest of them.
        low = moved.groupBy("a").agg(F.min("b").alias("low"))
        near = moved.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        state = materialize(near.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "stars")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root, component_id for each distinct fingerprint of ``rows`` (doc_id, fp)."""
    per = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    star = components(links(per.select("fp"), radius))
    rooted = per.join(star, per["fp"] == star["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(best, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), fp (the same as a long)."""
    rows = materialize(fingerprints(docs), "fingerprints")
    found = rows.join(classes(rows, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest doc_id stays, all columns kept."""
    docs, file, row = placed(docs, "dedup-input")
    keyed = docs.select(F.col("doc_id").cast("long"), file.alias("file"), row.alias("row"), F.col("text").cast("binary").alias("text"))
    rows = materialize(keyed.mapInArrow(_hashed, "doc_id long, file long, row long, fp long"), "fingerprints")
    return at_places(docs, file, row, _least(rows.join(classes(rows, radius), "fp")))


def _least(found: DataFrame) -> DataFrame:
    """file, row of the row with the smallest id of each root of ``found`` (doc_id, file, row, root); of rows with that id the first."""
    place = F.struct("file", "row")
    best = found.groupBy("root").agg(F.min_by(place, F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("kept"))
    return best.select("kept.file", "kept.row")


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes(text, STAGE_SHINGLE)]))


def set_key(held: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as digest

    return digest(held.tobytes(), 7)


def _salts(n: int) -> np.ndarray:
    draw = random.Random(5)
    return np.array([draw.getrandbits(64) for _ in range(n)], np.uint64)


def wide_fingerprint(held: np.ndarray, salts: np.ndarray = _salts(OCTETS // 8)) -> np.ndarray:
    """The SimHash of a set of hashes, in ``OCTETS`` octets: a bit is 1 if it is in over half of them, each mixed with a salt for every 64 bits."""
    ones = np.zeros(8 * OCTETS, np.int64)
    for at in range(0, len(held), 255):
        mixed = (held[at : at + 255, None] ^ salts) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(29)
        ones += _SPREAD[mixed.astype("<u8").view(np.uint8)].sum(axis=0).astype("<u8").view(np.uint8)
    return np.packbits(2 * ones > len(held), bitorder="little")


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, file, row, text) to (doc_id, file, row, key, n, fp): the hash and size of the set of shingles, and its fingerprint."""
    for batch in batches:
        keys, sizes, fps = [], [], []
        for text in batch.column(3):
            held = shingle_set(text.as_py() or b"")
            keys.append(set_key(held))
            sizes.append(len(held))
            fps.append(wide_fingerprint(held).tobytes())
        own = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own], names=["doc_id", "file", "row", "key", "n", "fp"])


_TABLE_ROW = ["place", "key", *[f"w{k}" for k in range(WORDS)]]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, fp, more) to a row for each octet: place (table, octet and n in one), key, first words of the fingerprint, more."""
    for batch in (part for whole in batches for part in slices(whole)):
        m = batch.num_rows
        fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(m, OCTETS)
        place = (np.arange(OCTETS) * 256 + fp.astype(np.int64) << 32) + batch.column(1).to_numpy()[:, None]
        words = np.ascontiguousarray(fp[:, : 8 * WORDS]).view("<i8")
        each = [np.repeat(c, OCTETS) for c in (batch.column(0).to_numpy(), *words.T, *(c.to_numpy() for c in batch.columns[3:]))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (place.ravel(), *each)], names=[*_TABLE_ROW, *batch.schema.names[3:]])


def _near(rows: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i < j) of close fingerprints (row by row, in words) whose sizes ``n``, ascending, allow the similarity; a block at once."""
    ends = np.searchsorted(SIMILAR * n, n, "right")
    columns = [np.ascontiguousarray(c) for c in rows.view(np.uint64).T]
    for s in range(0, len(n), 128):
        e = min(len(n), s + 128)
        for c in range(s, int(ends[e - 1]), 2048):
            f = min(int(ends[e - 1]), c + 2048)
            some = sum(np.bitwise_count(w[s:e, None] ^ w[c:f]) for w in columns[: WORDS // 2])
            i, j = np.nonzero(some <= FAR_HALF)
            i, j = i + s, j + c
            i, j = (x[(i < j) & (j < ends[i])] for x in (i, j))
            good = sum(np.bitwise_count(w[i] ^ w[j]) for w in columns) <= FAR
            if good.any():
                yield i[good], j[good]


def _close(batches: Iterator[pa.RecordBatch], rooted: bool) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_tables`, sorted, to pairs (a, b) of close keys, with the lesser and the greater of their spots (0 without any).

    First each row with its first close one before and after it, so all that have company are there; ``rooted``: all with another root.
    """
    root, spot = len(_TABLE_ROW), len(_TABLE_ROW) + 1

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, np.diff(rows[:, 0] >> 32) != 0)) if len(rows) else []
        for s, e in zip(starts, [*starts[1:], len(rows)]):
            own, n, table = rows[s:e], rows[s:e, 0] & 0xFFFFFFFF, int(rows[s, 0] >> 40)
            words = np.ascontiguousarray(own[:, 2 : 2 + WORDS])
            octets = words.view(np.uint8)[:, :table]
            before, after = np.full(e - s, -1), np.full(e - s, -1)
            for i, j in _near(words, n):
                if rooted:
                    # Those that agree in an earlier octet meet there.
                    new = (own[i, root] != own[j, root]) & ~(octets[i] == octets[j]).any(axis=1)
                    if new.any():
                        yield pairs(own[i[new]], own[j[new]])
                else:
                    for at, one, other in ((after, i, j), (before, j, i)):
                        u, k = np.unique(one, return_index=True)
                        at[u] = np.where(at[u] < 0, other[k], at[u])
            for at in (before, after):
                if (at >= 0).any():
                    yield pairs(own[at >= 0], own[at[at >= 0]])

    def pairs(one: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        ends = [(r[:, 1], r[:, spot] if r.shape[1] > spot else np.zeros(len(r), np.int64)) for r in (one, other)]
        return pa.RecordBatch.from_arrays([pa.array(f(*x)) for x in zip(*ends) for f in (np.minimum, np.maximum)], names=["a", "b", "low", "high"])

    def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, waiting = [], 0
        for some in solve(rows):
            found.append(some)
            waiting += some.num_rows
            if waiting > 1 << 16:
                yield pa.concat_batches(found)
                found, waiting = [], 0
        if found:
            yield pa.concat_batches(found)

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        last = int(np.argmax(rows[:, 0] >> 32 == rows[-1, 0] >> 32))
        if held and (last or held[0][0, 0] >> 32 != rows[0, 0] >> 32):  # else the run goes on
            yield from joined(np.concatenate([*held, rows[:last]]))
            held = []
        elif last:
            yield from joined(rows[:last])
        held.append(rows[last:])
    if held:
        yield from joined(np.concatenate(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            held = shingle_set(text.as_py() or b"")
            key = pa.array(np.array([set_key(held)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held.view(np.int64)))], names=["key", "held"])


def _met(nodes: DataFrame, rooted: bool) -> DataFrame:
    """a, b, low, high of :func:`_close`, a pair once or more, of ``nodes`` (key, n, fp; if ``rooted`` root, and spot where there is one)."""
    more = [c for c in ("root", "spot") if rooted and c in nodes.columns]
    each = nodes.select("key", "n", "fp", *more).mapInArrow(lean(_tables), ", ".join(f"{c} long" for c in [*_TABLE_ROW, *more]))
    met = each.repartition(F.shiftright("place", 32)).sortWithinPartitions("place", "key")
    return met.mapInArrow(lean(lambda it: _close(it, rooted)), "a long, b long, low long, high long")


def close_pairs(nodes: DataFrame, rooted: bool = False) -> DataFrame:
    """Pairs (a < b) of the keys of ``nodes`` (key, n, fp, root) whose fingerprints are close; see :func:`_close` for which."""
    return _met(nodes, rooted).select("a", "b").distinct()


def spots(nodes: DataFrame, pairs: DataFrame, room: int = SPOT) -> DataFrame:
    """key, spot of ``nodes`` (key, n): sets that ``pairs`` connect share a spot, of ``room`` or about as much.

    Small families share a spot with others, large ones are spread over several.  Which set is where only decides how often sets move.
    """
    family = components(pairs).toDF("key", "family")
    taken = nodes.select("key", (F.col("n") + ASIDE).alias("room"))
    held = materialize(taken.join(family, "key", "left").withColumn("family", F.coalesce("family", "key")), "families")
    bins = max(1, -(-(held.agg(F.sum("room")).first()[0] or 0) // room))
    size = held.groupBy("family").agg(F.sum("room").alias("size"))
    own = F.xxhash64("family", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / room)))
    spot = F.when(F.col("size") > room, own).otherwise(F.xxhash64(F.pmod(F.xxhash64("family"), F.lit(bins))))
    return held.join(size, "family").select("key", spot.alias("spot"))


def _similar(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs (a, b) of a place whose ``sets`` (key, held) have the similarity."""
    begin()
    try:
        order = np.argsort(keys := sets.column("key").to_numpy(), kind="stable")
        held = sets.column("held").combine_chunks()
        ends = np.append(0, np.cumsum(sizes := np.diff(held.offsets.to_numpy())))
        distinct, ids = np.unique(held.flatten().to_numpy(), return_inverse=True)
        at = [order[np.searchsorted(keys, pairs.column(c).to_numpy(), sorter=order)] for c in ("a", "b")]
        by = np.argsort(at[0], kind="stable")
        a, b = (x[by] for x in at)
        mark, good = np.zeros(len(distinct), bool), np.zeros(len(a), bool)
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
        for s, e in zip(starts, [*starts[1:], len(a)]):
            own = ids[ends[a[s]] : ends[a[s] + 1]]
            mark[own] = True
            for k in range(s, e):
                shared = np.count_nonzero(mark[ids[ends[b[k]] : ends[b[k] + 1]]])
                good[k] = shared >= SIMILAR * (sizes[a[k]] + sizes[b[k]] - shared)
            mark[own] = False
        return pairs.select(["a", "b"]).take(pa.array(by[good]))
    finally:
        give_back()


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, place; materialized) whose ``sets`` (key, held) have the similarity, exactly.

    A set goes once to each place where it is in a pair, however many pairs it has there.
    """
    needed = materialize(pairs.select("place", F.explode(F.array("a", "b")).alias("key")).distinct(), "needed")
    there = sets.join(small_side(needed, needed.count()), "key").select("place", "key", "held")
    return pairs.groupBy("place").cogroup(there.groupBy("place")).applyInArrow(_similar, "a long, b long")


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates, all columns: linked are texts whose sets of five-word runs have a Jaccard similarity of ``SIMILAR``.

    Texts of equal sets are one node with one SimHash fingerprint.  Nodes that agree in an octet of it are compared, and pairs that are
    close are verified by their shingles: first each node with its neighbours in an octet, then those that still are in different
    components with each other, so many variations of a text don't meet in pairs.  Texts stay where they are: what moves are
    fingerprints, and the sets of shingles of texts that have company, once to each place where families of them are verified.
    """
    docs, file, row = placed(docs, "dedup-input")
    keyed = docs.select(F.col("doc_id").cast("long"), file.alias("file"), row.alias("row"), F.col("text").cast("binary").alias("text"))
    rows = materialize(keyed.mapInArrow(lean(_wide), "doc_id long, file long, row long, key long, n long, fp binary"), "wide-fingerprints")
    # Sets of fewer than four shingles are only similar if they are equal.
    some = rows.where(F.col("n") >= SIMILAR * (F.col("n") + 1)).groupBy("key").agg(F.min_by(F.struct("file", "row", "n", "fp"), F.struct("file", "row")).alias("one"))
    nodes = some.select("key", "one.file", "one.row", "one.n", "one.fp")
    asked = materialize(close_pairs(nodes), "close")
    company = asked.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    nodes = materialize(nodes.join(company, "key"), "company")
    # One text for each set that has company; its shingles are the same for every text of the set.
    texts = at_places(docs, file, row, nodes.select("file", "row"))
    sets = materialize(texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(_sets), "key long, held array<long>"), "shingle-sets")
    where = materialize(spots(nodes, asked), "spots")
    place = F.xxhash64(F.least("low", "high"), F.greatest("low", "high")).alias("place")
    near = small_side(where, where.count())
    both = asked.join(near.toDF("a", "low"), "a").join(near.toDF("b", "high"), "b")
    first = materialize(similar_pairs(materialize(both.select("a", "b", place), "asked"), sets), "near")
    star = components(first).toDF("key", "root")
    rooted = nodes.join(near, "key").join(star, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # A pair that was asked before does no harm, nor one that is there twice; to find them would move all pairs once more.
    second = similar_pairs(materialize(_met(rooted, True).select("a", "b", place), "rooted"), sets)
    star = components(first.unionByName(second)).toDF("key", "root")
    return at_places(docs, file, row, _least(rows.drop("fp").join(star, "key", "left").withColumn("root", F.coalesce("root", "key"))))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(3)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], names=["doc_id", "file", "row", "fp"])
