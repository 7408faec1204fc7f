"""Best-fit packing by minimum bin slack.

Lengths are at most the capacity, so their histogram has a bounded number of entries however large the corpus is.
The bins are planned on that histogram: the longest piece left opens a bin, a subset-sum dynamic program over bitsets
of the lengths still there finds the fullest feasible filling, and the combination is removed as often as the counts
allow.  Pieces then find their place by their rank among the pieces of the same length.

Defined results: a null text is the empty text (one piece holding only the separator); repeated rows are packed once
each; an empty table gives an empty result; other columns are ignored; a very long text is tokenized in segments, whose
ids are those of the whole; the marker of a special token in a text is that token, as the tokenizer has it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialize, offset_in, with_position

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters of a text that are tokenized at once, and units whose ids a worker remembers, in each of two generations.
SEGMENT, REMEMBERED = 1 << 20, 500_000
VOCABULARY = "byte_bpe_50k.json"
_CUT, _BEFORE, _RUNS = re.compile(r" (?=\S)"), re.compile(r"(?= \S)"), re.compile(r" \s| $")


#: The letters by which byte-level vocabularies write bytes: visible ones as they are, the others from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


class Units(dict):
    """Ids, as little-endian bytes, of units of text that begin with one space and end before the next.

    The pre-tokenizer always ends a token before a space that a visible character follows, and a special token's marker
    stands apart from the text around it, so the ids of a text are those of its units and markers, one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.before = self.tokenizer.model, {}
        special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special, self.markers = special, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def encode(self, text: str) -> bytes:
        """The tokenizer's own ids of a whole text."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.before.pop(unit, None)
        if ids is not None:
            self[unit] = ids
            return ids
        if len(self) > REMEMBERED:  # what is asked for again comes back from the generation before
            self.before = dict(self)
            self.clear()
        line = unit.find("\n")
        if len(unit) > 2 and unit[-1] in ".,;:!?" and unit[-2].isalpha():  # letters and marks are tokens apart
            ids = self[unit[:-1]] + self[unit[-1]]
        elif 0 < line < len(unit) - 1 and not unit[line - 1].isspace() and not unit[line + 1].isspace():  # a line's end is a token of its own
            ids = self[unit[:line]] + self["\n"] + self[unit[line + 1 :]]
        elif (unit[1:] if unit[:1] == " " else unit).isalpha():  # one token of the pre-tokenizer, straight to the model
            ids = np.asarray([t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(_BYTES))], dtype="<u4").tobytes()
        else:
            ids = self.encode(unit) if unit else b""
        if len(unit) < 64:
            self[unit] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """The ids of a text without markers."""
        if "  " in text or _RUNS.search(text) or "\0" in text:
            units = _BEFORE.split(text)
        else:
            units = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.__getitem__, units))

    def segment(self, text: str) -> bytes:
        out, at = [], 0
        for marker in self.markers.finditer(text):
            out += [self.plain(text[at : marker.start()]), self.special[marker[0]]]
            at = marker.end()
        return b"".join([*out, self.plain(text[at:])]) if out else self.plain(text)

    def text(self, text: str) -> bytes:
        if len(text) <= SEGMENT:
            return self.segment(text)
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            out.append(self.segment(text[at:end]))
            at = end
        return b"".join(out)


def units(name: str = VOCABULARY) -> Units:
    """The worker's own tokenizer, kept until a task of :func:`common.lean` begins."""

    def make() -> Units:
        import public_tokenizers

        return Units(public_tokenizers.path(name))

    return kept(f"units {name}", make)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc) of the pieces of a document's ids; only the first piece of several may be shorter."""
    n, out, start = len(ids) // 4, [], 0
    first = n % capacity or capacity
    length = min(n, first)
    while start < n:
        out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
        start, length = start + length, capacity
    return out


def _tokenize(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    own = units(vocabulary)
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for piece, (start, length, crc) in enumerate(pieces_of(own.text(text.as_py() or "") + b"\0\0\0\0", capacity)):
                for column, value in zip(columns, (doc_id, piece, start, length, crc)):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The token pieces of each document; texts never leave the partition that read them."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _tokenize(it, capacity, vocabulary), PIECES)


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum comes nearest to ``room`` from below; ``available``: (length, count), longest first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in available:
        left = min(count, room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            grown = (reach | (reach << (length * times))) & mask
            if grown != reach:
                steps.append((length, times, reach))
                reach = grown
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            used[length] = used.get(length, 0) + times
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of (length, times) with how many bins follow each."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    order = sorted(counts, reverse=True)
    while counts:
        longest = next(x for x in order if x in counts)
        order = order[order.index(longest) :]
        counts[longest] -= 1
        rest = fullest([(x, counts[x]) for x in order if counts.get(x, 0) and x <= capacity - longest], capacity - longest)
        counts[longest] += 1
        pattern = dict(rest)
        pattern[longest] = pattern.get(longest, 0) + 1
        copies = min(counts[x] // k for x, k in pattern.items())
        out.append((sorted(pattern.items(), reverse=True), copies))
        for x, k in pattern.items():
            counts[x] -= k * copies
            if not counts[x]:
                del counts[x]
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted by length and first rank."""
    rows, used, sequence = [], {}, 0
    for pattern, copies in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = table[:, 0] * (1 << 48) + table[:, 1]
    for batch in batches:
        if not batch.num_rows:
            continue
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        row = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
        inside = rank - row[:, 1]
        sequence, offset = row[:, 3] + inside // row[:, 2], row[:, 4] + inside % row[:, 2] * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs all documents; returns the pieces with ``sequence_id`` and ``offset``."""
    cut = materialize(with_position(pieces(docs, capacity, vocabulary)), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(plan_bins(histogram, capacity))
    ranked = offset_in(cut, ["length"], "rank").select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(lambda it: _place(it, table), PIECES + ", sequence_id long, offset long")
