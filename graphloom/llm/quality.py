"""Quality classifier: histogram gradient-boosted trees over document statistics.

Texts are read in parts that end at white space, so a very long one is covered whole in bounded memory; ratios that need
sets of words are means over the parts, weighted by words.

Defined results: a null text is the empty text and gets a score; without labels every score is 0.95 and all documents stay;
repeated rows score alike; a null id counts as not held out; an empty table gives an empty result; other columns
are ignored by :func:`score` and kept by :func:`keep`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, lean, slices
from .gbt import Forest, fit, sigmoid
from .labelled import labelled_texts, matrix, training_labels

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Bytes of a text that are looked at together.
PART = 1 << 18
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?-()")
_STOPS, _BANGS = b".,;:?", b"!"
FEATURES = ("log_words", "word_bytes", "distinct_words", "distinct_pairs", "repeats", "top_word", "upper", "digits", "marks", "stops", "bangs", "marked_words", "upper_words", "short_words", "long_words", "repeated_lines", "line_words", "squeezed", "pipes", "distinct_ends", "worst_repeats", "worst_marked", "worst_upper", "worst_pipes", "log_bytes")


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """The text cut at white space near multiples of ``size`` (anywhere, if there is none)."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size))
        end = end if end > at else at + size
        yield text[at:end]
        at = end
    yield text[at:]


def _less(text: bytes, marks: bytes) -> int:
    return len(text) - len(text.translate(None, marks))


def _window(words: list[bytes]) -> tuple[float, float, float, float]:
    """Shares of repeated, marked, upper-case and bar words among some words in a row."""
    n, joined = len(words), b" ".join(words)
    return sum(map(eq, words, words[1:])) / n, _less(joined, _MARKS) / len(joined), _less(joined, _UPPER) / len(joined), words.count(b"|") / n


class Distinct:
    """Counts different lines, exactly but for equal 64-bit hashes: 8 bytes a line, all of them kept."""

    def __init__(self, room: int = 1 << 16):
        self.room, self.seen, self.new, self.waiting = room, np.empty(0, np.uint64), [], 0

    def add(self, lines: list[bytes]) -> None:
        from xxhash import xxh64_intdigest as digest

        self.new.append(np.fromiter(map(digest, lines), np.uint64, len(lines)))
        self.waiting += len(lines)
        if self.waiting >= max(self.room, len(self.seen) // 2):  # merged at growing sizes, so a hash is sorted a few times
            self.merge()

    def merge(self) -> None:
        self.seen = np.unique(np.concatenate([self.seen, *self.new]))
        self.new, self.waiting = [], 0

    def __len__(self) -> int:
        self.merge()
        return len(self.seen)


def statistics(text: bytes) -> list[float]:
    """The features of a text in UTF-8, in the order of ``FEATURES``."""
    total, sums, lines, worst = 0, np.zeros(12), Distinct(), np.zeros(4)
    n_lines, packed, upper, digits, marks, stops, bangs = 0, 0, 0, 0, 0, 0, 0
    for part in parts(text):
        words = part.split()
        n = len(words)
        packed += len(zlib.compress(part, 1))
        upper, digits, marks, stops, bangs = upper + _less(part, _UPPER), digits + _less(part, _DIGITS), marks + _less(part, _MARKS), stops + _less(part, _STOPS), bangs + _less(part, _BANGS)
        own = part.split(b"\n")
        n_lines += len(own)
        lines.add(own)
        if not n:
            continue
        total += n
        counts = Counter(words)
        ends = Counter(w[-1] for w in words)
        kinds = list(counts.items())
        sums += [
            sum(map(len, words)), len(counts), len(set(zip(words, words[1:]))) + 1, sum(map(eq, words, words[1:])), max(counts.values()),
            sum(c for w, c in kinds if not w[-1:].isalnum() and w[-1] < 128 and w[-1] in _MARKS), sum(c for w, c in kinds if w.isupper() and len(w) > 1),
            sum(c for w, c in kinds if len(w) < 3), sum(c for w, c in kinds if len(w) > 12), words.count(b"|"), len(ends), 1,
        ]
        for k in range(0, n, 200):
            own = words[k : k + 200]
            if len(own) >= 20:
                worst = np.maximum(worst, _window(own))
    size, w = max(1, len(text)), max(1, total)
    return [
        float(np.log1p(total)), sums[0] / w, sums[1] / w, sums[2] / w, sums[3] / w, sums[4] / w, upper / size, digits / size, marks / size, stops / w, bangs / w,
        sums[5] / w, sums[6] / w, sums[7] / w, sums[8] / w, 1 - len(lines) / max(1, n_lines), total / max(1, n_lines), packed / size, sums[9] / w,
        sums[10] / max(1.0, sums[11]), *worst.tolist(), float(np.log1p(len(text))),
    ]


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    chosen = training_labels(labels, "quality", MODULUS, HELD_OUT)
    _, x, y = matrix(labelled_texts(docs, chosen), statistics, len(FEATURES))
    return fit(x, y, prior=0.95)


def scores(model: Forest, texts: list[bytes]) -> np.ndarray:
    return sigmoid(model.margin(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)

    def run(batches):
        for batch in batches:
            found = scores(model, [t.as_py() or b"" for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long"), (id_crc("doc_id") % MODULUS == HELD_OUT).alias("held_out"), F.col("text").cast("binary"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_rows(docs: DataFrame, judge: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text ``judge`` accepts."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(judge([(t.as_py() or "").encode() for t in part.column(at)])))

    return docs.mapInArrow(lean(run), docs.schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    model = train(docs, labels)
    return keep_rows(docs, lambda texts: scores(model, texts) >= THRESHOLD)
