"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a seed list and the words that the training labels single out, however few documents of a language are labelled;
the trees see each training row through words learnt from other rows, so a word isn't trusted for having been learnt there.  Words are compared after folding: lower case,
digits and signs that stand for letters turned back, marks inside words and zero-width characters dropped.

Defined results: a null text is the empty text and gets a score; without toxic labels scores come from the prior and
nothing is rejected; repeated rows score alike; a null id counts as held out; an empty table gives an empty result;
other columns are ignored by :func:`score` and kept by :func:`keep`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, materialize
from .gbt import Forest, fit, isotonic
from .labelled import labelled_texts, matrix, training_labels
from .quality import keep_rows, parts

MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Toxic documents that must hold a learnt word, how much likelier it must be in them, and parts of the training rows.
LEAST, LIFT, FOLDS = 3, 20, 5
SEED = frozenset("idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown clowns filth vermin dumb imbecile degenerate".split())
SECOND = frozenset("you your yours yourself u ur youre du dein deine dich dir ihr euch tu te toi ton ta tes vous votre vos tú tus ti usted ustedes vosotros".split())
FEATURES = ("hits", "log_hits", "hit_rate", "kinds", "masked", "second", "near", "upper", "bangs", "marks", "shouted", "odd_words", "odd_rate", "log_words", "hit_windows")
_FOLD = str.maketrans("013457@$!|", "oieastasil") | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
_ODD = re.compile(r"[^\W\d_][@$!*|013457\u200b-\u200d\u2060\xad._-]{1,2}[^\W\d_]")
_INNER = re.compile(r"[\W_]+")
#: Four words of one letter, or more, in a row.
_LETTERS = re.compile(rb"(?:[\x10-\x1f]|[\x30-\x3f]){4,}")
_UPPER = bytes(range(65, 91))
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\xab\xbb\u201e\u201c\u201d\u2018\u2019\u2026\xa1\xbf"
#: Words between a hit and a second person that count as near; words that a worker remembers.
NEAR, REMEMBERED = 5, 250_000


def fold(word: str) -> str:
    """A word without the disguise of signs and digits."""
    return _INNER.sub("", word.translate(_FOLD))


class Judge(dict):
    """What a word is, as bits: 1 in the lexicon, 2 and disguised, 4 second person, 8 odd, 16 one letter, 32 in capitals."""

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        low = word.lower()
        bare = low.strip(_EDGES)
        bits = 0
        if bare in self.lexicon:
            bits = 1
        elif bare in SECOND:
            bits = 4
        elif 2 < len(word) < 40 and not bare.isalpha():
            bits = 3 * (fold(bare) in self.lexicon or fold(low) in self.lexicon) | 8 * bool(_ODD.search(low))
        bits |= 16 * (len(bare) == 1 and bare.isalpha()) | 32 * (len(word) > 1 and word.isupper())
        if len(word) < 64:
            self[word] = bits
        return bits


def features(text: bytes, lexicon: frozenset[str] | Judge) -> list[float]:
    """The features of a text in UTF-8, in the order of ``FEATURES``; long texts part by part."""
    judge = lexicon if isinstance(lexicon, Judge) else Judge(lexicon)
    n = hits = masked = second = near = odd = shouted = windows = 0
    kinds: set[str] = set()
    for part in parts(text):
        words = part.decode("utf-8", "ignore").split()
        n += len(words)
        marks = bytes(map(judge.__getitem__, words))
        if not marks.strip(b"\0 "):
            continue
        bits = np.frombuffer(marks, np.uint8)
        at, to = np.flatnonzero(bits & 1), np.flatnonzero(bits & 4)
        second += len(to)
        odd += int((bits & 8 > 0).sum())
        if len(at):
            hits += len(at)
            masked += int((bits[at] & 2 > 0).sum())
            shouted += int((bits[at] & 32 > 0).sum())
            windows += len(np.unique(at // 50))
            kinds.update(fold(words[i].lower().strip(_EDGES)) for i in at.tolist())
            if len(to):
                after = np.searchsorted(to, at)
                apart = np.minimum(np.abs(to[np.minimum(after, len(to) - 1)] - at), np.abs(at - to[np.maximum(after - 1, 0)]))
                near += int((apart <= NEAR).sum())
        for run in _LETTERS.finditer(marks):
            spelled = fold("".join(words[run.start() : run.end()]).lower())
            for word in judge.lexicon:
                if len(word) > 3 and word in spelled:
                    kinds.add(word)
                    hits, masked = hits + 1, masked + 1
    size, w = max(1, len(text)), max(1, n)
    upper = len(text) - len(text.translate(None, _UPPER))
    bangs = text.count(b"!")
    signs = len(text) - len(text.translate(None, b"!?*#$%&@^~"))
    return [hits, float(np.log1p(hits)), 1000 * hits / w, len(kinds), masked, second / w, near, upper / size, bangs / w, signs / size, shouted, odd, 1000 * odd / w, float(np.log1p(n)), windows]


def learn_lexicons(rows: DataFrame) -> list[frozenset[str]]:
    """The seed with the words of labelled texts (y, fold) that are far likelier in toxic ones: of all rows, then of all but each fold.

    The count runs in the cluster; the rows, and so the words, are bounded by the number of labelled documents.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{Nd}]+"))
    each = rows.select("y", "fold", F.explode(words).alias("word")).where(F.length("word") > 2)
    outs = [None, *range(FOLDS)]
    sums = [F.sum(F.when(F.col("fold") == out, 0.0).otherwise(v)).alias(f"{n}{k}") for k, out in enumerate(outs) for n, v in (("bad", F.col("y")), ("good", 1 - F.col("y")))]
    totals, held, fits = rows.agg(*sums).first(), each.groupBy("word").agg(*sums), []
    for k in range(len(outs)):
        toxic, clean = totals[f"bad{k}"] or 0.0, totals[f"good{k}"] or 0.0
        lift = (F.col(f"bad{k}") / (toxic or 1.0)) / ((F.col(f"good{k}") + 0.5) / (clean + 1))
        fits.append((F.lit(bool(toxic and clean)) & (F.col(f"bad{k}") >= LEAST) & (lift > LIFT)).alias(f"fits{k}"))
    found = held.select("word", *fits).where(" or ".join(f"fits{k}" for k in range(len(outs)))).collect()
    return [SEED | {r["word"] for r in found if r[f"fits{k}"]} for k in range(len(outs))]


@dataclass
class Model:
    lexicon: frozenset[str]
    forest: Forest
    knots: tuple[np.ndarray, np.ndarray]

    def __post_init__(self) -> None:
        self.judge = Judge(self.lexicon)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([features(t, self.judge) for t in texts], float).reshape(-1, len(FEATURES))
        return calibrated(self.forest.margin(x), self.knots)


def calibrated(margin: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Isotonic probabilities; a slope of a thousandth keeps the order of rows within a step."""
    rest = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    return np.clip(0.999 * np.interp(margin, *knots) + 0.001 * rest, 0, 1) if len(knots[0]) else rest


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Trees learn from three quarters of the training labels, the isotonic calibration from the rest."""
    rows = labelled_texts(docs, training_labels(labels, "toxic", MODULUS, HELD_OUT))
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")), "toxic-labels")
    lexicon, *others = learn_lexicons(rows)
    found = [matrix(rows.where(F.col("fold") == k), lambda t, judge=Judge(words): features(t, judge), len(FEATURES)) for k, words in enumerate(others)]
    ids, x, y = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((*x.T, ids))
    ids, x, y = ids[order], x[order], y[order]
    part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(4) == 0 if len(ids) else np.zeros(0, bool)
    if y[~part].sum() < 1 or y[part].sum() < 1:
        part = np.zeros(len(y), bool)
    forest = fit(x[~part], y[~part], trees=60, depth=3, least=4.0, prior=0.02)
    knots = isotonic(forest.margin(x[part]), y[part]) if part.any() else (np.empty(0), np.empty(0))
    return Model(lexicon, forest, knots)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)

    def run(batches):
        for batch in batches:
            found = model.scores([t.as_py() or b"" for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long"), (id_crc("doc_id") % MODULUS == HELD_OUT).alias("held_out"), F.col("text").cast("binary"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject."""
    model = train(docs, labels)
    return keep_rows(docs, lambda texts: model.scores(texts) < THRESHOLD)
