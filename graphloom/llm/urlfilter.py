"""URL filters by Bloom filter cascades; DataFrame functions only.

A cascade holds a list of keys over a universe: its first filter encodes the listed keys, the second those keys of the
universe that pass the first by mistake, the third the listed keys that pass the second, and so on until nothing
is mistaken.  For every key of the universe the answer is exact, and a lookup is some hashes and bits, without a join.  The
universe is all keys that the corpus can ask for: the last labels of a host, with a prefix of the path.

Defined results: a null url, or one without ``://``, has empty host and path, matches no rule and is allowed; repeated
rows are judged alike; an empty table gives an empty result; other columns are ignored; a very long url is cut only where
rules can't reach.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

#: (verdict, key); a key is a host and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    # Cut behind the first "://" beforehand: an expression for the whole would go on to a later one if no path follows.
    whole = F.coalesce(url, F.lit(""))
    after = F.when(F.contains(whole, F.lit("://")), F.substring(whole, F.locate("://", whole) + 3, F.length(whole))).otherwise(F.lit(""))
    return F.regexp_extract(after, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column, rules: list[str]) -> Column:
    """All keys that a url can ask for: its last labels, as many as some rule has, with its path cut as long as some rule's."""
    labels = sorted({r.partition("/")[0].count(".") + 1 for r in rules})
    lengths = sorted({len(r) - r.index("/") for r in rules})
    parts = F.split(host, r"\.")
    made = []
    for m in labels:
        for length in lengths:
            ok = (F.size(parts) >= m) & (F.char_length(path) >= length) & (host != "")
            made.append(F.when(ok, F.concat(F.substring_index(host, ".", -m), F.substring(path, 1, length))))
    return F.array_compact(F.array(*made))


@dataclass
class Bloom:
    """Bits of a filter, 64 to a word; ``salt`` keeps the hashes of different filters apart."""

    words: list[int]
    hashes: int
    salt: int

    def has(self, key: Column) -> Column:
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        out = F.lit(True)
        for i in range(self.hashes):
            at = F.pmod(F.xxhash64(F.lit(self.salt * 64 + i), key), F.lit(64 * len(self.words)))
            out = out & (F.get(held, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0)
        return out


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))


def bloom(keys: DataFrame, count: int, rate: float, salt: int) -> Bloom:
    """A filter of the keys (column key) with about that rate of false positives; its size follows the count alone."""
    bits = max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2))
    words, hashes = -(-bits // 64), max(1, round(bits / max(1, count) * math.log(2)))
    hashes = min(hashes, 16)
    spots = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(salt * 64 + i), "key"), F.lit(64 * words)) for i in range(hashes)])).alias("at")
    rows = keys.select(spots).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits")).collect()  # at most `words` rows
    held = [0] * words
    for r in rows:
        held[r["word"]] = r["bits"]
    return Bloom(held, hashes, salt)


def cascade(universe: DataFrame, listed: DataFrame, salt: int) -> list[Bloom]:
    """Filters that together tell the listed keys from the rest of the universe (both: column key, distinct)."""
    n, total = listed.count(), universe.count()
    if not n:
        return []
    inside, outside = listed, universe.join(small_side(listed, n), "key", "left_anti")
    levels, rate = [], min(0.5, max(1e-6, n / (max(1, total) * math.sqrt(2))))
    while True:
        level = bloom(inside, n, rate, salt + len(levels))
        levels.append(level)
        mistaken = materialize(outside.where(level.has(F.col("key"))).select("key"), "mistaken")
        inside, outside, n = mistaken, inside, mistaken.count()
        if not n:
            return levels
        rate = 0.5


def listed_in(levels: list[Bloom], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(False) if not len(levels) % 2 else F.lit(True)
    for k in reversed(range(len(levels))):
        out = F.when(levels[k].has(key), out).otherwise(F.lit(bool(k % 2)))
    return out


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict; the longest rule that fits decides."""
    spark = pages.sparkSession
    names = [k for _, k in rules]
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not names:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), names))
    universe = materialize(urls.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    salt, test = 1, {}
    for verdict in sorted({v for v, _ in rules}):
        listed = spark.createDataFrame([(k,) for k in sorted({k for v, k in rules if v == verdict})], "key string")
        test[verdict] = cascade(universe, listed, salt)
        salt += 100

    def verdict_of(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for verdict, levels in test.items():
            out = F.when(listed_in(levels, key), F.lit(verdict)).otherwise(out)
        return out

    marked = F.transform("keys", lambda k: F.struct(F.char_length(k).alias("n"), F.char_length(F.substring_index(k, "/", 1)).alias("m"), k.alias("rule"), verdict_of(k).alias("verdict")))
    best = F.array_max(F.filter(marked, lambda s: s["verdict"].isNotNull()))
    return urls.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
