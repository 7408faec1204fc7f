"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(text: Column) -> Column:
    """Tokens of identifiers and paths: split at case changes, signs and digits' ends; lower case, two letters at least."""
    parts = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(parts), r"[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def query_tokens(text: Column) -> Column:
    """Tokens of a query: short ones and underscores stay."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"), lambda t: t != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")


def trigrams(text: Column) -> Column:
    runs = lambda c: F.when(F.size(c) >= 3, F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat_ws("", F.slice(c, i, 3)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(bind(F.split(text, ""), runs))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row: inside a lambda a plain expression would be computed at every step."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct runs of k words; of fewer words the whole sequence."""

    def runs(t: Column) -> Column:
        # Single words by their places: a slice would copy them into an array for each run.
        many = F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(k)]))
        return F.when(F.size(t) >= k, many).when(F.size(t) > 0, F.array(F.concat_ws(" ", t))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(bind(tokens, runs))


def shingle_hashes(tokens: Column, k: int = 5) -> Column:
    """:func:`shingles` as distinct 64-bit hashes of their words' hashes; no run is written out as text."""

    def runs(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(bind(F.transform(tokens, lambda w: F.xxhash64(w)), runs))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def clone_tokens(text: Column) -> Column:
    """Code with names, numbers and strings folded: identifiers to v, numbers to 0, strings to s, keywords kept."""
    t = F.regexp_replace(text, r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", " \u0001 ")
    t = F.regexp_replace(t, r"\b\d[\w.]*", " \u0002 ")
    found = F.regexp_extract_all(t, F.lit(r"[A-Za-z_]\w*|\u0001|\u0002|[-+*/%=<>!&|^~:?.]+|[()\[\]{};,]"), F.lit(0))
    keep = F.array(*map(F.lit, KEYWORDS))
    return F.transform(found, lambda w: F.when(w == "\u0001", "s").when(w == "\u0002", "0").when(w.rlike(r"^[A-Za-z_]") & ~F.array_contains(keep, w), "v").otherwise(w))


KEYWORDS = ("break", "case", "class", "const", "continue", "def", "default", "defer", "elif", "else", "enum", "except", "finally", "fn", "for", "func", "function", "go", "if", "impl", "import", "in", "interface", "let", "match", "nil", "none", "not", "null", "or", "package", "range", "return", "select", "self", "struct", "switch", "this", "throw", "trait", "try", "type", "var", "while", "with", "yield", "true", "false")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def stemmed(tokens: Column) -> Column:
    """Tokens without stop words; ASCII words of four letters or more lose the endings of plurals and participles."""
    kept = F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))

    def stem(t: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "sses$", "ss"), "ies$", "i"), "([^s])s$", "$1")
        cut = F.regexp_replace(F.regexp_replace(cut, "(..[aeiouy].*)ing$", "$1"), "(..[aeiouy].*)ed$", "$1")
        return F.when(t.rlike("^[a-z]{4,}$"), cut).otherwise(t)

    return F.transform(kept, stem)


def last_colon(site: Column) -> tuple[Column, Column]:
    """A call site ``file:line`` at its last colon; without one the whole is the file."""
    at = F.length(site) - F.length(F.substring_index(site, ":", -1))
    return F.when(at > 0, F.substring(site, F.lit(1), at - 1)).otherwise(site), F.when(at > 0, F.substring_index(site, ":", -1)).otherwise(F.lit(""))


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def without_project(path: Column, project: Column) -> Column:
    """A path without the name of its project before it."""
    lead = F.concat(project, F.lit("/"))
    return F.when(F.startswith(path, lead), F.substring(path, F.length(lead) + 1, F.length(path))).otherwise(path)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text in UTF-8, as a long."""
    octets = F.filter(F.transform(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: F.conv(h, 16, 10).cast("long")), lambda b: b.isNotNull())
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))


def overlap(a: Column, b: Column) -> Column:
    """Shared members by the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def from_stamp(value: Column) -> Column:
    """A timestamp from seconds, milliseconds or microseconds since the epoch, by their size."""
    v = value.cast("long")
    return F.when(v > 100_000_000_000_000, F.timestamp_micros(v)).when(v > 100_000_000_000, F.timestamp_millis(v)).otherwise(F.timestamp_seconds(v))


def flat(value: Column) -> Column:
    """A value of a struct or map as text: plain ones as they are, nested ones as JSON."""
    return F.to_json(value)


def packed_shingles(hashes: Column) -> Column:
    """Hashes as hexadecimal text, eight little-endian bytes each."""
    return F.array_join(F.transform(hashes, lambda h: F.array_join(F.reverse(F.split(F.lpad(F.hex(h), 16, "0"), "(?<=\\G..)(?=.)")), "")), "")


def unpacked_shingles(text: Column) -> Column:
    parts = F.filter(F.split(text, "(?<=\\G.{16})"), lambda p: p != "")
    return F.transform(parts, lambda p: F.conv(F.array_join(F.reverse(F.split(p, "(?<=\\G..)(?=.)")), ""), 16, -10).cast("long"))
