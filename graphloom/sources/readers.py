"""Readers of what surrounds code: histories, releases, query logs, queries in strings, rules, and detectors over texts."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"([A-Za-z_][\w.]*)"
#: What an SQL text does to a table, and how it begins.
SQL_FORMS = {"reads": rf"(?i)\b(?:from|join)\s+{_NAME}", "writes": rf"(?i)\b(?:insert\s+into|update|delete\s+from)\s+{_NAME}", "defines": rf"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}"}


def sql_tables(queries: DataFrame) -> DataFrame:
    """(id, table, access) of queries (id, sql); texts that name no table give no row, repeats one."""

    def of(access: str, form: str) -> Column:
        return F.transform(F.regexp_extract_all("sql", F.lit(form), F.lit(1)), lambda t: F.struct(F.lower(t).alias("table"), F.lit(access).alias("access")))

    found = [of(access, form) for access, form in SQL_FORMS.items()]
    return queries.select("id", F.explode(F.concat(*found)).alias("f")).select("id", "f.table", "f.access").distinct()


def log_tail(lines: DataFrame, schema: str, order: str, newest: int) -> DataFrame:
    """The newest records of JSON lines (value); malformed ones are skipped."""
    read = lines.select(F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r")).where("r._corrupt IS NULL AND r IS NOT NULL").select("r.*").drop("_corrupt")
    return read.where(F.col(order).isNotNull()).orderBy(F.desc(order)).limit(newest)


def releases(tags: DataFrame) -> DataFrame:
    """(file, first_release) of tags (file, tag, at): the earliest that holds a file, of equals the smallest name."""
    return tags.groupBy("file").agg(F.min_by("tag", F.struct("at", "tag")).alias("first_release"))


def churn(nodes: DataFrame, commits: DataFrame) -> DataFrame:
    """Nodes (id, file) with the commits of their file, none being 0."""
    n = commits.groupBy("file").agg(F.count("*").alias("commits"))
    return nodes.join(n, "file", "left").select("id", "file", F.coalesce("commits", F.lit(0)).alias("commits"))


def detect(texts: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(id, rule, hits) of texts (id, text) by rules, name to pattern; one pass over the texts for all rules."""
    counts = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count("text", F.lit(p)).alias("hits")) for k, p in rules.items()])
    return texts.select("id", F.explode(F.filter(counts, lambda c: c["hits"] > 0)).alias("c")).select("id", "c.rule", "c.hits")


#: Named rules of families of detectors; further ones come from TOML.
FAMILIES: dict[str, dict[str, str]] = {"markup": {"inline_script": "<script", "tracking": r"track\(", "escaped": "&amp;"}, "links": {"relative": 'href="/', "parent": r"\.\./"}}


def family(*names: str) -> dict[str, str]:
    """The rules of some families; an unknown one is an error."""
    if bad := [n for n in names if n not in FAMILIES]:
        raise ValueError(f"unknown families: {', '.join(bad)}")
    return {f"{n}.{k}": p for n in names for k, p in FAMILIES[n].items()}


def user_rules(text: str) -> dict[str, str]:
    """Rules from TOML: a table ``rules`` with, for each, a pattern, and ``enabled = false`` for those that rest."""
    found = tomllib.loads(text).get("rules", {})
    if bad := [k for k, v in found.items() if "pattern" not in v]:
        raise ValueError(f"rules without a pattern: {', '.join(bad)}")
    return {k: v["pattern"] for k, v in found.items() if v.get("enabled", True)}


def contracts(files: DataFrame, extractors: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(id, kind, role, key) of files (id, text): extractors by kind, each a role and a pattern with one group."""

    def of(kind: str, role: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))), lambda k: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), k.alias("key")))

    found = [of(kind, role, pattern) for kind, (role, pattern) in extractors.items()]
    return files.select("id", F.explode(F.concat(*found)).alias("c")).select("id", "c.kind", "c.role", "c.key")


def assets(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of files whose rows aren't read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def grounded(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line, how): the line of a file that a finding (id, file, snippet) is about, from lines (file, line, text).

    Exact text comes first, then the same without white space, then the most shared words, then the first line.
    """
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    both = findings.join(lines, "file")
    shared = F.size(F.array_intersect(bag(F.col("snippet")), bag(F.col("text"))))
    tier = F.when(F.col("snippet") == F.col("text"), 0).when(bare(F.col("snippet")) == bare(F.col("text")), 1).when(shared > 0, 2).otherwise(3)
    best = both.withColumns({"tier": tier, "shared": F.when(tier == 2, -shared).otherwise(0)}).groupBy("id").agg(F.min(F.struct("tier", "shared", "line")).alias("b"))
    return best.select("id", "b.line", F.element_at(F.array(*map(F.lit, ("exact", "spaces", "words", "first"))), F.col("b.tier") + 1).alias("how"))


def bundle(runs: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """(analyzer, rows) of a named bundle of analyses."""
    out = None
    for n in names:
        one = runs[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("analyzer"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
