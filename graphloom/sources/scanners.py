"""Scanners that turn texts into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

TODO = r"(TODO|FIXME|HACK)(?:\(([\w.-]+)\))?(?:\[(\d{4}-\d{2}-\d{2})\])?\s*[(:]\s*(.*)"


def todos(files: DataFrame, longest: int = 200) -> DataFrame:
    """(id, line, tag, assignee, due, ticket, text) of the marks in files (id, text)."""
    lines = files.select("id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(F.col("raw").rlike(r"(TODO|FIXME|HACK)[(:\[]"))
    part = lambda k: F.nullif(F.regexp_extract("raw", TODO, k), F.lit(""))
    return lines.select("id", (F.col("line") + 1).alias("line"), part(1).alias("tag"), part(2).alias("assignee"), part(3).cast("date").alias("due"), F.nullif(F.regexp_extract("raw", r"#([A-Z]+-\d+)", 1), F.lit("")).alias("ticket"), F.substring(F.regexp_extract("raw", TODO, 4), 1, longest).alias("text"))


def license_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, license) of the first licence line of a document."""
    name = F.regexp_extract("text", r"(?i)licensed under (?:the )?([A-Z][A-Za-z0-9 .-]*)", 1)
    return docs.where(F.col("text").rlike(r"(?i)licensed under (?:the )?[A-Z]")).select("doc_id", name.alias("license"))


def spdx(files: DataFrame, head: int = 4096) -> DataFrame:
    """(id, license) of the identifier in a file's head."""
    return files.select("id", F.nullif(F.regexp_extract(F.substring("text", 1, head), r"SPDX-License-Identifier:\s*([\w.+-]+)", 1), F.lit("")).alias("license")).where("license IS NOT NULL")


def is_binary(text: Column) -> Column:
    """A NUL among the first 8000 bytes."""
    return F.contains(F.substring(text, 1, 8000), F.lit("\0"))


def hrefs(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def routes(pages: DataFrame) -> DataFrame:
    """(page_id, method, route) with numbers in paths replaced by a parameter."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(/[^?#]*)", 1)
    return pages.select("page_id", F.lit("GET").alias("method"), F.regexp_replace(path, r"/[0-9]+(\.html)?(/|$)", "/{id}$2").alias("route"))


def env_vars(files: DataFrame) -> DataFrame:
    """(id, name) of the environment variables that files (id, text) read."""
    found = F.regexp_extract_all("text", F.lit(r"(?:getenv\(|environ\[|process\.env\.|env!\()[\"']?([A-Z][A-Z0-9_]*)"), F.lit(1))
    return files.select("id", F.explode(F.array_distinct(found)).alias("name"))


def owners(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(id, owner) of files (id, path): the last rule whose pattern fits wins."""
    from ..operators.filters import glob

    out = F.lit(None).cast("string")
    for pattern, owner in rules:
        fit = glob(pattern.strip("/") + ("**" if pattern.endswith("/") else ""))
        anchored = fit if "/" in pattern.strip("/") or pattern.startswith("/") else fit.replace("^", "(?:^|/)", 1)
        out = F.when(F.col("path").rlike(anchored), F.lit(owner)).otherwise(out)
    return files.select("id", out.alias("owner"))


def coverage(lines: DataFrame) -> DataFrame:
    """(file, lo, hi, stmts, hits) of coverage lines (value); malformed ones are skipped."""
    form = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)$"
    part = lambda k: F.regexp_extract("value", form, k)
    return lines.where(F.col("value").rlike(form)).select(part(1).alias("file"), part(2).cast("int").alias("lo"), part(3).cast("int").alias("hi"), part(4).cast("long").alias("stmts"), part(5).cast("long").alias("hits"))


def fixes(commits: DataFrame) -> DataFrame:
    """Commits (sha, subject, ...) that mend something, by their subject."""
    return commits.where(F.col("subject").rlike(r"(?i)\b(fix(e[sd])?|bug|hotfix|regression|crash)\b"))


def citations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, hits): items (item_id, text) that documents hold word for word.

    Both sides meet on the hash of four words in a row, the first of the item and any of the document; then the whole item is compared.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    words = docs.select("doc_id", "text", split(F.col("text")).alias("w"))
    runs = bind(F.col("w"), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 4))))
    key = items.select("item_id", F.col("text").alias("item"), F.xxhash64(F.slice(split(F.col("text")), 1, 4)).alias("k"))
    near = words.select("doc_id", "text", F.explode(F.array_distinct(runs)).alias("k")).join(key, "k").where(F.contains("text", F.col("item")))
    return near.select("doc_id", "item_id", ((F.length("text") - F.length(F.replace("text", F.col("item"), F.lit("")))) / F.length("item")).cast("long").alias("hits")).distinct()
