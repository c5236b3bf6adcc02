"""Symbols that differ between two states of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.index import diff_symbols
from codeloom.parsers import parse_sources
from codeloom.sources.git import Change, Repository, supported
from codeloom.sources.scan import language_of

LARGE = 200


def _symbols(spark: SparkSession, rows: list[tuple[str, str, bytes]]) -> DataFrame:
    parsed = parse_sources(spark.createDataFrame([(p, lang, bytearray(c)) for p, lang, c in rows], "path string, language string, content binary"))
    s = parsed.select("path", F.posexplode("symbols").alias("place", "s"))
    own = F.when(F.col("s.parent").isNotNull() & (F.col("s.parent") != F.col("s.name")), F.concat("s.parent", F.lit("."), "s.name")).otherwise(F.col("s.name"))
    return s.select(F.concat("path", F.lit("\n"), own).alias("name"), "s.signature", "place", "s.start_line", "s.kind")


def symbol_diff(spark: SparkSession, repository: Repository, base: str | None = None, head: str | None = None) -> tuple[list[Change], DataFrame, bool]:
    """(changed files, path, symbol, status, signature, line of their symbols, whether the change is large). No revision
    means the working tree against the last commit, untracked files included. One revision means its merge base with
    the last commit against the working tree, without untracked files; two are compared themselves."""
    untracked = base is None
    if base and not head:
        base = repository.merge_base(base)
    changes = repository.changes(base, head, untracked)
    old, new = [], []
    for c in supported(changes):
        language = language_of(c.path)
        if c.status != "A":
            old.append((c.path, language, repository.show(base or "HEAD", c.old_path or c.path)))
        if c.status != "D":
            new.append((c.path, language, repository.show(head, c.path) if head else repository.read(c.path)))
    before, after = _symbols(spark, old), _symbols(spark, new)
    lines = after.groupBy("name").agg(F.min("start_line").alias("line"))
    rows = diff_symbols(before.select("name", "signature", "place"), after.select("name", "signature", "place")).join(lines, "name", "left")
    part = F.split("name", "\n", 2)
    return changes, rows.select(part[0].alias("path"), part[1].alias("symbol"), "status", "signature", "line").orderBy("path", "symbol", "line"), len(changes) > LARGE
