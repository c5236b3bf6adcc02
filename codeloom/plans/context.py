"""Relevance ranking: keyword scores damped by document frequency, then one hop along dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.fixed import CHANGED, FOLLOW_BASE, FOLLOW_SHARE, HUB_DEPENDENTS, NAME_POINTS, RECENT, ROOT_SCORE
from codeloom.functions.text import bound, framework_bonus, match_level, name_words
from codeloom.operators.lookup import in_degree
from codeloom.sources.bindings import Graph


def document_frequency(g: Graph, keywords: list[str]) -> DataFrame:
    """keyword, df: files whose path or a symbol name of which matches. One pass over each relation."""
    hits = lambda words: bound(words, lambda ws: F.array_compact(F.array(*(F.when(match_level(ws, k) > 0, k) for k in keywords))))
    paths = g.files.select("id", F.explode(hits(name_words(F.col("path")))).alias("keyword"))
    names = g.symbols.select(F.col("file_id").alias("id"), F.explode(hits(name_words(F.col("name")))).alias("keyword"))
    return paths.union(names).groupBy("keyword").agg(F.countDistinct("id").alias("df"))


def weights(g: Graph, keywords: list[str]) -> dict[str, float]:
    """At most forty keywords, so the driver holds their weights."""
    df = {r.keyword: r.df for r in document_frequency(g, keywords).collect()}
    return {k: min(1.0, 8.0 / max(df.get(k, 0), 1)) for k in keywords}


def _sum(terms: list[Column]) -> Column:
    """In list order, so that sums are reproducible."""
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def path_bonus(path: Column, w: dict[str, float]) -> Column:
    return bound(name_words(path), lambda pw: _sum([F.when(match_level(pw, k) > 0, x).otherwise(0.0) for k, x in w.items()]))


def symbol_scores(g: Graph, w: dict[str, float]) -> DataFrame:
    rows = g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    rows = rows.select("id", "file_id", "name", "path", name_words(F.col("name")).alias("nw"), name_words(F.col("signature")).alias("sw"), name_words(F.col("path")).alias("pw"))
    points = F.create_map(*(F.lit(x) for pair in NAME_POINTS.items() for x in pair))
    terms = [F.lit(x) * (F.coalesce(points[match_level(F.col("nw"), k)], F.lit(0.0)) + F.when(match_level(F.col("sw"), k) > 0, 1.0).otherwise(0.0) + F.when(match_level(F.col("pw"), k) > 0, 1.0).otherwise(0.0)) for k, x in w.items()]
    return rows.select("id", "file_id", "name", "path", _sum(terms).alias("score")).filter("score > 0")


def file_scores(g: Graph, w: dict[str, float], changed: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """changed: paths that differ from the last commit; recent: paths written after the index. Both only add to the
    scores of files that a keyword matches."""
    best = symbol_scores(g, w).groupBy("file_id").agg(F.max("score").alias("best"))
    rows = g.files.select(F.col("id").alias("file_id"), "path").join(best, "file_id", "left").join(in_degree(g), "file_id", "left")
    rows = rows.withColumn("keys", path_bonus(F.col("path"), w)).withColumn("frame", framework_bonus(F.col("path")))
    score = F.when(F.col("best").isNotNull(), F.col("best") + F.col("keys") + F.col("frame") + F.coalesce("bonus", F.lit(0.0))).when(F.col("keys") > 0, F.col("keys") + F.col("frame") * 0.5)
    extra = F.lit(0.0)
    for name, points, paths in (("recent", RECENT, recent), ("changed", CHANGED, changed)):
        if paths is not None:
            rows = rows.join(paths.select("path").distinct().withColumn(name, F.lit(points)), "path", "left")
            extra = extra + F.coalesce(name, F.lit(0.0))
    return rows.select("file_id", "path", (score + extra).alias("score")).filter("score IS NOT NULL")


def candidates(g: Graph, keywords: list[str]) -> DataFrame:
    """Files by the sum of their symbols' scores, no keyword weighing more than another."""
    total = symbol_scores(g, dict.fromkeys(keywords, 1.0)).groupBy("file_id", "path").agg(F.sum("score").alias("score"))
    return total.orderBy(F.desc("score"), "path")


def follow(g: Graph, scores: DataFrame, reverse: bool = False, recent: DataFrame | None = None) -> DataFrame:
    """Files one hop from a root of scores, with the score of the hop; dependents of large hubs only if they are hubs,
    too."""
    roots = scores.filter(F.col("score") >= ROOT_SCORE).select(F.col("file_id").alias("root"), "score")
    here, there = ("target_file_id", "source_file_id") if reverse else ("source_file_id", "target_file_id")
    hops = g.edges().select(F.col(here).alias("root"), F.col(there).alias("file_id"))
    degree = in_degree(g)
    if reverse:
        size = degree.select(F.col("file_id").alias("root"), F.col("rows").alias("dependents"))
        hops = hops.join(size, "root").join(degree.select("file_id", "rows"), "file_id", "left").filter((F.col("dependents") <= HUB_DEPENDENTS) | (F.col("rows") >= 2)).select("root", "file_id")
    top = hops.join(roots, "root").groupBy("file_id").agg(F.max("score").alias("parent"))
    out = top.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").join(degree, "file_id", "left")
    score = F.lit(FOLLOW_BASE) + F.lit(FOLLOW_SHARE) * F.col("parent")
    if recent is not None:
        out = out.join(recent.select("path").distinct().withColumn("late", F.lit(RECENT)), "path", "left")
        score = score + F.coalesce("late", F.lit(0.0))
    return out.select("file_id", (score + F.coalesce("bonus", F.lit(0.0))).alias("score"))
