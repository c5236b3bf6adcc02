"""Import resolution as one join of candidate paths with the files relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.fixed import PROBED_BASES, PROBED_ENDINGS

CANDIDATE = 1000  # ranks of endings stay below: an earlier candidate wins with any ending


def file_keys(files: DataFrame) -> DataFrame:
    """(key, rank, mode, bare, path): what a file can be imported as. Rather than each import probing some 150 paths,
    each file states its at most seven names: itself, itself without its ending, its folder. bare: only specifiers
    without a source ending may be completed this way."""
    base, ending = F.regexp_extract("path", r"^(?:.*/)?([^/]*)\.[^./]*$", 1), F.regexp_extract("path", r"\.([^./]+)$", 1)
    endings, bases = F.array(*map(F.lit, PROBED_ENDINGS)), F.array(*map(F.lit, PROBED_BASES))
    e, b = F.array_position(endings, ending).cast("int"), F.array_position(bases, base).cast("int")
    stem, folder = F.regexp_replace("path", r"\.[^./]+$", ""), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)

    def name(key, rank, mode: str, when, bare: bool = False):
        return F.when(when, F.struct(key.alias("key"), rank.cast("int").alias("rank"), F.lit(mode).alias("mode"), F.lit(bare).alias("bare")))

    own, one = F.col("path"), F.lit(0)
    names = F.array(
        *(name(own, one, mode, F.lit(True)) for mode in ("any", "rust")),
        name(own, F.lit(1), "go", F.lit(True)),
        name(stem, e, "any", e > 0, True),
        name(folder, F.lit(20) + b * len(PROBED_ENDINGS) + e, "any", (e > 0) & (b > 0)),
        name(stem, F.lit(1), "rust", ending == "rs"),
        name(folder, F.lit(2), "rust", own.rlike(r"/mod\.rs$")),
        name(stem, one, "go", ending == "go"),
        name(folder, F.lit(2), "go", ending == "go"),
    )
    return files.select("path", F.explode(F.array_compact(names)).alias("name")).select("path", "name.*")


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges: path, n (place in the file), raw, imported_symbol, type, candidates, mode, fallback. The same without
    candidates, with target_path (null if none) and resolution: internal, external or unresolved.

    Each candidate meets the files by key, then the best hit of an edge wins: candidate first, then ending, then path.
    A key that many files share (a Go package) keeps only its best file before the join. Spark's estimate of the names
    is that of the files' compressed columns, so the hint keeps the table of names from being sent through the driver."""
    keys = file_keys(files).groupBy("key", "mode", "bare").agg(F.min(F.struct("rank", "path")).alias("best"))
    tries = edges.select("path", "n", "mode", F.posexplode("candidates").alias("place", "key"))
    has_ending = F.regexp_extract("key", r"\.([^./]+)$", 1).isin(PROBED_ENDINGS)
    hits = tries.join(keys.hint("merge"), ["key", "mode"]).filter(~F.col("bare") | ~has_ending)
    best = hits.groupBy("path", "n").agg(F.min(F.struct((F.col("place") * CANDIDATE + F.col("best.rank")).alias("rank"), F.col("best.path").alias("target"))).alias("hit"))
    out = edges.join(best, ["path", "n"], "left").withColumn("target_path", F.col("hit.target"))
    return out.withColumn("resolution", F.when(F.col("target_path").isNotNull(), "internal").otherwise(F.col("fallback"))).drop("hit", "candidates", "mode", "fallback")
