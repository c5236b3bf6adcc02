"""Index maintenance: classification of disk against index, and symbol diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SIZE = 2 * 1024 * 1024


def classify(index: DataFrame, disk: DataFrame) -> DataFrame:
    """By path: new, skipped (too large), changed, unchanged or deleted; one shuffle of both sides on the path."""
    old = index.select("path", F.col("hash").alias("old_hash"))
    new = disk.select("path", F.col("hash").alias("new_hash"), F.col("size").alias("new_size"))
    state = F.when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash").isNull(), F.when(F.col("new_size") > MAX_SIZE, "skipped").otherwise("new")).when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return old.join(new, "path", "full_outer").select("path", state.alias("state"))


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: name, signature (of one place in order). Added, Modified or Removed, by name."""
    last = old.groupBy("name").agg(F.max_by("signature", "place").alias("old_signature"), F.lit(True).alias("had"))
    both = new.join(last, "name", "left")
    status = F.when(F.col("had").isNull(), "Added").when(F.col("signature") != F.col("old_signature"), "Modified")
    changed = both.select("name", status.alias("status"), "signature").filter("status IS NOT NULL")
    return changed.union(old.join(new.select("name"), "name", "left_anti").select("name", F.lit("Removed"), F.lit(None).cast("string")))
