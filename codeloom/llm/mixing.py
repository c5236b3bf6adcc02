"""Mixing sources to target weights by capped water-filling.

Sizes are words. All sources share the total by weight; a source whose share exceeds ``most_epochs`` times its size is
clamped there and the excess goes to the others by weight, until none exceeds its cap. A source then takes all of its
documents as often as its target holds its size (whole repetitions), and once more those documents of lowest seeded hash
whose sizes fill the rest (fractional repetition); the document at the edge is taken in part, so a source meets its
target to the word.

Sources are a table throughout: their turn in code point order comes from a range sort and the counts of its partitions,
the water level from sums over the table, round by round, and only the level (two integers) comes to the driver. The edge
is found by histograms of the hash, refined for each source until its bin is small, so no task ever holds a source, and
joins on a source and a bin spread a hot source.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source, last in order; a source
of size 0 has target 0; rows that repeat a doc_id count one by one; an empty table gives an empty result; the result
of ``plan`` has its own columns only, that of ``mix`` the columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WORD, Tables, cut, shuffle_parts

#: Bits of a draw, bits that a round of histograms refines, and rows of a source's edge bin that are small enough.
DRAW, BITS, SMALL = 60, 12, 20_000


def water_level(sources: DataFrame, most_epochs: int) -> tuple[int, int]:
    """sources: s (size) and w (weight). The level as a fraction: a source's target is the lesser of its cap and its weight
    times the level. Sources over their cap stay so when the level rises, so each round adds to them until none is new."""
    clamped, total, level = None, None, (0, 1)
    while True:
        above = F.lit(most_epochs) * F.col("s") * F.lit(level[1]) < F.col("w") * F.lit(level[0])
        got = sources.agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.coalesce(F.sum(F.when(above, F.col("s"))), F.lit(0)).alias("over"), F.coalesce(F.sum(F.when(above, F.col("w"))), F.lit(0)).alias("heavy"), F.count(F.when(above, 1)).alias("n")).first()
        if got.s is None or got.n == clamped or got.w == got.heavy:
            return level
        total, clamped = int(got.s), got.n
        level = (total - most_epochs * int(got.over), int(got.w) - int(got.heavy))


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with turn, the number of a source in code point order, null last."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(shuffle_parts(sources.sparkSession), order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(counts.withColumn("before", before), "part").withColumn("turn", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).drop("part", "count", "before")


def _targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int, keep=cut) -> DataFrame:
    """sizes: source, s. name, source_size, target, whole (repetitions of all its documents) and rest (words beyond)."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    sources = cut(_numbered(sizes).withColumn("w", weight.cast("long")))
    left, heavy = water_level(sources.select(F.col("s").cast("decimal(18,0)").alias("s"), F.col("w").cast("decimal(4,0)").alias("w")), most_epochs)
    clamped = exact("s") * F.lit(most_epochs) * F.lit(heavy) < F.col("w") * F.lit(left)
    due = sources.select(F.col("source").alias("name"), F.col("s").alias("source_size"), "w", (clamped | (F.col("s") == 0)).alias("clamped"), F.lit(left).cast("long").alias("left"), F.lit(heavy).cast("long").alias("heavy"))
    due = due.withColumn("floor", F.expr("(w * left) div heavy")).withColumn("over", F.expr("(w * left) % heavy"))
    up = F.expr("CASE WHEN 2 * over > heavy OR (2 * over = heavy AND floor % 2 = 1) THEN 1 ELSE 0 END")
    due = due.withColumn("whole", F.expr(f"CASE WHEN clamped THEN {most_epochs} ELSE CAST(w * left AS DECIMAL(38,0)) div (CAST(heavy AS DECIMAL(19,0)) * source_size) END").cast("long"))
    target = F.when(F.col("clamped"), (F.col("source_size") * most_epochs).cast("double")).otherwise((F.col("w") * F.col("left")).cast("double") / F.col("heavy").cast("double"))
    rest = F.when(F.col("clamped"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least("source_size", F.col("floor") + up - F.col("whole") * F.col("source_size"))))
    return keep(due.select("name", "source_size", target.alias("target"), "whole", rest.cast("long").alias("rest")))


def _top(bits: int) -> Column:
    return F.shiftright("draw", DRAW - bits)


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 17) -> DataFrame:
    """docs is given as doc_id, source, text; per document: doc_id, size, source_size, target, taken."""
    row = docs.select(F.struct("doc_id").alias("row"), "doc_id", "source", "text")
    return _planned(row, weights, most_epochs, seed, True).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs; the edge document of a source
    is taken whole if at least half of it is due."""
    row = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    times = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int")
    got = _planned(row, weights, most_epochs, seed).filter("size > 0").withColumn("times", times).filter("times > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def _planned(rows: DataFrame, weights: tuple[int, ...], most_epochs: int, seed: int, slim_only: bool = False) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id", "text")), 1, DRAW // 4), 16, 10).cast("long")
    sized = rows.select("row", "doc_id", "source", size.alias("size"), draw.alias("draw"))
    slim = cut(sized.drop("row"))  # words are counted once for the plan
    sized = slim if slim_only else sized
    keep = Tables(rows.sparkSession).keep  # files, whose size lets Spark send a small table of sources to all tasks
    state = _targets(slim.groupBy("source").agg(F.sum("size").alias("s")), weights, most_epochs, keep)
    mine = F.col("source").eqNullSafe(F.col("name"))
    # edge: the bin in which a source's rest ends, or the one after the last; below: words in the bins before it
    state, bits = state.withColumn("edge", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), 0
    while bits < DRAW:
        here = slim.withColumn("at", _top(bits))
        bits += BITS
        bins = here.groupBy("source", "at", _top(bits).alias("bin")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        bins = bins.join(state, mine & (F.col("at") == F.col("edge")))
        upto = F.col("below") + F.sum("s").over(Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        edges = bins.withColumn("upto", upto).filter("upto > rest").groupBy("name").agg(F.min(F.struct("bin", (F.col("upto") - F.col("s")).alias("before"), "n")).alias("e"))
        edges = edges.select(F.col("name").alias("edge_name"), "e.*")
        found = state.join(edges, F.col("name").eqNullSafe(F.col("edge_name")), "left")
        state = keep(found.select("name", "source_size", "target", "whole", "rest", F.coalesce("bin", F.lit(1 << bits)).alias("edge"), F.coalesce("before", "rest").alias("below"), F.coalesce("n", F.lit(0)).alias("n")))
        if (state.agg(F.max("n")).first()[0] or 0) <= SMALL:
            break
        state = state.drop("n")
    placed = sized.join(state.drop("n"), mine)
    top = _top(bits)
    clear = placed.filter(top != F.col("edge")).withColumn("more", F.when(top < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("name").orderBy("draw", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    near = placed.filter(top == F.col("edge")).withColumn("more", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("below") - F.coalesce(upto, F.lit(0)))))
    return clear.unionByName(near).withColumn("taken", F.col("whole") * F.col("size") + F.col("more").cast("long"))
