"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of at most ``block`` vectors, each sent to all tasks; candidates stay where they are read, so
that neither vectors nor pairs are ever shuffled. All components are quantised to integers. Round by round each task
scores its candidates against the block and sends, for each query, counts of scores in the bins of the query's current
range; the summed histogram shows the bin of the k-th best score, which is the next range, until it is one value wide.
(A task need not send bins below that of its own k-th best: the global one is never lower.) Then the scores above the
k-th value are kept, and of those equal to it the smallest ids, and ranked by score and id. The driver holds one block
and its ranges.

Defined cases: a vector that is null or has a null or non-finite component takes no part, as one with a null id; vectors
meet only vectors of their own length (an empty one scores 0); equal scores rank by smaller id; all rows with the
query's id are its own; rows that repeat a query's id and vector are one query, each further vector of the id is a
query of its own, with its own ranks under that id; each row is a candidate, also one that repeats a vec_id; a query
with fewer candidates returns them all; scores beyond 64 bits are clamped; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut

SCALE, BINS, BLOCK, STRIP = 256, 512, 8192, 1 << 22
COUNTS = pa.schema([("query", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
HITS = pa.schema([("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _score(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if q.shape[1] == 0:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return (q @ c.T).astype(np.int64)
    own = lambda a: np.array([[int(x) for x in r] for r in a], object)
    return np.clip(own(q) @ own(c).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrices(ids: np.ndarray, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers, in order of id, and quantised vectors, by length of the vector."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * SCALE)
    begin = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield rows, flat[begin[rows][:, None] + np.arange(dim)]


class _Block:
    """Queries in memory: ids, and by length of the vector their places in the block and matrix."""

    def __init__(self, rows: list):
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        vectors = pa.array([r.embedding for r in rows], pa.list_(pa.float64()))
        self.by_dim = {m.shape[1]: (at.astype(np.int32), m) for at, m in _matrices(self.ids, vectors)}

    def meet(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, ids of candidates in order, and scores; the least score where a candidate is the query."""
        ids = batch["vec_id"].to_numpy()
        for rows, c in _matrices(ids, batch["embedding"]):
            at, q = self.by_dim.get(c.shape[1], (None, None))
            if at is not None:
                step = max(1, STRIP // len(rows))
                for k in range(0, len(at), step):
                    score = _score(q[k : k + step], c)
                    yield at[k : k + step], ids[rows], score, ids[rows][None, :] != self.ids[at[k : k + step], None]


def search(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """vectors: vec_id, embedding. query_id, rank (from 1), vec_id, score for each row whose id is divisible by every."""
    spark = vectors.sparkSession
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    valid = valid.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad).select("vec_id", F.col("e").alias("embedding"))
    queries = valid.filter(F.col("vec_id") % every == 0).distinct()
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x * SCALE).cast("double") ** 2)
    nq = queries.count()
    most = valid.agg(F.max(squares)).first()[0] or 0.0  # no score is beyond it
    bound = int(min(most * (1 + 1e-9) + 1, 2.0**62))
    blocks = -(-nq // max(1, block // 2)) if nq > block else 1  # by hash, so that one of twice the mean is out of question
    queries = cut(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks))))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    found = None
    for number in range(blocks):
        held = _Block(queries.filter(F.col("block") == number).select("vec_id", "embedding").collect())
        low = _edges(valid, held, k, bound)
        hits = valid.mapInArrow(_keeper(spark.sparkContext.broadcast((held, low)), k), "query int, query_id long, vec_id long, score long")
        hits = hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        hits = cut(hits) if blocks > 1 else hits
        found = hits if found is None else found.unionByName(hits)
    return found


def _edges(valid: DataFrame, held: _Block, k: int, bound: int) -> np.ndarray:
    """The k-th best score of each query of a block, or a lower one where there are fewer."""
    low = np.full(len(held.ids), -bound, np.int64)
    width = -(-(2 * bound + 1) // BINS)
    while len(low):
        sent = valid.sparkSession.sparkContext.broadcast((held, low))
        hist = valid.mapInArrow(_counter(sent, width, k, bound), "query int, bin int, n long")
        bins = hist.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
        # the highest bin with k scores in and above it; a query with fewer keeps its lowest
        edge = bins.withColumn("upto", upto).groupBy("query").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("bin"))), F.min("bin")).alias("bin"))
        for r in edge.collect():
            low[r["query"]] += r["bin"] * width
        sent.unpersist()
        if width == 1:
            break
        width = -(-width // BINS)
    return low


def _counter(sent, width: int, k: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low = sent.value
        hist = np.zeros((len(low), BINS + 1), np.int64)  # the last bin is for scores above the range
        for batch in batches:
            for at, _, score, other in held.meet(batch) if batch.num_rows else ():
                bins = np.minimum((np.clip(score, -bound, bound) - low[at, None]) // width, BINS)
                row, column = np.nonzero((bins >= 0) & other)
                np.add.at(hist, (at[row], bins[row, column]), 1)
        above = hist[:, ::-1].cumsum(1)[:, ::-1] - hist  # scores of this task in higher bins
        query, bins = np.nonzero((hist > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(hist[query, bins])], schema=COUNTS)

    return run


def _keeper(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low = sent.value
        for batch in batches:
            for at, ids, score, other in held.meet(batch) if batch.num_rows else ():
                ok = (score >= low[at, None]) & other
                tie = ok & (score == low[at, None])
                ok &= ~tie | (tie.cumsum(1) <= k)  # ids ascend within a batch
                row, column = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(at[row]), pa.array(held.ids[at[row]]), pa.array(ids[column]), pa.array(score[row, column])], schema=HITS)

    return run
