"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. The counts of vote patterns over the whole corpus (at
most 3^labellers of them) go to expectation-maximisation of a latent-class model: each labeller has its own
probabilities of each vote for good and bad documents, the posterior of a pattern is its label. The thresholds are set so
that a bad vote on a good document is an exception: its probability is held under ``MOST_FALSE`` after each maximisation (which is then a maximum under that
bound), else the two classes of the model could be two kinds of bad documents or two languages. The posteriors of a
bounded seeded sample (``sample`` documents expected, never over twice that) train a logistic scorer over hashed
features: shapes of words, pairs of neighbouring shapes, and whether a word repeats the one before. The scorer's verdict
on every document is the result.

Defined cases: a text without words (null, empty, white space) gets no votes, the score 0 and is rejected; the class of fewer documents is drawn
by itself (at most 4 * ``LEAST_DRAWN`` more) if under ``LEAST_DRAWN`` of it were expected in the sample; with documents of one class only, or none,
there is nothing to train on and the posterior alone decides; rows that repeat a doc_id are judged one by one; a null doc_id stays
null; very long texts are one step each; an empty table gives an empty result; ``classify`` returns its own columns,
``keep`` those of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import MULTIPLIERS, U64, RollingHash, Words, mix, tidy

#: Labellers: a measure, the value from which the vote is bad, and the value up to which it is good.
LABELLERS = (
    ("symbol words", 0.30, 0.05),
    ("bar words", 0.20, 0.02),
    ("capitals", 0.50, 0.20),
    ("words ending in !", 0.30, 0.03),
    ("words as the one before", 0.25, 0.05),
    ("words in repeated windows of three", 0.60, 0.20),
    ("words of over 30 bytes", 0.30, 0.02),
)
DIMENSIONS, SAMPLE, ROUNDS, STEPS, MOST_FALSE, LEAST_DRAWN = 2048, 3000, 60, 250, 0.001, 30
STEP_BYTES = 1 << 20
_CLASS = np.full(256, ord("a"), np.uint8)  # letters, digits and bytes of other letters by class, the rest as they are
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = _c
_CLASS[[ord("."), ord(",")]] = ord(".")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>~^{}")] = True


class _Text:
    """The words of some texts, in one buffer."""

    def __init__(self, texts: list):
        self.words = Words(texts)
        self.n, self.doc = self.words.n, self.words.doc
        self.data = np.frombuffer(self.words.data, np.uint8)[:-1]  # without the last space
        self.ends = self.words.ends - 1
        self.starts = np.r_[0, self.words.ends[:-1]] if len(self.doc) else self.ends
        self.same = np.zeros(len(self.doc), bool)
        if len(self.doc):
            ids = self.words.ids
            self.same[1:] = (ids[1:] == ids[:-1]) & (self.doc[1:] == self.doc[:-1])

    def share(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, flags, len(self.n)) / np.maximum(self.n, 1)

    def in_words(self, flags: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(flags)]
        return upto[self.ends] - upto[self.starts]

    def votes(self) -> np.ndarray:
        """By document and labeller: 0 nothing, 1 good, 2 bad."""
        if not len(self.doc):
            return np.zeros((len(self.n), len(LABELLERS)), np.int64)
        d = self.data
        upper, lower = (self.in_words((d >= lo) & (d <= lo + 25)) for lo in (ord("A"), ord("a")))
        count = lambda x: np.bincount(self.doc, x, len(self.n))
        size = self.ends - self.starts
        measures = (
            self.share(self.in_words(_SYMBOL[d]) > 0),
            self.share((size == 1) & (d[self.starts] == ord("|"))),
            count(upper) / np.maximum(count(upper + lower), 1),
            self.share(d[self.ends - 1] == ord("!")),
            self.share(self.same),
            self.share(self.words.repeats(3)),
            self.share(size > 30),
        )
        out = np.stack([np.where(m >= bad, 2, np.where(m <= good, 1, 0)) for m, (_, bad, good) in zip(measures, LABELLERS)], 1)
        out[self.n < 8] = np.where(out[self.n < 8] == 2, 0, out[self.n < 8])  # too short to be held against it
        out[self.n == 0] = 0
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, dimension and value of hashed features; the values of a document add up to 1."""
        if not len(self.doc):
            return self.doc, self.doc, self.doc.astype(float)
        kind = np.where(self.data == 32, 32, _CLASS[self.data])
        keep = np.r_[True, kind[1:] != kind[:-1]]  # runs of a class count once
        shape = kind[keep]
        ends = np.r_[np.flatnonzero(shape == 32), len(shape)]
        h = RollingHash(shape.astype(np.uint8), MULTIPLIERS[1]).spans(np.r_[0, ends[:-1] + 1], ends)
        before = np.r_[U64(0), h[:-1]]
        before[np.r_[True, self.doc[1:] != self.doc[:-1]]] = U64(0)
        pair = mix(h * U64(3) + before)
        same = np.where(self.same, U64(7), U64(5)) * U64(MULTIPLIERS[1])
        dims = np.stack([h, pair, mix(same)], 1) % U64(DIMENSIONS)
        value = np.repeat(1 / (3 * self.n[self.doc]), 3)
        return np.repeat(self.doc, 3), dims.reshape(-1).astype(np.int64), value


def _stepped(make, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            texts = batch["text"].to_pylist()
            begin = held = 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held > STEP_BYTES or k == len(texts) - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(make(part, _Text(texts[begin : k + 1])), schema)], schema=schema)
                    begin, held = k + 1, 0

    return run


def _codes(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(len(LABELLERS))


def estimate(patterns: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good by vote pattern; and by labeller the vote probabilities of (bad, good) documents."""
    codes = np.array(sorted(patterns), np.int64)
    counts = np.array([patterns[c] for c in codes], float)
    votes = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((votes == 2).any(1), 0.1, 0.9)
    tables = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        weight = np.stack([1 - good, good]) * counts
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        for j in range(len(LABELLERS)):
            for v in range(3):
                tables[j, :, v] = weight[:, votes[:, j] == v].sum(1) + 0.5
        tables /= tables.sum(2, keepdims=True)
        tables[:, 1, 2] = np.minimum(tables[:, 1, 2], MOST_FALSE)
        like = np.log(prior)[:, None] + sum(np.log(tables[j][:, votes[:, j]]) for j in range(len(LABELLERS)))
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
    return dict(zip(codes.tolist(), good.tolist())), tables


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic scorer for soft labels, the two classes weighing the same; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = y / share + (1 - y) / (1 - share)
    w, m, v = np.zeros((3, x.shape[1]))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ ((p - y) * weight) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _judged(rows: DataFrame, sample: int, seed: int) -> DataFrame:
    """rows: row (a struct), doc_id, text. Adds n_words, votes, posterior, score, kept."""
    votes = _stepped(lambda part, t: (_codes(t.votes()), t.n > 0), pa.schema([("code", pa.int64()), ("some", pa.bool_())]))
    text = rows.select("text", "doc_id")
    patterns = text.select("text").mapInArrow(votes, "code long, some boolean").groupBy("code", "some").count().collect()  # at most 2 * 3^labellers rows
    counts: dict[int, int] = {}
    for r in patterns:
        if r.some:
            counts[r.code] = counts.get(r.code, 0) + r["count"]
    posterior, _ = estimate(counts) if counts else ({}, None)
    total = sum(counts.values())

    sides = {x: [c for c in counts if (posterior[c] >= 0.5) == x] for x in (True, False)}
    size = {x: sum(counts[c] for c in sides[x]) for x in sides}
    few = min(size, key=size.get)
    rate = min(1, sample / max(total, 1))
    scarce = 0 < size[few] and rate < 1 and size[few] * rate < LEAST_DRAWN
    rare = sides[few] if scarce else []

    def vectors(part: pa.RecordBatch, t: _Text, only: bool = False):
        if rare:  # the scarce class is drawn by itself
            at = np.flatnonzero((np.isin(_codes(t.votes()), rare) & (t.n > 0)) == only)
            texts = part["text"].to_pylist()
            t = _Text([texts[k] for k in at.tolist()])
        doc, dim, value = t.features()
        x = np.zeros((len(t.n), DIMENSIONS), np.float32)
        np.add.at(x, (doc, dim), value)
        return [r.tobytes() for r in x], _codes(t.votes()), t.n

    def draw(rate: float, make, most: int) -> list:
        chosen = text.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1_000_000)) < F.lit(round(1_000_000 * rate)))
        schema = pa.schema([("x", pa.binary()), ("code", pa.int64()), ("n", pa.int64())])
        return chosen.select("text").mapInArrow(_stepped(make, schema), "x binary, code long, n long").filter("n > 0").limit(most).collect()

    more = draw(min(1, 2 * LEAST_DRAWN / size[few]), lambda part, t: vectors(part, t, True), 4 * LEAST_DRAWN) if scarce else []
    drawn = draw(rate, vectors, 2 * sample) + more
    labels = np.array([posterior[r.code] for r in drawn])
    weights = None
    if len(drawn) and (0.001 < labels.mean() < 0.999 or len(set(labels >= 0.5)) == 2):
        weights = train(np.stack([np.frombuffer(r.x, np.float32) for r in drawn]), labels)
    fields = [("n_words", pa.int64()), ("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())]

    def score(part: pa.RecordBatch, t: _Text):
        codes = _codes(t.votes())
        prob = np.array([posterior.get(int(c), 0.5) for c in codes])
        if weights is None:
            points = prob
        else:
            doc, dim, value = t.features()
            points = 1 / (1 + np.exp(-(np.bincount(doc, weights[dim] * value, len(t.n)) + weights[-1])))
        points = np.where(t.n > 0, points, 0.0)
        names = ["".join("?+-"[c // 3**j % 3] for j in range(len(LABELLERS))) for c in codes.tolist()]
        return part.column(0).to_pylist() if part.schema.names[0] == "row" else part.column("doc_id"), t.n, names, prob, points, points >= 0.5

    first = "row" if "row" in rows.columns else "doc_id"
    if first == "row":
        return _with_rows(rows, score, fields)
    schema = pa.schema([("doc_id", pa.int64()), *fields])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stepped(score, schema), "doc_id long, n_words long, votes string, posterior double, score double, kept boolean")


def _with_rows(rows: DataFrame, score, fields: list) -> DataFrame:
    """The input rows that are kept, untouched: their columns pass through as they are."""
    schema = rows.select("row.*").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            texts = batch["text"].to_pylist()
            begin = held = 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held > STEP_BYTES or k == len(texts) - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    kept = score(part.select(["text", "doc_id"]).rename_columns(["text", "doc_id"]), _Text(texts[begin : k + 1]))[-1]
                    yield part.filter(pa.array(kept)).select(["row"])
                    begin, held = k + 1, 0

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([T.StructField("row", schema)])).select("row.*")


def classify(docs: DataFrame, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """Per document: doc_id, n_words, votes (+ good, - bad, ? none, by labeller), posterior and score of good, kept."""
    return _judged(docs.select("doc_id", "text"), sample, seed)


def keep(docs: DataFrame, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """The rows of docs that the scorer accepts."""
    return _judged(docs.select(F.struct("*").alias("row"), "doc_id", F.col("text").cast("string").alias("text")), sample, seed)
