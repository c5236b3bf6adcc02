"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

Method: documents are dealt into blocks of a few MB; each block hashes every window of its documents and sends its
distinct hashes, packed, to hash buckets; a bucket counts them and tells each block which of its hashes occur twice or
more; the block merges its repeated windows into maximal intervals and removes them. Text is shuffled once (Spark
reuses that exchange for both reads) and a window costs about nine bytes of shuffle.

A word enters the polynomials as 64 bits of a hash without algebraic structure, so that words cannot be made to
collide by repeating a pattern. A key has 64 bits, and the bucket is chosen by a second polynomial over other numbers, so
that the chance of a wrong match depends on the windows in a bucket (a constant) and not on the corpus: about 5e-14 for
each window at any size. Windows are not compared word by word.

Defined cases: a null or empty text has no words and removes nothing; a text shorter than the window stays whole;
repeated rows, also of one doc_id, count as separate occurrences; a null doc_id is a row as any other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeloom.llm.common import MULTIPLIERS, SENT, SENT_SCHEMA, U64, RollingHash, Told, Words, blocked, bucket_count, corpus_bytes, cover, mix, send, shuffle_parts, spans_of, tell, tidy

DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
DIGEST_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"
TEXT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
TEXT_DDL = "n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>"


class _Windows:
    """Every window of a block's documents."""

    def __init__(self, texts: list[str | None], window: int):
        words = Words(texts)
        self.words, self.first = words.words, words.at
        self.at = spans_of(np.maximum(words.n - window + 1, 0), words.at[:-1])
        self.numbers, self.ids, self.window = words.hashes, words.ids, window
        self.keys = self._hash(0)

    def _hash(self, which: int) -> np.ndarray:
        return RollingHash(mix(self.numbers ^ U64(which))[self.ids], MULTIPLIERS[which]).spans(self.at, self.at + self.window)

    def deal(self) -> np.ndarray:
        return self._hash(1)


def _removed(docs: DataFrame, window: int, make, types: pa.Schema, ddl: str, whole_rows: bool = False) -> DataFrame:
    """make(doc_id, text, words, gone) is a row of types; with whole_rows the input row goes along, as a struct."""
    spark = docs.sparkSession
    _, size = corpus_bytes(docs)
    blocks = blocked(docs, size)
    buckets = bucket_count(size, 6, 2 * shuffle_parts(spark))

    def hashes(table: pa.Table) -> pa.Table:
        tidy()
        w = _Windows(table["text"].to_pylist(), window)
        return send(table["block"][0].as_py(), w.keys, w.deal(), buckets) if len(w.keys) else SENT_SCHEMA.empty_table()

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        tidy()
        w = _Windows(table["text"].to_pylist(), window)
        at = w.at[Told(told).look(0, w.keys)[0]]
        gone = cover(int(w.first[-1]), at, at + window)
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        rows = [make(i, t, words, gone[a:b]) for i, t, words, a, b in zip(ids, texts, w.words, w.first[:-1], w.first[1:])]
        out = pa.Table.from_pylist(rows, schema=types)
        return out.append_column("row", table["row"]) if whole_rows else out

    told = tell(blocks.groupBy("block").applyInArrow(hashes, SENT), 0)
    if whole_rows:
        blocks = blocked(docs, size, whole_rows=True)
        kind = T.StructType([*T._parse_datatype_string(ddl).fields, T.StructField("row", blocks.schema["row"].dataType)])
        return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, kind)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, ddl)


def _runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    return edge[::2], edge[1::2]


def _kept(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join(w for w, x in zip(words, gone.tolist()) if not x) if gone.any() else b" ".join(words)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """row (the input row, a struct), n_words, n_removed, kept_text (the whole text as it is if nothing goes, else its
    kept words joined by one space; null for a null text) and spans, the maximal removal intervals in words."""

    def make(doc_id, text, words, gone):
        n = int(gone.sum())
        starts, ends = _runs(gone)
        return {"n_words": len(words), "n_removed": n, "kept_text": _kept(words, gone).decode("utf-8", "surrogatepass") if n else text, "spans": [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())]}

    return _removed(docs, window, make, TEXT, TEXT_DDL, whole_rows=True)


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and a digest of the kept words."""

    def make(doc_id, text, words, gone):
        return {"doc_id": doc_id, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(_kept(words, gone)).hexdigest()}

    return _removed(docs, window, make, DIGEST, DIGEST_DDL)
