"""Suffix-array deduplication of long byte strings, by prefix-free parsing.

Question: which start positions of the corpus have a suffix whose first ``length`` (100) bytes also begin an earlier
suffix? In a corpus suffix array those are the members, but the first, of each run with common prefixes of 100 or more.

Parsing: a rolling hash of 8 bytes that falls in a fixed twelfth of its range is a trigger. The suffixes between one
trigger and the next form a phrase; with the overlap of ``length`` bytes to the right that decides their order, phrases
are prefix-free. Suffixes with no trigger in their first half are phrases of their own. As triggers depend on content
only, equal strings are cut alike, so equal suffixes lie at equal offsets behind equal triggers.

Dictionary and parse, in three exchanges:
1. cores: the first half of each phrase, with its total count. A phrase whose core occurs once holds no repeat.
2. the parse: the whole phrases of repeated cores, each with the first of its places in corpus order. All later places
   of a phrase repeat wholly. A phrase as frequent as its core is the only one of it and then done.
3. the dictionary: the bytes of the phrases that share a core with another one, once each. All suffixes that begin alike
   have one core, so a task that takes whole cores builds the suffix array of its part of the dictionary
   (``suffix_array``: bytes are compared, none are hashed). In each run of it with common prefixes of ``length`` the
   places of the phrases give corpus order, and all members but the first are repeats.
A repetitive corpus thus sorts each dictionary suffix once, however often it occurs. No question here looks further than
``length`` bytes, which a phrase and its overlap hold, so that the parse needs no suffix array beyond the places.

Phrases and cores are recognised by 64-bit hashes of at most 150 bytes, dealt by a second one. A core with ``HOT`` places
or more, such as a line that a third of the corpus has, may stand in as many different phrases; the suffixes of its open
phrases are dealt singly, by a second hash, and compared by 64-bit hashes in corpus order, so that no task takes them all.

Defined cases: a null or empty text has no bytes; corpus order is by doc_id (null first), then start; rows that repeat a
doc_id count as separate texts, in the order of a hash of the text; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import MULTIPLIERS, SENT, SENT_SCHEMA, TOLD, TOLD_SCHEMA, U64, RollingHash, Told, block_count, bucket_count, corpus_bytes, cover, cut, mix, planes, send, shuffle_parts, spans_of, tell, teller, unplanes, utf8

TRIGGER_BYTES, TRIGGER_EVERY, CORE_BITS, HOT = 8, 12, 32, 1 << 14
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


class _Phrases:
    """The phrases of a block: suffix starts lo..hi, trigger at, in corpus order."""

    def __init__(self, table: pa.Table, length: int):
        ids, salts, texts = table["doc_id"].to_pylist(), table["salt"].to_pylist(), [utf8(t) for t in table["text"].to_pylist()]
        salts = [x % (1 << 64) for x in salts]
        by = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, salts[i], texts[i]))
        self.ids, self.salts, self.texts = [ids[i] for i in by], [salts[i] for i in by], [texts[i] for i in by]
        n = np.array([len(t) for t in self.texts], np.int64)
        self.off = np.r_[0, np.cumsum(n)]
        self.length, half = length, length // 2
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.size = len(data)
        self.one, self.data = RollingHash(data, MULTIPLIERS[0]), data
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        at = np.flatnonzero(self.one.windows(TRIGGER_BYTES) < U64((1 << 64) // TRIGGER_EVERY))
        end = self.off[1:][doc[at]] if len(at) else at
        at = at[at + TRIGGER_BYTES <= end]
        begin, end = self.off[:-1][doc[at]], self.off[1:][doc[at]]
        lo = np.maximum(begin, at - half)
        lo[1:] = np.maximum(lo[1:], at[:-1] + 1)
        hi = np.minimum(at, end - length)
        ok = lo <= hi
        at, lo, hi = at[ok], lo[ok], hi[ok]
        bare = ~cover(self.size, lo, hi + 1) if self.size else np.zeros(0, bool)
        for a, b in zip(np.maximum(self.off[:-1], self.off[1:] - length + 1).tolist(), self.off[1:].tolist()):
            bare[a:b] = False
        alone = np.flatnonzero(bare)
        core_end = np.r_[at + half, alone + length]
        at, lo, hi = np.r_[at, alone], np.r_[lo, alone], np.r_[hi, alone]
        by = np.argsort(lo)
        self.at, self.lo, self.hi, self.core_end = at[by], lo[by], hi[by], core_end[by]
        self.doc = doc

    @cached_property
    def two(self) -> RollingHash:
        return RollingHash(self.data, MULTIPLIERS[1])

    def cores(self, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the cores and the hashes that deal them. A key is the bucket and a short hash that travels alone. Two
        cores of one key are thus in one bucket and share a total, which costs a comparison: no phrase of theirs has it."""
        deal = self.two.spans(self.at, self.core_end)
        return (deal % U64(buckets)) << U64(32) | self.one.spans(self.at, self.core_end) & U64((1 << bits) - 1), deal

    def pick(self, chosen: np.ndarray) -> None:
        for name in ("at", "lo", "hi", "core_end"):
            setattr(self, name, getattr(self, name)[chosen])

    def order(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corpus order of places: the document, its salt among rows of that id, then its turn among equal rows and the
        start."""
        turn = np.zeros(len(self.ids), np.int64)
        for k in range(1, len(self.ids)):
            turn[k] = turn[k - 1] + 1 if (self.ids[k], self.salts[k]) == (self.ids[k - 1], self.salts[k - 1]) else 0
        ids = np.array([0 if i is None else i + (1 << 63) for i in self.ids], U64)
        doc = self.doc[place]
        return ids[doc], np.array(self.salts, U64)[doc], ((turn[doc] << 40) | (place - self.off[doc])).astype(U64)

    def phrases(self) -> np.ndarray:
        return self.two.spans(self.lo, self.hi + self.length) ^ mix((self.at - self.lo).astype(U64) * U64(MULTIPLIERS[0]))


def _first(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the block's first of its value, in array order."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def suffix_array(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data from start, in the order of their first ``length`` bytes, equal ones in the order given; and
    whether each has all of these in common with the one before. By eight bytes a round, among suffixes that are equal
    so far only."""
    at = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order, group = np.arange(len(start)), np.zeros(len(start), np.int64)  # group: where the run of equal ones begins
    active = np.arange(len(start))
    for offset in at:
        if not len(active):
            break
        key = words[start[order[active]] + offset].copy().view(">u8")[:, 0].astype(U64)
        by = np.lexsort((key, group[active]))
        order[active], key = order[active[by]], key[by]
        own = group[active]
        new = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active = active[~(new & np.r_[new[1:], True])]
    same = np.zeros(len(start), bool)
    same[1:] = group[1:] == group[:-1]
    return order, same


class _Leaders(_Phrases):
    """Of the phrases with repeated cores: later places of a phrase are gone; the open first ones remain, those of hot
    cores apart."""

    def __init__(self, table: pa.Table, told: Told, length: int):
        super().__init__(table, length)
        keys = self.phrases()
        _, _, lead, loose = told.look(2, keys)
        leads = _first(keys) & (lead > 0)
        self.gone_lo, self.gone_hi = self.lo[~leads], self.hi[~leads]
        self.pick(leads & (loose > 0))
        self.hot = loose[leads & (loose > 0)] == 2

    def starts(self, hot: bool) -> np.ndarray:
        part = self.hot == hot
        n = (self.hi - self.lo + 1)[part]
        return spans_of(n, self.lo[part])


def _dictionary(p: _Leaders, block: int, buckets: int) -> pa.Table:
    """The open phrases of cores that aren't hot: number in the block, how many suffixes, bytes, and place."""
    chosen = np.flatnonzero(~p.hot)
    bucket = (p.one.spans(p.at[chosen], p.core_end[chosen]) % U64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    chosen, bucket = chosen[by], bucket[by]
    rows = []
    for part in np.split(np.arange(len(chosen)), np.flatnonzero(np.diff(bucket)) + 1) if len(chosen) else ():
        k = chosen[part]
        n = p.hi[k] - p.lo[k] + 1
        places = (planes(x) for x in p.order(p.lo[k]))
        rows.append((int(bucket[part[0]]), block, p.data[spans_of(n + p.length - 1, p.lo[k])].tobytes(), planes(k.astype(np.uint32)), n.astype(np.uint8).tobytes(), *places))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT_SCHEMA)], schema=SENT_SCHEMA) if rows else SENT_SCHEMA.empty_table()


def _repeats(table: pa.Table, length: int) -> pa.Table:
    """For each block the phrases with repeated suffixes, and which, as bits: of each run of the dictionary's suffix array
    all but the first in corpus order."""
    blocks = table["block"].to_numpy()
    data = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8)
    number = unplanes(table["counts"].to_pylist(), np.uint32)
    n = np.frombuffer(b"".join(table["notes"].to_pylist()), np.uint8).astype(np.int64)
    edges = np.cumsum([0, *map(len, table["notes"].to_pylist())])  # phrases of each block
    first, second, third = (unplanes(table[c].to_pylist(), U64) for c in ("first", "second", "third"))
    size = n + length - 1
    phrase = np.repeat(np.arange(len(n)), n)
    inside = spans_of(n, np.zeros(len(n), np.int64))
    order, same = suffix_array(data, spans_of(n, np.cumsum(size) - size), length)
    run = np.cumsum(~same)
    many = same | np.r_[same[1:], False]  # members of runs of two and more
    order, run = order[many], run[many]
    p = phrase[order]
    by = np.lexsort((third[p] + inside[order].astype(U64), second[p], first[p], run))
    again = order[by][np.r_[False, run[by][1:] == run[by][:-1]]] if len(by) else order
    bits = np.zeros(len(n), U64)
    np.bitwise_or.at(bits, phrase[again], U64(1) << inside[again].astype(U64))
    rows = []
    for k, block in enumerate(blocks.tolist()):
        mine = np.arange(edges[k], edges[k + 1])
        mine = mine[bits[mine] > 0]
        if len(mine):
            rows.append((block, int(table["bucket"][0].as_py()), 4, number[mine].tobytes(), bits[mine].tobytes(), None, None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TOLD_SCHEMA)], schema=TOLD_SCHEMA) if rows else TOLD_SCHEMA.empty_table()


def _salted(docs: DataFrame) -> DataFrame:
    """doc_id, text and salt: a hash of the text for rows that repeat a doc_id, else 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")))
    if not again.limit(1).count():
        return rows.withColumn("salt", F.lit(0).cast("long"))
    found = rows.join(again.withColumn("some", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("again")), "left")
    return found.select("doc_id", "text", F.when(F.col("some"), F.xxhash64("text")).otherwise(F.lit(0)).alias("salt"))


def _run(docs: DataFrame, length: int, make, types: pa.Schema, core_bits: int = CORE_BITS, hot: int = HOT) -> DataFrame:
    spark = docs.sparkSession
    _, size = corpus_bytes(docs)
    least = shuffle_parts(spark)
    blocks = _salted(docs).withColumn("block", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(block_count(size, least))))
    many, few = bucket_count(size, 10, least), bucket_count(size, 40, least)
    empty = SENT_SCHEMA.empty_table

    def cores(table: pa.Table) -> pa.Table:
        p = _Phrases(table, length)
        return send(table["block"][0].as_py(), *p.cores(many, core_bits), many, width=4) if len(p.at) else empty()

    def phrases(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return empty()
        p = _Phrases(table, length)
        hit, total, _, _ = Told(told, {1: 4}).look(1, p.cores(many, core_bits)[0])
        p.pick(hit)
        return send(table["block"][0].as_py(), p.phrases(), p.one.spans(p.lo, p.hi + length), few, p.order(p.lo), total[hit]) if len(p.lo) else empty()

    def dictionary(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return empty()
        p, block = _Leaders(table, Told(told), length), table["block"][0].as_py()
        out = [_dictionary(p, block, few)]
        at = p.starts(True)
        if len(at):
            single = send(block, p.one.spans(at, at + length), p.two.spans(at, at + length), few, p.order(at))
            out.append(single.set_column(0, "bucket", pa.array(single["bucket"].to_numpy() + np.int32(few))))
        return pa.concat_tables(out)

    def answer(table: pa.Table) -> pa.Table:
        return _repeats(table, length) if table["bucket"][0].as_py() < few else teller(3)(table)

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return types.empty_table()
        kinds = told["kind"].to_numpy() if told.num_rows else np.zeros(0, np.int32)
        known = Told(told.filter(pa.array(kinds != 4)))
        p = _Leaders(table, known, length)
        at = p.starts(True)
        keys = p.one.spans(at, at + length) if len(at) else np.zeros(0, U64)
        hit, _, lead, _ = known.look(3, keys)
        again = at[hit & ~(_first(keys) & (lead > 0))]
        masked = told.filter(pa.array(kinds == 4))
        number, bits = (np.frombuffer(b"".join(masked[c].to_pylist()), t).astype(np.int64 if t == "u4" else U64) for c, t in (("keys", "u4"), ("totals", "u8")))
        which = (bits[:, None] >> np.arange(64, dtype=U64)[None, :]) & U64(1) > 0
        row, offset = np.nonzero(which)
        again = np.r_[again, p.lo[number[row]] + offset]
        gone = cover(p.size, np.r_[p.gone_lo, again], np.r_[p.gone_hi + length, again + length])
        return pa.Table.from_pylist([make(i, t, gone[a:b]) for i, t, a, b in zip(p.ids, p.texts, p.off[:-1], p.off[1:])], schema=types)

    def by_block(df: DataFrame):
        return df.groupBy("block")

    one = tell(by_block(blocks).applyInArrow(cores, SENT), 1, width=4)
    two = tell(by_block(blocks).cogroup(by_block(one)).applyInArrow(phrases, SENT), 2, hot=hot)
    three = by_block(blocks).cogroup(by_block(two)).applyInArrow(dictionary, SENT).groupBy("bucket").applyInArrow(answer, TOLD)
    told = two.unionByName(three)
    schema = ", ".join(f"{f.name} {_ddl(f.type)}" for f in types)
    return by_block(blocks).cogroup(by_block(told)).applyInArrow(remove, schema)


def _ddl(kind: pa.DataType) -> str:
    return {"int64": "long", "string": "string", "binary": "binary"}.get(str(kind), "array<struct<start: long, end: long>>")


def _runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    return edge[::2], edge[1::2]


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, the maximal removed spans in bytes and the kept bytes."""

    def make(doc_id, text, gone):
        starts, ends = _runs(gone)
        return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": int(gone.sum()), "spans": [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())], "kept": _kept(text, gone)}

    return _run(docs, length, make, SPANS)


def digest(docs: DataFrame, length: int = 100, core_bits: int = CORE_BITS, hot: int = HOT) -> DataFrame:
    """As remove_repeats, with the number of spans and a digest of the kept bytes. core_bits (up to 32) of a core's hash
    travel; and a core with hot places is hot; the result is the same for any numbers."""

    def make(doc_id, text, gone):
        return {"doc_id": doc_id, "n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": len(_runs(gone)[0]), "kept_sha256": hashlib.sha256(_kept(text, gone)).hexdigest()}

    return _run(docs, length, make, DIGEST, core_bits, hot)
