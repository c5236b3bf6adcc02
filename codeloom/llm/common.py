"""Shared pieces: shared scratch space, words, block layout, polynomial hashes, and the packed key exchange."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.scratch import cut, scratch  # noqa: F401  for the operators

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of the two polynomial hashes (odd) and of the finalizer.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xBF58476D1CE4E5B9
BLOCK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20
#: Bytes of text up to which blocks and buckets have these sizes.
PLAIN_BYTES = 30 << 30


class Tables:
    """Intermediate tables of a loop of jobs, as Parquet in the shared folder: unlike a checkpoint they carry no
    constraints over from step to step, and the loop can drop them once its result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{scratch(spark)}/tables-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths):04d}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop_all_but(self, last: int) -> None:
        jvm = self.spark._jvm
        for name in self.paths[: len(self.paths) - last]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a worker process keeps from task to task, by the name that its owner gives to ``tidy``.
KEPT: dict[str, dict] = {}
_TIDIED: list[int] = [-1]


def tidy(own: str = "") -> None:
    """As a task begins: a worker serves operators one after another, so what others kept is dropped, and memory that
    earlier tasks have freed goes back to the system and does not count beside that of this one."""
    from pyspark import TaskContext

    task = TaskContext.get()
    if task is not None and _TIDIED[0] != (now := task.taskAttemptId()):
        _TIDIED[0] = now
        for name, kept in KEPT.items():
            if name != own:
                kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_words(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() cuts at exactly the six characters that WORD excludes."""
    return utf8(text).split() if text else []


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(MIX)
    return h ^ (h >> U64(29))


def spans_of(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """count[k] numbers from first[k], for each k."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def numbered(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The pieces of data that end at ends, as numbers into the list of distinct pieces; bytes are compared, not hashes."""
    pieces = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return pieces.indices.to_numpy().astype(np.int64), pieces.dictionary.to_pylist()


class Words:
    """The words of some texts. n: words by text; at: first word of each text, and the end; ids: a number for each word,
    the same exactly for the same bytes; hashes: 64 bits for each number, of a hash without algebraic structure."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        self.words = [split_words(t) for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.at = np.r_[0, np.cumsum(self.n)]
        data = b" ".join(w for words in self.words for w in words) + b" "
        self.data = data.lower() if lower else data
        self.ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1 if self.at[-1] else self.at[:0]
        self.ids, self.distinct = numbered(self.data, self.ends)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), U64, len(self.distinct))

    def repeats(self, size: int) -> np.ndarray:
        """Which words are in a window of that size that its text has twice or more."""
        count = np.maximum(self.n - size + 1, 0)
        at, owner = spans_of(count, self.at[:-1]), np.repeat(np.arange(len(self.n)), count)
        _, back, times = np.unique(self._in_text(owner, *self._codes(at, size, None)), return_inverse=True, return_counts=True)
        at = at[times[back] > 1]
        return cover(len(self.ids), at, at + size)

    def _in_text(self, owner: np.ndarray, code: np.ndarray, bound: int) -> np.ndarray:
        if bound * len(self.n) >= 1 << 62:
            seen, code = np.unique(code, return_inverse=True)
            bound = len(seen)
        return owner * bound + code

    def _codes(self, at: np.ndarray, size: int, end: np.ndarray | None) -> tuple[np.ndarray, int]:
        most, code, bound = len(self.distinct) + 1, np.zeros(len(at), np.int64), 1
        for j in range(size):
            if bound * most >= 1 << 62:
                seen, code = np.unique(code, return_inverse=True)
                bound = len(seen)
            word = self.ids[np.minimum(at + j, len(self.ids) - 1)] + 1 if len(at) else code
            code = code * most + (word if end is None else np.where(at + j < end, word, 0))
            bound *= most
        return code, bound

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles, text by text: text, exact number, hash. A text of fewer words has its sequence as one."""
        count = np.where(self.n > 0, np.maximum(self.n - size + 1, 1), 0)
        owner = np.repeat(np.arange(len(self.n)), count)
        at = spans_of(count, self.at[:-1])
        end = self.at[1:][owner]
        code, bound = self._codes(at, size, end)
        first = np.unique(self._in_text(owner, code, bound), return_index=True)[1]
        owner, code, at, end = owner[first], code[first], at[first], end[first]
        h = np.zeros(len(at), U64)
        for j in range(size):
            word = self.hashes[self.ids[np.minimum(at + j, len(self.ids) - 1)]] if len(at) else h
            h = mix(h * U64(MULTIPLIERS[0]) + np.where(at + j < end, word, U64(j)))
        return owner, code, h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POWERS.get(r)
    if got is None or len(got[0]) < n:
        inverse = pow(r, -1, 1 << 64)
        got = []
        for base in (r, inverse):
            a = np.full(n, base, U64)
            a[0] = 1
            got.append(np.multiply.accumulate(a))
        got = _POWERS[r] = tuple(got)
        while len(_POWERS) > 2:
            _POWERS.pop(next(iter(_POWERS)))
    return got[0][:n], got[1][:n]


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, by significance: the empty high bytes of small numbers then compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(parts: list[bytes], kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.zeros(0, kind), *(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind)[:, 0] for x in parts)])


class RollingHash:
    """Rabin-Karp hashes, modulo 2^64, of any byte spans of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray, multiplier: int):
        up, self.down = _powers(multiplier, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=self.prefix[1:])

    def windows(self, size: int) -> np.ndarray:
        """The spans of that size from every place."""
        if len(self.prefix) <= size:
            return np.zeros(0, U64)
        return mix((self.prefix[size:] - self.prefix[:-size]) * self.down[:-size])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])


def growth(size: int) -> float:
    """By how much blocks and buckets are larger for a corpus of that many bytes. A row of an exchange is that of a block
    and a bucket, so if both grow with the root of the corpus, rows hold as many keys at any size."""
    return max(1.0, (size / PLAIN_BYTES) ** 0.5)


def block_count(size: int, least: int) -> int:
    return max(least, int(size / (BLOCK_BYTES * growth(size))) + 1)


def bucket_count(size: int, bytes_a_key: int, least: int) -> int:
    return max(least, int(size / (bytes_a_key * BUCKET_KEYS * growth(size))) + 1)


def corpus_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of text of the whole table."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    return n, size or 0


def blocked(docs: DataFrame, size: int, whole_rows: bool = False) -> DataFrame:
    """(block, doc_id, text, with whole_rows also row, a struct): rows dealt by a hash of id and text into blocks of about BLOCK_BYTES of text."""
    n = block_count(size, shuffle_parts(docs.sparkSession))
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct("*").alias("row")] if whole_rows else []))


SENT = "bucket int, block long, keys binary, counts binary, notes binary, first binary, second binary, third binary"
TOLD = "block long, bucket int, kind int, keys binary, totals binary, leads binary, open binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "counts", "notes", "first", "second", "third"))])
TOLD_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("keys", "totals", "leads", "open"))])


def send(block: int, keys: np.ndarray, deal: np.ndarray, buckets: int, order: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, notes: np.ndarray | None = None, width: int = 8) -> pa.Table:
    """Rows for ``tell``: a block's distinct keys, dealt to buckets by another hash, with their counts in the block.

    order: three unsigned arrays; then a key also carries the least triple among its occurrences in the block.
    notes: an expected total for each key. A key that fills a third of the corpus thus adds one entry a block.
    width: low bytes of a key that travel; with 4, the high half of a key must be its bucket.
    """
    if order is None:
        keys, at, counts = np.unique(keys, return_index=True, return_counts=True)
    else:
        by = np.lexsort((*order[::-1], keys))
        sorted_keys = keys[by]
        new = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(by) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[new, len(by)])
        at, keys = by[new], sorted_keys[new]
    bucket = (deal[at] % U64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    used = np.flatnonzero(edges[1:] > edges[:-1])

    def packed(column: np.ndarray | None, how=planes) -> pa.Array:
        if column is None:
            return pa.nulls(len(used), pa.binary())
        column = column[by]
        return pa.array([how(column[edges[b] : edges[b + 1]]) for b in used], pa.binary())

    columns = [packed(keys.astype(f"u{width}"), np.ndarray.tobytes), packed(counts.astype(np.uint32)), packed(None if notes is None else notes[at].astype(np.uint32)), *(packed(o[at]) for o in order or ())]
    columns += [packed(None)] * (6 - len(columns))
    return pa.Table.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block, np.int64)), *columns], schema=SENT_SCHEMA)


def tell(sent: DataFrame, kind: int, width: int = 8, hot: int = 1 << 32) -> DataFrame:
    """For each block its keys that occur twice or more in the corpus: total counts and whether the block holds the
    first occurrence in order. With notes also the keys whose total isn't the noted one, as open ones: 1, or 2 for a note
    of hot and more. One task takes a bucket: one packed row from each block. width: bytes of a key."""
    return sent.groupBy("bucket").applyInArrow(teller(kind, width, hot), TOLD)


def teller(kind: int, width: int = 8, hot: int = 1 << 32):
    key = np.dtype(f"u{width}")

    def reduce(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        keys = [np.frombuffer(x, key) for x in table["keys"].to_pylist()]
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        keys = np.concatenate(keys)
        counts = unplanes(table["counts"].to_pylist(), np.uint32)
        if table["first"].null_count:
            by = np.argsort(keys, kind="stable")
        else:
            by = np.lexsort((*(unplanes(table[c].to_pylist(), U64) for c in ("third", "second", "first")), keys))
        keys = keys[by]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lead = np.zeros(len(keys), np.uint8)
        lead[new] = 1
        totals = np.repeat(np.minimum(np.add.reduceat(counts[by].astype(np.int64), new), 2**32 - 1).astype(np.uint32), np.diff(np.r_[new, len(keys)]))
        loose = np.zeros(len(keys), np.uint8)
        if not table["notes"].null_count:
            notes = unplanes(table["notes"].to_pylist(), np.uint32)[by]
            loose[:] = np.where(notes == totals, 0, np.where(notes >= hot, 2, 1))
        keep = (totals >= 2) | (loose > 0)
        columns = [c[keep] for c in (keys, totals, lead, loose)]
        owner = owner[by][keep]
        by = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[by], np.arange(len(blocks) + 1))
        used = np.flatnonzero(edges[1:] > edges[:-1])
        packed = []
        for column, how in zip(columns, (np.ndarray.tobytes, planes, np.ndarray.tobytes, np.ndarray.tobytes)):
            column = column[by]
            packed.append(pa.array([how(column[edges[b] : edges[b + 1]]) for b in used], pa.binary()))
        bucket = table["bucket"][0].as_py()
        return pa.Table.from_arrays([pa.array(blocks[used]), *(pa.array(np.full(len(used), x, np.int32)) for x in (bucket, kind)), *packed], schema=TOLD_SCHEMA)

    return reduce


class Told:
    """What ``tell`` returned to one block, by kind."""

    def __init__(self, table: pa.Table, widths: dict[int, int] | None = None):
        self.kinds = {}
        kinds = table["kind"].to_numpy() if table.num_rows else np.zeros(0, np.int32)
        for kind in np.unique(kinds).tolist():
            part = table.filter(pa.array(kinds == kind))
            width = (widths or {}).get(kind, 8)
            keys = np.frombuffer(b"".join(part["keys"].to_pylist()), f"u{width}")
            if width == 4:  # the high half of a key is its bucket
                sizes = [len(x) // width for x in part["keys"].to_pylist()]
                keys = np.repeat(part["bucket"].to_numpy().astype(U64) << U64(32), sizes) | keys
            totals = unplanes(part["totals"].to_pylist(), np.uint32)
            leads, loose = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint8) for c in ("leads", "open"))
            by = np.argsort(keys, kind="stable")
            self.kinds[kind] = keys[by], totals[by], leads[by], loose[by]

    def look(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it was returned, its total (1 if not), whether this block has the first, whether it
        is open."""
        if kind not in self.kinds or not len(keys):
            return np.zeros(len(keys), bool), np.ones(len(keys), np.uint32), np.ones(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
        have, totals, leads, loose = self.kinds[kind]
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        hit = have[at] == keys
        return hit, np.where(hit, totals[at], 1), np.where(hit, leads[at], 1), np.where(hit, loose[at], 0)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in a span [start, end)."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0
