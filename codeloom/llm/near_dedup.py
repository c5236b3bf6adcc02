"""MinHash near-deduplication with sequential Bayesian verification.

1. Texts with equal word sequences form a class; classes are compared, never copies.
2. A class has a MinHash signature, cut into bands; classes that agree in a band meet in a bucket.
3. Signature batches of the members of a bucket, one bit of each hash, are compared within one task: a pair is pruned once
   the posterior probability of a similarity at the threshold (uniform prior, binomial likelihood) falls below ``miss``.
   A bucket gives a spanning forest of what is left, never its pairs; connected, these forests are candidate groups.
4. Within a candidate group, in one task, pairs are compared by whole hashes, batch by batch, with the same pruning;
   survivors are verified on their full shingle sets, which are compared by their words and not by hashes. A text that
   is linked to a group is compared only with those outside of it, and a spanning forest of links comes out.
Buckets of over ``bucket`` classes and candidate groups of over ``chunk`` bytes are split into chunks. Of a bucket each
pair of chunks is a task. A candidate group first links each chunk for itself; then those that are not yet in its largest
part, in chunks again, meet all chunks. So every pair that shares a bucket is either connected by verified links or was
compared itself, while no row is ever a pair but for the forests: at most one row a class and task. With the given bands a
pair at the threshold shares no bucket with a probability under 1e-6, and is pruned by a batch with one of ``miss``.

Defined cases: a text without words (null, empty, white space) has an empty set and stays alone; texts with fewer words
than a shingle have their sequence as one; rows with a null doc_id stay alone, with a null component; rows that repeat a
doc_id are texts of their own with one component id if they link; an empty table gives an empty result; ``near_duplicates``
returns its own columns only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import MIX, MULTIPLIERS, Tables, U64, Words, mix, shuffle_parts, spans_of, split_words, tidy

SKETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("size", pa.int64()), ("signature", pa.binary()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64()))])
SKETCH_DDL = "doc_id long, mark long, key binary, n_shingles long, size long, signature binary, bits binary, bands array<long>"
PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
PAIR_DDL = "a binary, b binary"
STEP_BYTES, SEED, BATCH, SMALL, STRIP = 1 << 20, 29, 30, 64, 1 << 18
#: Classes of a bucket and bytes of text of a candidate group that one task compares; rows and bytes that a task takes.
BUCKET, CHUNK_BYTES, SLOT_ROWS, SLOT_BYTES = 1 << 14, 8 << 20, 1 << 18, 8 << 20


def least_matches(compared: int, percent: float, miss: float) -> int:
    """The fewest matches of so many hashes at which a similarity of the threshold isn't ruled out: for a uniform
    prior the posterior P(s >= t) after m of n matches is P(Bin(n + 1, t) <= m)."""
    t, total = percent / 100, 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if total >= miss:
            return m
    return compared


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words).lower(), digest_size=16).digest()


def _sketch(ids: list, marks: list, texts: list, size: int, rows: int, bands: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    words = Words(texts, lower=True)
    keys = [_key(w) for w in words.words]
    has = np.flatnonzero(words.n)
    signatures, bits, counts = [None] * len(ids), [None] * len(ids), np.zeros(len(ids), np.int64)
    buckets: list = [[]] * len(ids)
    if len(has):
        owner, _, h = words.shingles(size)
        h = (h >> U64(32)).astype(np.uint32)
        counts = np.bincount(owner, minlength=len(ids))
        begin = (np.cumsum(counts) - counts)[has]
        sig = np.empty((len(has), rows * bands), np.uint32)
        for k in range(rows * bands):
            sig[:, k] = np.minimum.reduceat((h ^ b[k]) * a[k], begin)
        spot = np.arange(bands, dtype=U64)
        code = np.zeros((len(has), bands), U64)
        for k in range(rows):
            code = mix(code * U64(MULTIPLIERS[1]) + sig[:, k * bands : (k + 1) * bands].astype(U64) + spot)
        sig = mix(sig.astype(U64) + U64(MIX))  # minima are small numbers, so their bits are mixed before they are cut
        short = (sig >> U64(48)).astype(np.uint16)
        packed = np.packbits(np.pad((sig & U64(1)).astype(np.uint8), ((0, 0), (0, -sig.shape[1] % 64))), axis=1)
        for row, k in enumerate(has):
            signatures[k], bits[k], buckets[k] = short[row].tobytes(), packed[row].tobytes(), code[row].view(np.int64)
    long = [sum(map(len, w)) + len(w) for w in words.words]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, marks, keys, counts, long, signatures, bits, buckets), SKETCH)], schema=SKETCH)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))


def sketches(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    random = np.random.default_rng(SEED)
    a = random.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = random.integers(0, 1 << 32, rows * bands, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            ids, marks, texts = (batch[c].to_pylist() for c in ("doc_id", "mark", "text"))
            begin = held = 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held > STEP_BYTES or k == len(texts) - 1:
                    here = slice(begin, k + 1)
                    yield _sketch(ids[here], marks[here], texts[here], size, rows, bands, a, b)
                    begin, held = k + 1, 0

    return _slim(docs).mapInArrow(run, SKETCH_DDL)


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components. Of each key's links to lesser keys, the one to the least stays; the
    others go from that least key to the other ends, and meet there those of the key's neighbours. What is collected is
    at most what one key has: one link for each task that saw it."""
    ends = links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("ends"))
    turned = F.transform("ends", lambda x, k: F.when(k == 0, F.col("b")).otherwise(x))
    return ends.select(F.col("ends")[0].alias("a"), F.explode(turned).alias("b")).distinct()


def components(links: DataFrame, cut) -> DataFrame:
    """(key, label) of all keys in links (a, b): the label is the least key of the component. cut: keeps an intermediate
    table."""
    links = thinned(links)
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:  # labels spread to neighbours, then to the label's label
        near = edges.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("label").alias("near"))
        step = cut(labels.join(near, F.col("key") == F.col("a")).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = step.select(F.col("key").alias("up"), F.col("label").alias("top"))
        labels = cut(step.join(up, F.col("label") == F.col("up")).select("key", "old", F.least("label", "top").alias("label")))
        if not labels.filter("label != old").limit(1).count():
            return labels.select("key", "label")
        labels = labels.select("key", "label")


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n places, for edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _grown(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """As _connected, where near(x, others) tells which of others x has an edge to; each member that is reached is
    compared only with those that aren't."""
    left, label = np.arange(n), np.arange(n)
    while len(left):
        seed, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            hit = near(queue.pop(), left)
            label[left[hit]] = seed
            queue += left[hit].tolist()
            left = left[~hit]
    return label


def _slotted(rows: DataFrame, *keys: str, slots: int) -> DataFrame:
    """rows with the number of the task that takes them."""
    return rows.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(max(1, slots))))


def _edges_of(keys: pa.Array, label: np.ndarray) -> pa.Table:
    """A star for each component: (label, member)."""
    other = np.flatnonzero(label != np.arange(len(label)))
    return pa.Table.from_arrays([keys.take(pa.array(label[other])), keys.take(pa.array(other))], schema=PAIR)


def _ranked(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys in order, and the place of each row's key: the tasks that see a group then agree on its centre."""
    keys = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(keys.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys.dictionary.take(pa.array(order)), place[keys.indices.to_numpy()]


def _groups(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The row numbers of each distinct row of integer columns."""
    numbers = [c.to_numpy() for c in columns]
    by = np.lexsort(numbers)
    new = np.zeros(len(by), bool)
    for c in numbers:
        new[1:] |= c[by][1:] != c[by][:-1]
    return np.split(by, np.flatnonzero(new)) if len(by) else []


def _met(percent: int, hashes: int, miss: float):
    """Candidate edges of the buckets of a task, by one bit of each hash: equal hashes have equal bits, others half of
    the time, so a similarity of s means that (1 + s) / 2 of the bits are expected to agree."""
    words = -(-hashes // 64)
    most = [n - least_matches(n, 50 + percent / 2, miss) for n in (min(hashes, 64 * (k + 1)) for k in range(words))]  # that may differ

    def run(table: pa.Table) -> pa.Table:
        tidy()
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), U64).reshape(-1, words)

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            alive, apart = np.arange(len(b)), np.zeros(len(b), np.int64)
            for k in range(words):
                apart += np.bitwise_count(bits[a if np.ndim(a) == 0 else a[alive], k] ^ bits[b[alive], k])
                ok = apart <= most[k]
                alive, apart = alive[ok], apart[ok]
            hit = np.zeros(len(b), bool)
            hit[alive] = True
            return hit

        lefts, rights, held = [], [], 0
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if lefts:
                a, b = np.concatenate(lefts), np.concatenate(rights)
                hit = alike(a, b)
                found.append((a[hit], b[hit]))
                lefts.clear(), rights.clear()

        corners = {}
        for rows in _groups(table["band"], table["i"], table["j"]):
            m = len(rows)
            if m <= SMALL:
                if m not in corners:
                    corners[m] = np.triu_indices(m, 1)
                lefts.append(rows[corners[m][0]])
                rights.append(rows[corners[m][1]])
                held += len(lefts[-1])
                if held > STRIP:
                    flush()
                    held = 0
            else:
                label = _grown(m, lambda x, others, rows=rows: alike(rows[x], rows[others]))
                found.append((rows, rows[label]))
        flush()
        keys, number = _ranked(table["key"])
        a, b = (number[np.concatenate([x[side] for x in found])] if found else number[:0] for side in (0, 1))
        return _edges_of(keys, _connected(len(keys), a, b))

    return run


class _Set:
    """The distinct classes of a task: signatures and exact shingles."""

    def __init__(self, table: pa.Table, size: int, percent: int, miss: float):
        self.keys = table["key"].combine_chunks()
        words = Words(table["text"].to_pylist(), lower=True)
        owner, code, _ = words.shingles(size)
        self.code = np.unique(code, return_inverse=True)[1]
        self.n = np.bincount(owner, minlength=table.num_rows)
        self.at = np.cumsum(self.n) - self.n
        self.mark = np.zeros(self.code.max(initial=0) + 1, np.int64)
        self.signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
        self.percent, hashes = percent, self.signature.shape[1]
        self.steps = [(n - BATCH, n, least_matches(n, percent, miss)) for n in range(BATCH, hashes + 1, BATCH)]

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.n[x], self.n[others]), np.maximum(self.n[x], self.n[others])
        alive = np.flatnonzero(100 * low >= self.percent * high)
        matches = np.zeros(len(alive), np.int64)
        for a, b, least in self.steps:
            matches += (self.signature[others[alive], a:b] == self.signature[x, a:b]).sum(1)
            ok = matches >= least
            alive, matches = alive[ok], matches[ok]
        hit = np.zeros(len(others), bool)
        if len(alive):
            own = self.code[self.at[x] : self.at[x] + self.n[x]]
            self.mark[own] = 1
            for k in range(0, len(alive), 1024):  # survivors are verified on their whole sets
                part = others[alive[k : k + 1024]]
                n = self.n[part]
                both = np.add.reduceat(self.mark[self.code[spans_of(n, self.at[part])]], np.cumsum(n) - n)
                hit[alive[k : k + 1024]] = 100 * both >= self.percent * (self.n[x] + n - both)
            self.mark[own] = 0
        return hit


def _distinct(table: pa.Table, *columns: str) -> pa.Table:
    """The first row of each key (and column); rows whose text isn't that of their key go."""
    seen, keep = set(), []
    for k, (text, row) in enumerate(zip(table["text"].to_pylist(), zip(*(table[c].to_pylist() for c in ("key", *columns))))):
        if row not in seen and _key(split_words(text)) == row[0]:
            seen.add(row)
            keep.append(k)
    return table.take(pa.array(keep, pa.int64()))


def _linked(size: int, percent: int, miss: float):
    """Links within the chunks of a task, as spanning forests."""

    def run(table: pa.Table) -> pa.Table:
        tidy()
        table = _distinct(table)
        whole = _Set(table, size, percent, miss)
        label = np.arange(table.num_rows)
        for rows in _groups(table["group"], table["chunk"]):
            label[rows] = rows[_grown(len(rows), lambda x, others, rows=rows: whole.near(rows[x], rows[others]))]
        return _edges_of(whole.keys, label)

    return run


def _joined(size: int, percent: int, miss: float):
    """Links between texts outside the largest part of their group and a chunk of the group, one for each two parts."""

    def run(table: pa.Table) -> pa.Table:
        tidy()
        table = _distinct(table, "outside", "i", "j")
        whole = _Set(table, size, percent, miss)
        part = table["label"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        outside = table["outside"].to_numpy(zero_copy_only=False)
        a, b = [], []
        for rows in _groups(table["group"], table["i"], table["j"]):
            others = rows[~outside[rows]]
            for x in rows[outside[rows]].tolist():
                apart = others[part[others] != part[x]]
                for y in apart[whole.near(x, apart)].tolist() if len(apart) else ():
                    if part[y] != part[x]:
                        a.append(x)
                        b.append(y)
                        part[rows[part[rows] == part[y]]] = part[x]
        return pa.Table.from_arrays([whole.keys.take(pa.array(c, pa.int64())) for c in (a, b)], schema=PAIR)

    return run


def _part(count: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(salt)), count)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 5, bands: int = 36, miss: float = 1e-9, bucket: int = BUCKET, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least ``percent`` percent), kept."""
    parts = shuffle_parts(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    cut = tables.keep
    seen = cut(sketches(docs, size, rows, bands))
    per_key = seen.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key")
    classes = cut(per_key.agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.first("size").alias("size"), F.first("signature").alias("signature"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))

    # buckets
    met = classes.select("key", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    member = cut(met.join(shared, "band").select("band", "key", "chunks"))
    own = _part(F.col("chunks"))
    meeting = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(own, x).cast("int").alias("i"), F.greatest(own, x).cast("int").alias("j"))))
    seated = member.join(classes.select("key", "bits"), "key").select("band", "key", "bits", meeting.alias("m")).select("band", "key", "bits", "m.*")
    total = member.agg(F.sum("chunks")).first()[0] or 0
    candidates = cut(_slotted(seated, "band", "i", "j", slots=max(parts, total // SLOT_ROWS)).groupBy("slot").applyInArrow(_met(percent, rows * bands, miss), PAIR_DDL))

    # candidate groups, with their texts
    grouped = components(candidates, cut).withColumnRenamed("label", "lead")
    wanted = cut(classes.select("key", "first", "size", "signature").join(grouped, "key"))
    sizes = cut(wanted.groupBy("lead").agg(F.sum("size").alias("bytes")).withColumn("chunks", F.ceil(F.col("bytes") / chunk).cast("int")).withColumn("group", F.xxhash64("lead")))
    slots = max(parts, (sizes.agg(F.sum("bytes")).first()[0] or 0) // SLOT_BYTES)
    facts = wanted.join(sizes.select("lead", "chunks", "group"), "lead").select("lead", "group", "chunks", "key", "signature", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"))
    facts = cut(_slim(docs).join(facts, ["doc_id", "mark"]).select("lead", "group", "chunks", "key", "signature", "text", _part(F.col("chunks")).alias("chunk")))
    links = cut(_slotted(facts, "group", "chunk", slots=slots).groupBy("slot").applyInArrow(_linked(size, percent, miss), PAIR_DDL))

    # what is outside the largest part of a group of several chunks
    labels = components(links, cut)
    large = facts.filter("chunks > 1")
    if large.limit(1).count():
        large = cut(large.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
        main = large.groupBy("lead", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
        main = main.groupBy("lead").agg(F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("bytes") - F.max(F.struct("n", "label", "bytes"))["bytes"]).alias("rest"))
        large = cut(large.join(main, "lead").withColumn("rests", F.ceil(F.col("rest") / chunk).cast("int")).filter("rests > 0"))
        columns = ("group", "key", "label", "signature", "text")
        every = large.select(*columns, F.lit(False).alias("outside"), F.col("chunk").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("j"))
        others = large.filter("label != main").select(*columns, F.lit(True).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), _part(F.col("rests"), 1).cast("int").alias("j"))
        both = every.unionByName(others)
        slots = max(parts, (both.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SLOT_BYTES)
        more = cut(_slotted(both, "group", "i", "j", slots=slots).groupBy("slot").applyInArrow(_joined(size, percent, miss), PAIR_DDL))
        labels = components(links.union(more), cut)

    linked = "n_shingles > 0 AND doc_id IS NOT NULL"
    own = cut(seen.select("doc_id", "n_shingles", "key").join(labels, "key", "left").select("doc_id", "n_shingles", F.coalesce("label", "key").alias("label")))
    least = cut(own.filter(linked).groupBy("label").agg(F.min("doc_id").alias("component_id")))
    tables.drop_all_but(2)
    alone = own.filter(f"NOT ({linked})").withColumn("component_id", F.col("doc_id"))
    whole = own.filter(linked).join(least, "label").select("doc_id", "n_shingles", "component_id").union(alone.select("doc_id", "n_shingles", "component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
