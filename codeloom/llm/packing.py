"""Hierarchical multi-length packing.

Documents are encoded, closed with an end id and routed to tiers by length: whole windows of the longest context size
first, then the rest to the smallest context size that holds it. Each tier packs its longest rest first. The gap that is
left is filled with whole rests of that or a shorter tier, longest first, and its last places with the head of a cut
one, so that windows are full; what is cut off is routed again. The rest of a partition, less than a window, falls into
powers of two and at most one padded sequence. Sequences are then dealt to step groups, longest first, each to the group
with the fewest ids.

It needs no shuffle: a partition is read in pools of bounded size, and open rests pass from pool to pool. Sequences lie
within a partition (``sequence_id`` = partition * 2^32 + number), so a repeated task rebuilds its own ones whole.

Defined cases: a null or empty text is the end id alone; very long texts give many windows; rows that repeat a doc_id
are packed one by one; a null doc_id stays null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import tidy
from codeloom.llm.tokens import encoder

TIERS = (128, 256, 512, 1024)
CALL_DOCS, POOL_DOCS, GROUP_SEQUENCES, LEAST = 4096, 512, 8, 16
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs (key, length) documents; finished sequences are lists of (key, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = sorted(tiers), max(tiers)
        self.rests: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # by tier, of (length, key, start), ascending
        self.open = [0] * len(tiers)  # ids in each

    def add(self, key: int, length: int) -> Iterator[tuple[int, list]]:
        full = length // self.longest * self.longest
        for start in range(0, full, self.longest):
            yield self.longest, [(key, start, self.longest)]
        self._route(length - full, key, full)

    def _route(self, length: int, key: int, start: int) -> None:
        if length:
            tier = next(k for k, t in enumerate(self.tiers) if length <= t)
            insort(self.rests[tier], (length, key, start))
            self.open[tier] += length

    def _pop(self, tier: int, at: int) -> tuple[int, int, int]:
        got = self.rests[tier].pop(at)
        self.open[tier] -= got[0]
        return got

    def _take(self, room: int, top: int) -> tuple[int, int, int] | None:
        """The longest rest up to tier ``top`` that fits."""
        for k in range(top, -1, -1):
            if at := bisect_right(self.rests[k], (room, 1 << 62, 1 << 62)):
                return self._pop(k, at - 1)
        return None

    def windows(self, last: bool = False) -> Iterator[tuple[int, list]]:
        """Full windows as long as the rests suffice; with last also sequences of what is left."""
        for top in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[top]
            while self.rests[top] and sum(self.open[: top + 1]) >= size:
                yield size, self._fill(size, top)
        if last:
            total = sum(self.open)
            while total:
                size = min(self.longest, 1 << (total.bit_length() - 1))
                size = size if size >= LEAST else total
                yield self.longest if size & (size - 1) else size, self._fill(size, len(self.tiers) - 1)
                total -= size

    def _fill(self, size: int, top: int) -> list[tuple[int, int, int]]:
        pieces, room = [], size
        while room:
            got = self._take(room, top)
            if got is None:  # cut the shortest that there is
                length, key, start = self._pop(next(k for k in range(top + 1) if self.rests[k]), 0)
                self._route(length - room, key, start + room)
                got = (room, key, start)
            pieces.append((got[1], got[2], got[0]))
            room -= got[0]
        return pieces


def _grouped(lengths: list[int], size: int) -> list[int]:
    """Step groups of even total: longest first, each to the lightest group with a free place."""
    heap = [(0, g, 0) for g in range(-(-len(lengths) // size))]
    group = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        total, g, n = heapq.heappop(heap)
        group[k] = g
        if n + 1 < size:
            heapq.heappush(heap, (total + lengths[k], g, n + 1))
    return group


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the length to which
    the sequence is padded), step_group, and with with_ids the ids themselves (``ids``, unsigned 32 bits each)."""
    schema = PIECE.append(pa.field("ids", pa.binary())) if with_ids else PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tidy("encoders")
        enc, packer = encoder(tokenizer), Packer(tiers)
        base = TaskContext.get().partitionId() << 32
        number = steps = turn = 0
        live: dict[int, list] = {}  # documents with open ids: doc_id, ids, number of ids that are out

        def out(sequences: list[tuple[int, list]]) -> pa.RecordBatch:
            nonlocal number, steps
            rows, groups = [], _grouped([sum(p[2] for p in s) for _, s in sequences], GROUP_SEQUENCES)
            for (tier, pieces), group in zip(sequences, groups):
                offset = 0
                for key, start, length in pieces:
                    doc = live[key]
                    ids = doc[1][start : start + length].tobytes()
                    rows.append((doc[0], start, length, zlib.crc32(ids), len(doc[1]), base + number, offset, tier, base + steps + group, *([ids] if with_ids else [])))
                    offset += length
                    doc[2] += length
                    if doc[2] == len(doc[1]):
                        del live[key]
                number += 1
            steps += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for k in range(0, len(ids), CALL_DOCS):
                encoded = enc.encode(texts[k : k + CALL_DOCS])
                for pool in range(0, len(encoded), POOL_DOCS):
                    done = []
                    for doc_id, x in zip(ids[k + pool : k + pool + POOL_DOCS], encoded[pool : pool + POOL_DOCS]):
                        live[turn] = [doc_id, np.append(x, np.uint32(end_id)).astype("<u4"), 0]
                        done += packer.add(turn, len(x) + 1)
                        turn += 1
                    done += packer.windows()
                    if done:
                        yield out(done)
        if done := list(packer.windows(last=True)):
            yield out(done)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE_DDL + (", ids binary" if with_ids else ""))
