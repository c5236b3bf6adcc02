"""Token files: flat unsigned integers with 64-bit document offsets, written in ascending doc_id order and memory-mapped.

Format: the table is range-partitioned by doc_id; a partition is a shard of three little-endian files, ``.ids`` (all
its ids; 16 bits each if the vocabulary allows, else 32), ``.off`` (64-bit offsets, one more than documents) and
``.doc`` (64-bit doc_ids). The manifest has one row a shard with its number of documents and ids; exclusive prefix sums
over it are the bases that turn a shard's offsets into places in the whole sequence. The driver holds the manifest
only, which has one row a partition.

A task writes to names of its own attempt and returns them, so a repeated task never spoils a shard. Files go to the
folder that the caller names, which must be shared; the queries use the session's checkpoint folder.

Defined cases: a null or empty text has the end id alone; rows with one doc_id follow each other by a hash of the text;
a null doc_id comes first and is stored as -2^63; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import corpus_bytes, shuffle_parts
from codeloom.llm.tokens import encoder

NULL_ID = -(1 << 63)
SHARD = "shard int, path string, docs long, ids long, bits int"
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ_DOCS, SHARD_BYTES = 4096, 256 << 20  # documents read at a time, bytes of text a shard


def filesystem(uri: str):
    """An arrow file system and the path in it, for a local path or any scheme that arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> list[dict]:
    """Encode and write; the manifest in shard order, with ``base`` (ids before the shard)."""
    parts = max(shuffle_parts(docs.sparkSession), corpus_bytes(docs)[1] // SHARD_BYTES + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("turn", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "turn").sortWithinPartitions("doc_id", "turn")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, number = encoder(tokenizer), TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        kind = np.dtype("<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        out, ids, lengths = None, [], [np.zeros(1, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.ids")
            ids.append(np.array([NULL_ID if x is None else x for x in batch["doc_id"].to_pylist()], "<i8"))
            texts = batch["text"].to_pylist()
            for k in range(0, len(texts), READ_DOCS):
                encoded = enc.encode(texts[k : k + READ_DOCS])
                lengths.append(np.array([len(x) + 1 for x in encoded], np.int64))
                out.write(b"".join(y for x in encoded for y in (x.astype(kind).tobytes(), np.array([end_id], kind).tobytes())))
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.concatenate(lengths)).astype("<i8")
        for ending, data in (("off", offsets), ("doc", np.concatenate(ids))):
            with fs.open_output_stream(f"{root}/{name}.{ending}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": number, "path": f"{folder}/{name}", "docs": len(offsets) - 1, "ids": int(offsets[-1]), "bits": kind.itemsize * 8}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bits", pa.int32())]))

    manifest, base = [], 0
    for r in sorted(rows.mapInArrow(shard, SHARD).collect()):
        manifest.append(r.asDict() | {"base": base})
        base += r.ids
    return manifest


def _map(uri: str, kind: str) -> np.ndarray:
    fs, path = filesystem(uri)
    if fs.type_name == "local":
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def open_shard(entry: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets in the shard and ids of a manifest entry, memory-mapped where the file system is local."""
    return _map(entry["path"] + ".doc", "<i8"), _map(entry["path"] + ".off", "<i8"), _map(entry["path"] + ".ids", f"<u{entry['bits'] // 8}")


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    columns = SHARD + ", base long"
    entries = spark.createDataFrame(manifest, columns).repartition(max(1, len(manifest)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry in (e for b in batches for e in b.to_pylist()):
            docs, offsets, ids = open_shard(entry)
            for k in range(0, len(docs), READ_DOCS):
                off = np.asarray(offsets[k : k + READ_DOCS + 1])
                part = np.asarray(ids[off[0] : off[-1]]).astype("<u4")
                at = (off - off[0]).tolist()
                crc = [zlib.crc32(part[a:b]) for a, b in zip(at[:-1], at[1:])]
                ids_here = np.asarray(docs[k : k + READ_DOCS])
                yield pa.RecordBatch.from_arrays([pa.array(ids_here, mask=ids_here == NULL_ID), pa.array(entry["base"] + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], schema=ROWS)

    return entries.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
