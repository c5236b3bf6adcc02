"""Watching a stream of file events: paths of a micro-batch are taken once, in order, and handed to a change handler."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import indexing
from codeloom.sources import scan
from codeloom.sources.store import Store


def watch(events: DataFrame, handler: Callable[[DataFrame, int], None], interval: str = "200 milliseconds", checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """events: a streaming DataFrame with ``path``. Files of the engine's own folder are ignored. once: takes what is
    there and ends."""

    def batch(rows: DataFrame, epoch: int) -> None:
        handler(rows.filter("path NOT LIKE '.ctx/%'").dropDuplicates(["path"]), epoch)

    out = events.writeStream.foreachBatch(batch)
    out = out.option("checkpointLocation", checkpoint) if checkpoint else out
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()


class _TreeReader(SimpleDataSourceStreamReader):
    """Polls a tree. An offset is the time up to which changes were seen; the listing before it is kept in memory, and
    after a restart every file counts as changed, which a handler that compares contents passes over."""

    def __init__(self, root: str):
        self.root, self.seen = root, None

    def initialOffset(self) -> dict:
        return {"until": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        config = scan.load_config(self.root)["index"]
        now = {path: (size, os.stat(os.path.join(self.root, path)).st_mtime_ns) for path, _, size, _ in scan.walk(self.root, config["exclude"], config["follow_symlinks"])}
        before, self.seen = self.seen if self.seen is not None else {}, now
        paths = [p for p in {**before, **now} if before.get(p) != now.get(p)]
        return iter([(p,) for p in sorted(paths)]), {"until": max(time.time_ns(), start["until"] + 1)} if paths else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        config = scan.load_config(self.root)["index"]
        return iter([(path,) for path, *_ in scan.walk(self.root, config["exclude"], config["follow_symlinks"])])


class TreeSource(DataSource):
    """The paths of a tree as they change: spark.readStream.format("codeloom_tree").option("root", folder)."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_tree"

    def schema(self) -> str:
        return "path string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TreeReader(self.options["root"])


def tree(spark: SparkSession, root: str) -> DataFrame:
    """A streaming DataFrame of the paths that appear, change or go under a root."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("codeloom_tree").option("root", root).load()


def index_changes(spark: SparkSession, root: str, store: Store, emit: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A handler that brings the index up to date with the paths of a batch and emits one JSON line for each path that
    changed: a path whose bytes are what the index has, or in no known language, gives none."""

    def handle(paths: DataFrame, epoch: int) -> None:
        paths = paths.select("path").persist()
        try:
            before = store.table("files").select("path", F.col("hash").alias("old"))
            indexing.index_paths(spark, root, store, paths)
            now = store.table("files").select("path", F.col("hash").alias("new"))
            event = F.when(F.col("new").isNull(), "deleted").otherwise("changed")
            rows = paths.join(before, "path", "left").join(now, "path", "left").filter("NOT (old <=> new)").select("path", event.alias("event"))
            for row in rows.orderBy("path").toLocalIterator():
                emit(json.dumps({"event": row.event, "path": row.path}))
        finally:
            paths.unpersist()

    return handle
