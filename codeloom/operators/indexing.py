"""Index runs: what a tree changed since the current version is parsed, everything else is carried over."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.resolution import resolve
from codeloom.parsers import parse_sources
from codeloom.sources import scan
from codeloom.sources.git import Change, Repository
from codeloom.sources.store import FORMAT, TABLES, Store


def states(listing: DataFrame, old: DataFrame, max_size: int) -> DataFrame:
    """path, language, size, mtime and state: new, skipped (too large and new), same (size and time agree), check or
    deleted. Only new and check need their contents read."""
    was = old.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("had"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    state = F.when(F.col("language").isNull(), "deleted").when(F.col("had").isNull(), F.when(F.col("size") > max_size, "skipped").otherwise("new")).when(same, "same").otherwise("check")
    return listing.join(was, "path", "full_outer").withColumn("state", state).select("path", "language", "size", "mtime", "state")


def apply(store: Store, listing_states: DataFrame, sources: DataFrame, go_module: str | None = None, packages: dict | None = None) -> dict:
    """Writes the next version. sources: path, language, size, mtime, hash, content of the new and the checked files."""
    version = store.begin()
    folder, spark = store.at(version), store.spark
    keep = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.schema(df.schema).parquet(f"{folder}/{name}"))[1]
    old = {t: store.table(t) for t in TABLES}
    listing = keep(listing_states, "_states")
    read = sources.join(old["files"].select("path", F.col("hash").alias("old_hash")), "path", "left")
    touched = read.filter("old_hash IS NULL OR hash <> old_hash")
    parsed = keep(parse_sources(touched, go_module, packages).join(touched.select("path", "language", "size", "mtime", "hash"), "path").withColumn("id", F.xxhash64("path")), "_parsed")
    # paths whose rows are replaced or go; a file whose bytes did not change only gets its new size and time
    gone = listing.filter("state = 'deleted'").select("path")
    stale = gone.union(parsed.select("path"))
    now = listing.filter("state IN ('same', 'check')").select("path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"))
    stay = old["files"].join(stale, "path", "left_anti").join(now, "path", "left")
    stay = stay.withColumns({"size": F.coalesce("new_size", "size"), "mtime": F.coalesce("new_mtime", "mtime")})
    names = list(TABLES["files"].replace(",", "").split())[::2]
    files = keep(stay.select(*names).unionByName(parsed.select(*names)), "files")

    ids = stale.select(F.xxhash64("path").alias("file_id"))
    fresh = parsed.select(F.col("id").alias("file_id"), F.posexplode("symbols").alias("n", "s")).select(F.xxhash64("file_id", "n", F.lit("s")).alias("id"), "file_id", "s.*")
    keep(old["symbols"].join(ids, "file_id", "left_anti").select(*fresh.columns).unionByName(fresh), "symbols")

    edges = parsed.select("path", F.posexplode("imports").alias("n", "i")).select("path", "n", "i.*")
    made = resolve(edges, files).select(
        F.xxhash64("path", "n").alias("id"), F.xxhash64("path").alias("source_file_id"), F.when(F.col("target_path").isNotNull(), F.xxhash64("target_path")).alias("target_file_id"), "imported_symbol",
        F.col("type").alias("dependency_type"), F.col("raw").alias("source_raw"), "resolution",
    )
    lost = gone.select(F.xxhash64("path").alias("target_file_id"))
    rest = old["dependencies"].join(ids.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_anti").join(lost, "target_file_id", "left_anti")
    keep(rest.select(*made.columns).unionByName(made), "dependencies")
    counts = {r.state: r.n for r in listing.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = parsed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("symbols")).alias("s"), F.count_if("has_errors").alias("e")).first()
    present = sum(n for s, n in counts.items() if s != "deleted")
    store.commit(version)
    checked = counts.get("new", 0) + counts.get("check", 0)
    return {"total_files": present, "supported_files": present, "new_files": counts.get("new", 0), "parsed_files": done.n, "changed_files": max(done.n - counts.get("new", 0), 0), "unchanged_files": counts.get("same", 0),
            "metadata_only": max(checked - done.n, 0), "skipped_files": counts.get("skipped", 0), "deleted_files": counts.get("deleted", 0), "symbols_parsed": done.s or 0, "parse_errors": done.e}


def run_index(spark: SparkSession, root: str, store: Store, config: dict | None = None, force: bool = False) -> dict:
    config = config or scan.load_config(root)
    if force:
        store.wipe()
    found = states(scan.scan(spark, root, config), store.table("files"), config["index"]["max_file_size"])
    sources = scan.contents(found.filter("state IN ('new', 'check')"), root)
    return apply(store, found, sources, scan.go_module(root), scan.workspace_packages(root))


def index_paths(spark: SparkSession, root: str, store: Store, paths: DataFrame) -> dict:
    """Only the given paths, as a watcher reports them: missing ones leave the index, the others are read again. The tree
    isn't walked; the driver looks at the given paths, which are those of one batch of changes."""
    known = store.table("files").join(paths.select("path").distinct(), "path", "left_semi")
    config = scan.load_config(root)
    found = (scan.entry(root, r.path, config["index"]["exclude"], config["index"]["follow_symlinks"]) for r in paths.select("path").distinct().toLocalIterator())
    now = spark.createDataFrame([x for x in found if x], scan.LISTING)
    found = states(now, known, config["index"]["max_file_size"])
    return apply(store, found, scan.contents(found.filter("state IN ('new', 'check')"), root), scan.go_module(root), scan.workspace_packages(root))


def sync_changed(spark: SparkSession, repository: Repository, root: str, store: Store) -> dict | None:
    """Brings the index up to date with the files that version control calls changed; None if there are none."""
    at = os.path.relpath(root, repository.root)
    paths = [c.path if at == "." else os.path.relpath(c.path, at) for c in repository.changes() for c in ([c, Change(c.old_path, "D")] if c.old_path and c.status == "R" else [c])]
    inside = [(p,) for p in paths if not p.startswith("..") and scan.language_of(p)]
    return index_paths(spark, root, store, spark.createDataFrame(inside, "path string")) if inside else None


def integrity(store: Store) -> dict:
    """A quick check of the current version: its tables can be read, ids are unique, and every reference has its file."""
    g = store.graph()
    ids = g.files.select(F.col("id").alias("file_id"))
    checks = {
        "duplicate_files": g.files.groupBy("id").count().filter("count > 1"),
        "orphaned_symbols": g.symbols.join(ids, "file_id", "left_anti"),
        "orphaned_dependencies": g.dependencies.join(ids.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_anti"),
        "dangling_targets": g.edges().join(ids.withColumnRenamed("file_id", "target_file_id"), "target_file_id", "left_anti"),
    }
    counts = {name: df.count() for name, df in checks.items()}
    return {"healthy": not any(counts.values()) and store.format() == FORMAT, "schema_version": store.format(), **counts}


def freshness(spark: SparkSession, root: str, store: Store, config: dict | None = None) -> dict:
    """READY, STALE or NOT_INITIALIZED, with the counts of files that differ."""
    if not store.versions():
        return {"status": "NOT_INITIALIZED"}
    config = config or scan.load_config(root)
    counts = {r.state: r.n for r in states(scan.scan(spark, root, config), store.table("files"), config["index"]["max_file_size"]).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    stale = {k: counts.get(k, 0) for k in ("new", "check", "deleted")}
    return {"status": "STALE" if any(stale.values()) else "READY", **stale, "files": sum(counts.values()) - stale["deleted"]}
