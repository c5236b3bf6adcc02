"""Searches and lookups over the relations; sorts end in the id, so limits are deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import hub_bonus, is_test, like_any
from codeloom.sources.bindings import Graph
from codeloom.sources.scratch import cut

KINDS = {k: k for k in "function method class interface type enum constant variable struct trait module field constructor impl".split()} | {"fn": "function", "alias": "type", "const": "constant"}


def search(g: Graph, term: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    found = g.symbols.filter(like_any(F.col("name"), term))
    if kind is not None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        found = found.filter(F.col("kind") == KINDS[kind])
    top = found.orderBy(F.when(F.col("name") == term, 0).otherwise(1), "start_line", "id").limit(max(1, min(500, limit)))
    return top.join(g.files.select(F.col("id").alias("fid"), "path"), F.col("file_id") == F.col("fid")).select("id", "name", "kind", "parent", "signature", "start_line", "path", F.col("path").alias("file"), F.concat_ws(".", "parent", "name").alias("display"))


def files_like(g: Graph, needle: str, limit: int) -> DataFrame:
    return g.files.filter(like_any(F.col("path"), needle)).orderBy("path").limit(limit).select("id", "path", "language", "size")


def symbols_where(g: Graph, limit: int | None = None, **equal) -> DataFrame:
    found = g.symbols
    for name, value in equal.items():
        found = found.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    found = found.orderBy("start_line", "id")
    return (found.limit(limit) if limit else found).select("id", "name", "kind", "parent", "start_line")


def outgoing(g: Graph, file_id: int, external: bool = False) -> DataFrame:
    own = g.dependencies.filter(F.col("source_file_id") == file_id)
    files = g.files.select(F.col("id").alias("target_file_id"), "path")
    return own.join(files, "target_file_id", "left" if external else "inner").select("path", "imported_symbol").orderBy("path", "imported_symbol")


def incoming(g: Graph, file_id: int) -> DataFrame:
    own = g.dependencies.filter(F.col("target_file_id") == file_id)
    return own.join(g.files.select(F.col("id").alias("source_file_id"), "path"), "source_file_id").select("path", "imported_symbol")


def in_degree(g: Graph) -> DataFrame:
    n = g.edges().groupBy(F.col("target_file_id").alias("file_id")).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("bonus", hub_bonus(F.col("rows")))


def _uses(g: Graph) -> DataFrame:
    return g.edges().select("source_file_id", "target_file_id", "imported_symbol")


def references(g: Graph, symbols: DataFrame) -> DataFrame:
    """Who uses each of symbols (id, file_id, name): edges that name it if any edge into its file names a symbol, else
    all edges into the file."""
    edges = _uses(g)
    named = edges.groupBy("target_file_id").agg(F.max(F.col("imported_symbol").isNotNull()).alias("named")).filter("named")
    wanted = symbols.select("id", F.col("file_id").alias("target_file_id"), "name").join(named, "target_file_id", "left")
    by_name = wanted.filter("named").join(edges, "target_file_id").filter("imported_symbol = name")
    by_file = wanted.filter("named IS NULL").join(edges, "target_file_id")
    kept = by_name.unionByName(by_file).select("id", "source_file_id", "imported_symbol")
    return kept.join(g.files.select(F.col("id").alias("source_file_id"), "path"), "source_file_id").select("id", "path", "imported_symbol")


def details(g: Graph, found: DataFrame) -> dict[str, DataFrame]:
    """Members, references and dependencies of each of found (id, file_id, name, parent), by its id: one join each."""
    owner = F.when(F.col("parent").isNotNull() & (F.col("parent") != ""), F.col("parent")).otherwise(F.col("name"))
    own = found.select("id", "file_id", owner.alias("owner"))
    members = g.symbols.filter(F.col("kind").isin("method", "field")).select(F.col("id").alias("member"), "file_id", F.col("parent").alias("owner"), "name", "kind", "signature", "start_line")
    files = g.files.select(F.col("id").alias("target_file_id"), "path")
    uses = found.select("id", F.col("file_id").alias("source_file_id")).join(_uses(g), "source_file_id").join(files, "target_file_id")
    return {
        "methods": own.join(members, ["file_id", "owner"]).select("id", "member", "name", "kind", F.col("owner").alias("parent"), "signature", "start_line"),
        "references": references(g, found),
        "dependencies": uses.select("id", "path", "imported_symbol"),
    }


def reachable(g: Graph, start: int, depth: int) -> DataFrame:
    """Files that depend on start, with their least distance: one level a step, each file once. Each level is cut, so a
    plan never has more than one join; levels end with the first that adds nothing."""
    edges = cut(g.edges().select(F.col("target_file_id").alias("at"), F.col("source_file_id").alias("id")).distinct())
    seen = front = cut(g.files.filter(F.col("id") == start).select("id", F.lit(0).alias("distance")))
    for step in range(1, max(1, min(20, depth)) + 1):
        front = cut(front.select(F.col("id").alias("at")).join(edges, "at").select("id").distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen.filter("distance > 0")


def reachable_counts(g: Graph, start: int, depth: int) -> tuple[DataFrame, int]:
    """The reachable files and how many they are."""
    found = reachable(g, start, depth)
    return found, found.count()


def impact(g: Graph, start: int, depth: int = 3) -> DataFrame:
    hit = reachable(g, start, depth).join(g.files.select("id", "path"), "id")
    bucket = F.when(is_test(F.col("path")), "tests").when(F.col("distance") == 1, "direct").otherwise("indirect")
    count = g.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))
    return hit.join(count, "id", "left").select("path", "distance", bucket.alias("bucket"), F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"))


def unknown(g: Graph, start: int, depth: int = 3) -> DataFrame:
    """Unresolved dependencies of the start and of all it reaches, by file."""
    files = reachable(g, start, depth).select("id").union(g.files.filter(F.col("id") == start).select("id"))
    return g.dependencies.filter("target_file_id IS NULL").join(files.withColumnRenamed("id", "source_file_id"), "source_file_id").groupBy("source_file_id").agg(F.count(F.lit(1)).alias("unresolved"))


def resolve_file(g: Graph, name: str) -> DataFrame:
    """(path, id) of one file: the exact path, else the first of 20 that contain the name."""
    exact = g.files.filter(F.col("path") == name).select("path", "id", F.lit(0).alias("way"))
    near = g.files.filter(like_any(F.col("path"), name)).orderBy("path").limit(20).filter(F.col("path").contains(name)).select("path", "id", F.lit(1).alias("way"))
    return exact.union(near).orderBy("way", "path").limit(1).select("path", "id")


def _located(g: Graph, found: DataFrame) -> DataFrame:
    return found.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")


def _member(g: Graph, name: str, last: bool) -> DataFrame:
    parent, _, own = name.rpartition(".") if last else name.partition(".")
    return g.symbols.filter((F.col("parent") == parent) & (F.col("name") == own))


def resolve_symbol(g: Graph, name: str, limit: int = 200) -> DataFrame:
    """Symbols of a name, or Parent.member split at the first dot if that finds any; those of tests last."""
    bare = g.symbols.filter(F.col("name") == name).withColumn("way", F.lit(1))
    if "." in name:
        bare = bare.unionByName(_member(g, name, False).withColumn("way", F.lit(0)))
        bare = bare.join(bare.agg(F.min("way").alias("way")), "way")
    top = bare.orderBy("start_line", "id").limit(limit).drop("way")
    return _located(g, top).orderBy(is_test(F.col("path")), "start_line", "id").select("id", "file_id", "name", "kind", "parent", "signature", "start_line", "path")


def resolve_target(g: Graph, target: str) -> DataFrame:
    """(path, id, symbol) that a target means: an exact path, then a path that contains it among the first ten like it,
    then a symbol of that name, then Parent.member; symbols outside tests first."""
    none = F.lit(None).cast("string").alias("symbol")
    ways = [g.files.filter(F.col("path") == target).select(F.lit(0).alias("way"), F.lit(False).alias("test"), F.lit(0).alias("place"), "path", "id", none)]
    near = g.files.filter(like_any(F.col("path"), target)).orderBy("path").limit(10).filter(F.col("path").contains(target))
    ways.append(near.select(F.lit(1), F.lit(False), F.lit(0), "path", "id", none))
    names = [g.symbols.filter(F.col("name") == target)] + ([_member(g, target, False)] if "." in target else [])
    for k, found in enumerate(names):
        top = _located(g, found.orderBy("start_line", "id").limit(10))
        ways.append(top.select(F.lit(2 + k), is_test(F.col("path")), F.col("start_line").cast("int"), "path", F.col("file_id"), F.col("name")))
    out = ways[0]
    for way in ways[1:]:
        out = out.union(way)
    return out.orderBy("way", "test", "place", "path").limit(1).select("path", "id", "symbol")


def diff_impact(g: Graph, changed: DataFrame, limit: int = 20) -> DataFrame:
    """Paths that depend on a changed path directly, each once, the first by name."""
    ids = g.files.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("target_file_id"))
    hit = g.edges().join(ids, "target_file_id", "left_semi").select(F.col("source_file_id").alias("id")).distinct()
    return hit.join(g.files.select("id", "path"), "id").select("path").orderBy("path").limit(limit)
