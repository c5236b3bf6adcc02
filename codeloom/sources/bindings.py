"""The three relations (files, symbols, dependencies) bound to the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import language


@dataclass
class Graph:
    files: DataFrame
    symbols: DataFrame
    dependencies: DataFrame

    def edges(self) -> DataFrame:
        return self.dependencies.filter("target_file_id IS NOT NULL")


def star(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts are files, customers symbols, and neighbouring lines of an order dependencies."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part = read("part")
    path = F.expr(
        "concat(element_at(array('src','tests','api','models','vendor','core'), p_size % 6 + 1), '/', lower(p_type), '/', replace(lower(p_brand), '#', '_'), '/',"
        " replace(p_name, ' ', '_'), '_', p_partkey, element_at(array('.ts','.js','.py','.rs','.go'), cast(p_partkey % 5 + 1 AS int)))"
    )
    files = part.select(F.col("p_partkey").alias("id"), path.alias("path"), F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256).alias("hash"), F.col("p_size").cast("long").alias("size")).withColumn("language", language(F.col("path")))
    c = read("customer").crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("n"))))  # one row
    symbols = c.selectExpr(
        "c_custkey AS id",
        "c_custkey % n AS file_id",
        "concat(initcap(c_mktsegment), element_at(array('User','Order','Auth','Report'), cast(c_custkey % 4 + 1 AS int)), c_custkey) AS name",
        "element_at(array('function','method','class','field','constant'), c_nationkey % 5 + 1) AS kind",
        "concat('fn ', lower(c_mktsegment), '(nation ', c_nationkey, ')') AS signature",
        "CASE WHEN c_nationkey % 5 IN (1, 3) THEN concat('Nation', c_nationkey) END AS parent",
        "c_acctbal > 0 AS exported",
        "c_custkey % 97 + 1 AS start_line",
    )
    lines = read("lineitem").selectExpr("l_partkey", "l_quantity", "l_returnflag", "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS t")
    lines = lines.filter("l_quantity >= 45").selectExpr("l_partkey AS source_file_id", "CASE WHEN t % 10 = 1 THEN 0 ELSE t END AS target_file_id", "l_returnflag AS flag")
    first = symbols.groupBy("file_id").agg(F.min("name").alias("first_name"))
    deps = lines.join(first, F.col("target_file_id") == F.col("file_id"), "left").selectExpr("source_file_id", "target_file_id", "CASE flag WHEN 'A' THEN first_name WHEN 'R' THEN 'other' END AS imported_symbol")
    return Graph(files, symbols, deps)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: id, path, text, size, hash."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents: the index and the disk."""
    d = texts(spark, sf_dir).select("id", "path", "text", "size", "hash")
    changed = F.when(F.col("id") % 13 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    head = d.filter("id % 7 <> 0").withColumn("text", changed)
    return d.filter("id % 10 <> 0"), head.withColumn("size", F.octet_length("text").cast("long")).withColumn("hash", F.sha2("text", 256))


#: One import line and one function of each language, as SQL over stem and name; then what is left of the function in a skeleton.
_IMPORT_LINE = {"python": "'import ' || replace(stem, '/', '.')", "typescript": "'import { x } from \"/' || stem || '\";'", "javascript": "'import \"/' || stem || '\";'", "rust": "'use crate::' || replace(stem, '/', '::') || ';'", "go": "'import \"./' || stem || '\"'"}
_FUNCTION = {
    "python": ("'def ' || name || '(a, b):'", "'    return a'", "''", "'    ...'"),
    "typescript": ("'export function ' || name || '(a, b) {'", "'  return a;'", "'}'", None),
    "javascript": ("'function ' || name || '(a, b) {'", "'  return a;'", "'}'", None),
    "rust": ("'pub fn ' || name || '(a: u32) -> u32 {'", "'    a'", "'}'", None),
    "go": ("'func ' || name || '(a int) int {'", "'    return a'", "'}'", None),
}
_NL = "chr(10)"


def import_line() -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _IMPORT_LINE.items()) + f" END || {_NL}"


def function_text(hidden: bool = False) -> str:
    """SQL that both Spark and DuckDB read: three lines for each function, or its skeleton."""
    cases = []
    for k, (head, body, end, short) in _FUNCTION.items():
        inside = f"{_NL} || {body} || {_NL}" if not hidden else f"{_NL} || {short} || {_NL}" if short else "' /* ... implementation hidden ... */ '"
        cases.append(f"WHEN '{k}' THEN {head} || {inside} || {end}")
    return "CASE language " + " ".join(cases) + f" END || {_NL}"


def sources(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The star relations written out as source texts: path, language, content. Every file imports the files that it
    depends on and defines its symbols as functions. The tables of files grow with the input and are larger than Spark
    estimates, so they are merged and not broadcast."""
    g = star(spark, sf_dir)
    own = g.files.select("id", "path", "language").hint("merge")
    target = g.files.select(F.col("id").alias("target_file_id"), F.regexp_replace("path", r"\.[a-z]+$", "").alias("stem")).hint("merge")
    pairs = g.edges().select(F.col("source_file_id").alias("id"), "target_file_id").distinct()
    lines = pairs.join(target, "target_file_id").join(own, "id").withColumn("line", F.expr(import_line())).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("line")), "").alias("imports"))
    named = g.symbols.select(F.col("file_id").alias("id"), "name").join(own, "id").withColumn("body", F.expr(function_text()))
    bodies = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "body"))), lambda x: x["body"]), "").alias("bodies"))
    text = F.concat(F.when(F.col("language") == "go", "package p\n").otherwise(""), F.coalesce("imports", F.lit("")), F.coalesce("bodies", F.lit("")))
    return g, own.join(lines, "id", "left").join(bodies, "id", "left").select("path", "language", F.encode(text, "UTF-8").alias("content"))
