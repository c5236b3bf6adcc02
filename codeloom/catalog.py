"""The engine's queries over the bound relations, each with the same question in ANSI SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.fixed import FRAMEWORK_DIRECTORIES, STOP_WORDS
from codeloom.operators import index, indexing, lookup, resolution
from codeloom.parsers import parse_sources
from codeloom.plans import context, package
from codeloom.sources import bindings

#: The numbers are words of one symbol and one path each, so that files reach the score of a root.
KEYWORDS = ["user", "order", "furniture", "models", "report", "117", "101"]
EXCLUDES = ["vendor", "tests/"]
START, HUB = 7, 0

STAR = """
files AS (SELECT p_partkey AS id, (['src','tests','api','models','vendor','core'])[p_size % 6 + 1] || '/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '/'
  || replace(p_name, ' ', '_') || '_' || p_partkey || (['.ts','.js','.py','.rs','.go'])[p_partkey % 5 + 1] AS path, CAST(p_size AS BIGINT) AS size,
  (['typescript','javascript','python','rust','go'])[p_partkey % 5 + 1] AS language FROM part),
symbols AS (SELECT c_custkey AS id, c_custkey % (SELECT count(*) FROM part) AS file_id,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || (['User','Order','Auth','Report'])[c_custkey % 4 + 1] || c_custkey AS name,
  (['function','method','class','field','constant'])[c_nationkey % 5 + 1] AS kind, 'fn ' || lower(c_mktsegment) || '(nation ' || c_nationkey || ')' AS signature,
  CASE WHEN c_nationkey % 5 IN (1, 3) THEN 'Nation' || c_nationkey END AS parent, c_custkey % 97 + 1 AS start_line FROM customer),
lines AS (SELECT l_partkey, l_quantity, l_returnflag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS t FROM lineitem),
moved AS (SELECT l_partkey AS source, CASE WHEN t % 10 = 1 THEN 0 ELSE t END AS target, l_returnflag AS flag FROM lines WHERE l_quantity >= 45),
deps AS (SELECT source, target, CASE flag WHEN 'A' THEN (SELECT min(name) FROM symbols s WHERE s.file_id = target) WHEN 'R' THEN 'other' END AS imported_symbol FROM moved),
degree AS (SELECT target AS file_id, count(*) AS n FROM deps WHERE target IS NOT NULL GROUP BY target)
"""
TEXTS = "texts AS (SELECT doc_id AS id, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, text, octet_length(encode(text)) AS size, sha256(text) AS hash FROM documents)"
SNAPS = TEXTS + """,
old AS (SELECT id, path, text, size, hash FROM texts WHERE id % 10 <> 0),
new AS (SELECT id, path, size, text, sha256(text) AS hash FROM (SELECT id, path, size, CASE WHEN id % 13 = 0 THEN text || ' changed' ELSE text END AS text FROM texts WHERE id % 7 <> 0))"""


def _words(x: str) -> str:
    split = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({split}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _level(words: str, k: str) -> str:
    out = f"CASE WHEN list_contains({words}, '{k}') THEN 3"
    if len(k) >= 4:
        out += f" WHEN len(list_filter({words}, lambda w: octet_length(encode(w)) > {len(k)} AND (starts_with(w, '{k}') OR ends_with(w, '{k}')))) > 0 THEN 2"
    if len(k) >= 5:
        out += f" WHEN len(list_filter({words}, lambda w: w[1:5] = '{k[:5]}')) > 0 THEN 1"
    return out + " ELSE 0 END"


_NW, _SW, _PW = _words("name"), _words("signature"), _words("path")
_FRAME = "0.5 * len(list_filter(string_split(lower(path), '/'), lambda s: list_contains([" + ",".join(f"'{x}'" for x in FRAMEWORK_DIRECTORIES) + "], s)))"
_DF = " UNION ALL ".join(
    f"SELECT '{k}' AS keyword, count(DISTINCT id) AS df FROM (SELECT id FROM files WHERE {_level(_PW, k)} > 0 UNION ALL SELECT file_id FROM symbols WHERE {_level(_NW, k)} > 0)" for k in KEYWORDS
)
_W = f"dfs AS ({_DF}), w AS (SELECT " + ", ".join(f"max(CASE WHEN keyword = '{k}' THEN least(1.0::DOUBLE, 8.0::DOUBLE / greatest(df, 1)) END) AS w{i}" for i, k in enumerate(KEYWORDS)) + " FROM dfs)"
_SCORE = " + ".join(
    f"w{i} * (CASE {_level('nw', k)} WHEN 3 THEN 6 WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 0 END + CASE WHEN {_level('sw', k)} > 0 THEN 1 ELSE 0 END + CASE WHEN {_level('pw', k)} > 0 THEN 1 ELSE 0 END)" for i, k in enumerate(KEYWORDS)
)
_KEYS = " + ".join(f"CASE WHEN {_level('pw', k)} > 0 THEN w{i} ELSE 0 END" for i, k in enumerate(KEYWORDS))
_SYM = f"scored AS (SELECT * FROM (SELECT id, file_id, name, path, {_SCORE} AS score FROM (SELECT s.id, s.file_id, s.name, f.path, {_words('s.name')} AS nw, {_words('s.signature')} AS sw, {_words('f.path')} AS pw FROM symbols s JOIN files f ON f.id = s.file_id), w) WHERE score > 0)"
_FILE = (
    f"best AS (SELECT file_id, max(score) AS best FROM scored GROUP BY file_id), rated AS (SELECT * FROM (SELECT file_id, path, CASE WHEN best IS NOT NULL THEN best + keys + frame + coalesce(0.25 * ln(n + 1), 0) WHEN keys > 0 THEN keys + frame * 0.5 END AS score"
    f" FROM (SELECT f.id AS file_id, f.path, best, n, {_KEYS} AS keys, {_FRAME} AS frame FROM (SELECT id, path, {_PW} AS pw FROM files) f CROSS JOIN w LEFT JOIN best ON best.file_id = f.id LEFT JOIN degree d ON d.file_id = f.id)) WHERE score IS NOT NULL)"
)
_ALL = f"{STAR}, {_W}, {_SYM}, {_FILE}, roots AS (SELECT file_id AS root, score FROM rated WHERE score >= 3.0)"
_TEST = "(len(list_filter(string_split(path, '/'), lambda s: s IN ('test', 'tests', '__tests__'))) > 0 OR regexp_matches(string_split(path, '/')[-1], '(\\.test\\.(ts|tsx|js|jsx)|\\.spec\\.(ts|js)|_test\\.(py|go))$') OR starts_with(string_split(path, '/')[-1], 'test_'))"
_BFS = f"reach(id, distance) AS (SELECT CAST({START} AS BIGINT), 0 UNION SELECT d.source, r.distance + 1 FROM reach r JOIN deps d ON d.target = r.id WHERE r.distance < 3), seen AS (SELECT id, min(distance) AS distance FROM reach GROUP BY id)"


def _tokens(x: str) -> str:
    stop = ",".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) > 1 AND w NOT IN ({stop}))"


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _ORACLE[name] = query, sql


def _star(name: str, make: Callable[[bindings.Graph], DataFrame], sql: str, ctes: str = STAR, recursive: bool = False) -> None:
    _add(name, lambda s, d: make(bindings.star(s, d)), f"WITH {'RECURSIVE ' * recursive}{ctes} {sql}")


def _ranked(name: str, make: Callable[[bindings.Graph, dict], DataFrame], sql: str, recursive: bool = False) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        g = bindings.star(s, d)
        return make(g, context.weights(g, KEYWORDS))

    _add(name, run, f"WITH {'RECURSIVE ' * recursive}{_ALL} {sql}")


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_star("search_symbols", lambda g: lookup.search(g, "buildinguser"), "SELECT s.id, name, kind, parent, signature, start_line, path, path AS file, concat_ws('.', parent, name) AS display FROM (SELECT * FROM symbols WHERE name ILIKE '%buildinguser%' ORDER BY start_line, id LIMIT 50) s JOIN files f ON f.id = file_id")
_star("search_kind", lambda g: lookup.search(g, "order", "fn", 30), "SELECT s.id, name, kind, parent, signature, start_line, path, path AS file, concat_ws('.', parent, name) AS display FROM (SELECT * FROM symbols WHERE name ILIKE '%order%' AND kind = 'function' ORDER BY start_line, id LIMIT 30) s JOIN files f ON f.id = file_id")
_star("files_like", lambda g: lookup.files_like(g, "models/", 20), "SELECT id, path, language, size FROM files WHERE path ILIKE '%models/%' ORDER BY path LIMIT 20")
_star("stats", lambda g: g.files.agg(F.count(F.lit(1)).alias("files")).crossJoin(g.symbols.agg(F.count(F.lit(1)).alias("symbols"))).crossJoin(g.dependencies.agg(F.count(F.lit(1)).alias("dependencies"))), "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM deps) AS dependencies")
_star("symbols_of_file", lambda g: lookup.symbols_where(g, file_id=START), f"SELECT id, name, kind, parent, start_line FROM symbols WHERE file_id = {START}")
_star("symbols_by_name", lambda g: lookup.symbols_where(g, 10, name="MachineryUser84"), "SELECT id, name, kind, parent, start_line FROM symbols WHERE name = 'MachineryUser84' ORDER BY start_line, id LIMIT 10")
_star("qualified_lookup", lambda g: lookup.symbols_where(g, 200, parent="Nation3", kind="field"), "SELECT id, name, kind, parent, start_line FROM symbols WHERE parent = 'Nation3' AND kind = 'field' ORDER BY start_line, id LIMIT 200")
_star("methods_of", lambda g: lookup.symbols_where(g, parent="Nation6", kind=["method", "field"]), "SELECT id, name, kind, parent, start_line FROM symbols WHERE parent = 'Nation6' AND kind IN ('method', 'field')")
_star("deps_outgoing", lambda g: lookup.outgoing(g, START), f"SELECT path, imported_symbol FROM deps JOIN files ON id = target WHERE source = {START}")
_star("deps_with_external", lambda g: lookup.outgoing(g, START, True), f"SELECT path, imported_symbol FROM deps LEFT JOIN files ON id = target WHERE source = {START}")
_star("deps_incoming", lambda g: lookup.incoming(g, HUB), f"SELECT path, imported_symbol FROM deps JOIN files ON id = source WHERE target = {HUB}")
_star("indegree", lambda g: lookup.in_degree(g).select("file_id", "rows"), "SELECT file_id, n AS rows FROM degree")
_star("hub_bonus", lambda g: _r(lookup.in_degree(g).select("file_id", "bonus"), "bonus"), "SELECT file_id, round(0.25 * ln(n + 1), 6) AS bonus FROM degree")
_star("symbols_per_file", lambda g: g.symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")), "SELECT file_id, count(*) AS n FROM symbols GROUP BY file_id")
_star("languages", lambda g: g.files.groupBy("language").agg(F.count(F.lit(1)).alias("n")), "SELECT language, count(*) AS n FROM files GROUP BY language")
_star("test_file_flag", lambda g: g.files.select("path", T.is_test(F.col("path")).alias("is_test")), f"SELECT path, {_TEST} AS is_test FROM files")
_star("exclude_filter", lambda g: g.files.filter(~T.is_excluded(F.col("path"), EXCLUDES)).select("path"), "SELECT path FROM files WHERE NOT (list_contains(string_split(path, '/'), 'vendor') OR list_contains(string_split(path, '/'), 'tests'))")
_star("framework_bonus", lambda g: g.files.select("path", T.framework_bonus(F.col("path")).alias("bonus")), f"SELECT path, CAST({_FRAME} AS DOUBLE) AS bonus FROM files")
_star("impact_bfs", lambda g: lookup.reachable(g, START, 3), f"SELECT id, distance FROM seen WHERE distance > 0", f"{STAR}, {_BFS}", True)
_star("impact_buckets", lambda g: lookup.impact(g, START), f"SELECT path, distance, CASE WHEN {_TEST} THEN 'tests' WHEN distance = 1 THEN 'direct' ELSE 'indirect' END AS bucket, (SELECT count(*) FROM symbols WHERE file_id = seen.id) AS symbols FROM seen JOIN files ON files.id = seen.id WHERE distance > 0", f"{STAR}, {_BFS}", True)
_star("impact_unknown", lambda g: lookup.unknown(g, START), "SELECT source AS source_file_id, count(*) AS unresolved FROM deps JOIN seen ON source = id WHERE target IS NULL GROUP BY source", f"{STAR}, {_BFS}", True)
_METHODS = "kind = 'method'"
_star("symbol_references", lambda g: lookup.references(g, g.symbols.filter(_METHODS)), f"SELECT s.id, path, imported_symbol FROM symbols s JOIN (SELECT *, max(imported_symbol IS NOT NULL) OVER (PARTITION BY target) AS named FROM deps WHERE target IS NOT NULL) d ON d.target = s.file_id JOIN (SELECT id AS fid, path FROM files) ON fid = source WHERE {_METHODS} AND (NOT named OR imported_symbol = s.name)")
_star("symbol_members", lambda g: lookup.details(g, g.symbols.filter(_METHODS))["methods"], f"SELECT s.id, m.id AS member, m.name, m.kind, m.parent, m.signature, m.start_line FROM symbols s JOIN symbols m ON m.file_id = s.file_id AND m.parent = coalesce(s.parent, s.name) WHERE s.{_METHODS} AND m.kind IN ('method', 'field')")
_star("symbol_dependencies", lambda g: lookup.details(g, g.symbols.filter(_METHODS))["dependencies"], f"SELECT s.id, path, imported_symbol FROM symbols s JOIN deps ON source = file_id JOIN (SELECT id AS fid, path FROM files) ON fid = target WHERE s.{_METHODS}")
_star("file_by_path", lambda g: g.files.join(g.files.filter(F.col("id") % 50 == 1).select("path"), "path", "left_semi").select("id", "path", "size"), "SELECT id, path, size FROM files WHERE id % 50 = 1")
_star("parent_and_name", lambda g: lookup.symbols_where(g, 200, parent=[f"Nation{n}" for n in range(25)], name=[f"BuildingUser{k}" for k in range(2000)]), "SELECT id, name, kind, parent, start_line FROM symbols WHERE parent IS NOT NULL AND regexp_full_match(name, 'BuildingUser[0-9]+') AND CAST(name[13:] AS INT) < 2000 ORDER BY start_line, id LIMIT 200")
_star("impact_count", lambda g: g.files.filter(F.col("id") == START).select("id", F.lit(lookup.reachable_counts(g, START, 3)[1]).cast("long").alias("reachable")), f"SELECT CAST({START} AS BIGINT) AS id, count(*) FILTER (distance > 0) AS reachable FROM seen", f"{STAR}, {_BFS}", True)
_star("impact_deep", lambda g: lookup.reachable(g, START, 12).groupBy("distance").agg(F.count(F.lit(1)).alias("n")), "SELECT distance, count(*) AS n FROM seen WHERE distance > 0 GROUP BY distance", f"{STAR}, {_BFS.replace('< 3', '< 12')}", True)
_star("word_tokens", lambda g: g.symbols.select("id", F.concat_ws(" ", T.name_words(F.col("name"))).alias("words")), f"SELECT id, array_to_string({_NW}, ' ') AS words FROM symbols")
_star("token_match", lambda g: g.symbols.select("id", *(T.match_level(T.name_words(F.col("name")), k).alias(k) for k in KEYWORDS)), "SELECT id, " + ", ".join(f"{_level(_NW, k)} AS \"{k}\"" for k in KEYWORDS) + " FROM symbols")
_star("doc_freq", lambda g: context.document_frequency(g, KEYWORDS), f"SELECT keyword, df FROM ({_DF}) WHERE df > 0")
_star("idf_weights", lambda g: context.document_frequency(g, KEYWORDS).select("keyword", F.round(F.least(F.lit(1.0), F.lit(8.0) / F.greatest("df", F.lit(1))), 6).alias("weight")), f"SELECT keyword, round(least(1.0::DOUBLE, 8.0::DOUBLE / greatest(df, 1)), 6) AS weight FROM ({_DF}) WHERE df > 0")
_ranked("symbol_scores", lambda g, w: _r(context.symbol_scores(g, w).select("id", "score"), "score"), "SELECT id, round(score, 6) AS score FROM scored")
_ranked("top_symbols", lambda g, w: context.symbol_scores(g, w).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "path", "id").limit(30).select("id", "name", "score"), "SELECT id, name, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, path, id LIMIT 30")
_ranked("candidate_files", lambda g, w: _r(context.candidates(g, KEYWORDS), "score").select("file_id", "path", "score"), "SELECT file_id, path, round(sum(score), 6) AS score FROM (SELECT file_id, path, " + re.sub(r"w\d+ \*", "1.0::DOUBLE *", _SCORE) + f" AS score FROM (SELECT s.file_id, f.path, {_words('s.name')} AS nw, {_words('s.signature')} AS sw, {_words('f.path')} AS pw FROM symbols s JOIN files f ON f.id = s.file_id)) WHERE score > 0 GROUP BY file_id, path")
_ranked("file_scores", lambda g, w: _r(context.file_scores(g, w), "score"), "SELECT file_id, path, round(score, 6) AS score FROM rated")
_ranked("dep_follow", lambda g, w: _r(context.follow(g, context.file_scores(g, w)), "score"), "SELECT t.file_id, round(2.0 + 0.1::DOUBLE * parent + coalesce(0.25 * ln(n + 1), 0), 6) AS score FROM (SELECT target AS file_id, max(score) AS parent FROM deps JOIN roots ON source = root WHERE target IN (SELECT id FROM files) GROUP BY target) t LEFT JOIN degree d ON d.file_id = t.file_id")
_ranked("dependent_follow", lambda g, w: _r(context.follow(g, context.file_scores(g, w), True), "score"), "SELECT t.file_id, round(2.0 + 0.1::DOUBLE * parent + coalesce(0.25 * ln(n + 1), 0), 6) AS score FROM (SELECT source AS file_id, max(score) AS parent FROM deps JOIN roots ON target = root JOIN degree h ON h.file_id = target LEFT JOIN degree o ON o.file_id = source WHERE h.n <= 40 OR o.n >= 2 GROUP BY source) t LEFT JOIN degree d ON d.file_id = t.file_id")
_add("tokenize", lambda s, d: bindings.texts(s, d).select("id", F.concat_ws(" ", T.task_words(F.col("text"))).alias("words")), f"WITH {TEXTS}, t AS (SELECT id, {_tokens('text')} AS x FROM texts) SELECT id, array_to_string(list_filter(x, lambda w, i: i = 1 OR w <> x[i - 1]), ' ') AS words FROM t")
_add("token_estimate", lambda s, d: bindings.texts(s, d).select("id", T.token_estimate(F.col("text")).alias("tokens")), f"WITH {TEXTS} SELECT id, greatest(1, size // 4) AS tokens FROM texts")
_add("content_hash", lambda s, d: bindings.texts(s, d).select("path", "hash", "size"), f"WITH {TEXTS} SELECT path, hash, CAST(size AS BIGINT) AS size FROM texts")
_STATE = "SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS state FROM old o FULL JOIN new n ON o.path = n.path"
_add("incremental_classify", lambda s, d: index.classify(*bindings.snapshots(s, d)), f"WITH {SNAPS} {_STATE}")
_add("doctor_freshness", lambda s, d: index.classify(*bindings.snapshots(s, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n")), f"WITH {SNAPS} SELECT state, count(*) AS n FROM ({_STATE}) GROUP BY state")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    old, new = bindings.snapshots(s, d)
    return old.join(new, "path", "left_anti").select("path")



def _diff(s: SparkSession, d: str) -> DataFrame:
    old, new = bindings.snapshots(s, d)
    sign = lambda x: x.select(F.col("path").alias("name"), F.col("hash").alias("signature"), F.lit(1).alias("place"))
    return index.diff_symbols(sign(old), sign(new))


_DIFF = "SELECT n.path AS name, CASE WHEN o.path IS NULL THEN 'Added' ELSE 'Modified' END AS status, n.hash AS signature FROM new n LEFT JOIN old o ON o.path = n.path WHERE o.path IS NULL OR o.hash <> n.hash UNION ALL SELECT path, 'Removed', NULL FROM old WHERE path NOT IN (SELECT path FROM new)"
_add("deleted_files", _deleted, f"WITH {SNAPS} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
_add("symbol_diff", _diff, f"WITH {SNAPS} {_DIFF}")
_add("diff_status_counts", lambda s, d: _diff(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"WITH {SNAPS} SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY status")
_add("link_classify", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("spec")).select("page_id", "spec", F.when(F.col("spec").startswith("./") | F.col("spec").startswith("../"), "relative").when(F.col("spec").startswith("/"), "root").otherwise("external").alias("kind")), "SELECT page_id, spec, CASE WHEN starts_with(spec, './') OR starts_with(spec, '../') THEN 'relative' WHEN starts_with(spec, '/') THEN 'root' ELSE 'external' END AS kind FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS spec FROM pages)")


_PRE = f"""{STAR}, own AS (SELECT id, path, language, regexp_replace(path, '[.][a-z]+$', '') AS stem FROM files),
pairs AS (SELECT DISTINCT source, target FROM deps WHERE target IS NOT NULL),
imported AS (SELECT id, count(*) AS n, string_agg(line, '' ORDER BY line) AS imports FROM (SELECT DISTINCT s.id, {bindings.import_line()} AS line FROM pairs JOIN (SELECT id, path, language FROM own) s ON s.id = source JOIN (SELECT id AS tid, stem FROM own) t ON tid = target) GROUP BY id),
bodies AS (SELECT id, string_agg(body, '' ORDER BY name) AS bodies FROM (SELECT o.id, s.name, {bindings.function_text(True)} AS body FROM (SELECT file_id, name FROM symbols) s JOIN own o ON o.id = s.file_id) GROUP BY id)"""


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return parse_sources(bindings.sources(s, d)[1])


def _resolved(s: SparkSession, d: str) -> DataFrame:
    g, sources = bindings.sources(s, d)
    edges = parse_sources(sources).select("path", F.posexplode("imports").alias("n", "i")).select("path", "n", "i.*")
    return resolution.resolve(edges, g.files).select("path", "target_path", "resolution", F.col("imported_symbol").isNotNull().alias("named"), "type")


_add("parse_symbols", lambda s, d: _parsed(s, d).select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.exported", "s.start_line"),
     f"WITH {_PRE} SELECT path, name, 'function' AS kind, language <> 'javascript' AS exported, coalesce(n, 0) + CASE language WHEN 'go' THEN 1 ELSE 0 END + 3 * row_number() OVER (PARTITION BY own.id ORDER BY name) - 2 AS start_line FROM own JOIN (SELECT file_id, name FROM symbols) s ON own.id = s.file_id LEFT JOIN imported l ON l.id = own.id")
_add("parse_skeletons", lambda s, d: _parsed(s, d).select("path", "skeleton", "has_errors"),
     f"WITH {_PRE} SELECT path, CASE language WHEN 'go' THEN 'package p' || chr(10) ELSE '' END || coalesce(imports, '') || coalesce(bodies, '') AS skeleton, false AS has_errors FROM own LEFT JOIN imported l ON l.id = own.id LEFT JOIN bodies b ON b.id = own.id")
_add("import_resolution", _resolved,
     f"WITH {_PRE} SELECT s.path, CASE WHEN s.language <> 'rust' OR t.language = 'rust' THEN t.path END AS target_path, CASE WHEN s.language <> 'rust' OR t.language = 'rust' THEN 'internal' ELSE 'unresolved' END AS resolution, s.language IN ('typescript', 'rust') AS named, CASE WHEN s.language = 'rust' THEN 'use' ELSE 'import' END AS type FROM pairs JOIN own s ON s.id = source JOIN own t ON t.id = target")


def _target_sql(t: str) -> str:
    return f"SELECT path, id, symbol FROM (SELECT 1 AS way, false AS test, 0 AS place, path, id, NULL AS symbol FROM (SELECT * FROM files WHERE path ILIKE '%{t}%' ORDER BY path LIMIT 10) WHERE contains(path, '{t}') UNION ALL SELECT 2, {_TEST}, start_line, path, file_id, name FROM (SELECT * FROM symbols WHERE name = '{t}' ORDER BY start_line, id LIMIT 10) JOIN (SELECT id AS fid, path FROM files) ON fid = file_id) ORDER BY way, test, place, path LIMIT 1"


_star("resolve_target_path", lambda g: lookup.resolve_target(g, "models/"), _target_sql("models/"))
_star("resolve_target_symbol", lambda g: lookup.resolve_target(g, "MachineryUser84"), _target_sql("MachineryUser84"))
_star("resolve_file", lambda g: lookup.resolve_file(g, "core/"), "SELECT path, id FROM (SELECT * FROM files WHERE path ILIKE '%core/%' ORDER BY path LIMIT 20) WHERE contains(path, 'core/') ORDER BY path LIMIT 1")
_star("resolve_symbol", lambda g: lookup.resolve_symbol(g, "MachineryUser84"), "SELECT s.id, file_id, name, kind, parent, signature, start_line, path FROM (SELECT * FROM symbols WHERE name = 'MachineryUser84' ORDER BY start_line, id LIMIT 200) s JOIN files f ON f.id = file_id")
_star("diff_impact", lambda g: lookup.diff_impact(g, g.files.filter(F.col("id") == HUB)), f"SELECT DISTINCT path FROM deps JOIN files ON id = source WHERE target = {HUB} ORDER BY path LIMIT 20")
_HOPS = " UNION ALL ".join(f"SELECT file_id, score, 1 AS follow FROM ({_ORACLE[n].split(_ALL, 1)[1]})" for n in ("dep_follow", "dependent_follow"))
_RANKED = f"ranked AS (SELECT file_id, path, score, follow = 1 AS follow_only FROM (SELECT file_id, max(score) AS score, min(follow) AS follow FROM (SELECT file_id, round(score, 6) AS score, 0 AS follow FROM rated UNION ALL {_HOPS}) GROUP BY file_id) JOIN (SELECT id, path FROM files) ON id = file_id)"
_ranked("context_files", lambda g, w: _r(package.ranked(g, w), "score"), f", {_RANKED} SELECT * FROM ranked")
_ranked("context_capped", lambda g, w: package.capped(_r(package.ranked(g, w), "score")), f", {_RANKED} SELECT * FROM ranked WHERE NOT follow_only UNION ALL SELECT * FROM (SELECT * FROM ranked WHERE follow_only ORDER BY score DESC, path LIMIT 6)")


_LATE, _EDITED = "file_id % 7 = 2", "file_id % 10 = 3"
_LIVE = f"""live AS (SELECT file_id, path, score + CASE WHEN {_LATE} THEN 2.0 ELSE 0.0 END + CASE WHEN {_EDITED} THEN 1.5 ELSE 0.0 END AS score FROM rated),
start AS (SELECT file_id AS root, score FROM live WHERE score >= 3.0),
hops AS (SELECT target AS file_id, score, 1 AS way FROM deps JOIN start ON source = root WHERE target IN (SELECT id FROM files)
  UNION ALL SELECT source, score, 2 FROM deps JOIN start ON target = root JOIN degree h ON h.file_id = target LEFT JOIN degree o ON o.file_id = source WHERE h.n <= 40 OR o.n >= 2),
hopped AS (SELECT file_id, way, round(2.0 + 0.1::DOUBLE * max(score) + CASE WHEN {_LATE} THEN 2.0 ELSE 0.0 END + coalesce(max(0.25 * ln(n + 1)), 0), 6) AS score FROM hops LEFT JOIN degree USING (file_id) GROUP BY file_id, way),
worked AS (SELECT file_id, path, score, way > 0 AS follow_only FROM (SELECT file_id, max(score) AS score, min(way) AS way FROM (SELECT file_id, round(score, 6) AS score, 0 AS way FROM live UNION ALL SELECT file_id, score, way FROM hopped) GROUP BY file_id) JOIN (SELECT id, path FROM files) ON id = file_id)"""


def _working(g: bindings.Graph, w: dict) -> DataFrame:
    """Ranked files while some are changed and some were written after the index."""
    some = lambda rule: g.files.withColumnRenamed("id", "file_id").filter(rule).select("path")
    return _r(package.ranked(g, w, some(_EDITED), some(_LATE)), "score")


def _filled(g: bindings.Graph, w: dict) -> DataFrame:
    rows = package.capped(_working(g, w)).join(g.files.select("path", (F.col("size") * 100).alias("tokens")), "path").select("path", "score", "tokens")
    return g.files.sparkSession.createDataFrame([tuple(r) for r in package.filled(rows)[0]], "path string, score double, tokens long")


def _best(g: bindings.Graph, w: dict) -> list[str]:
    return [r.path for r in _r(context.file_scores(g, w), "score").orderBy(F.desc("score"), "path").limit(25).collect()]


_BEST = "chosen AS (SELECT file_id, path, row_number() OVER (ORDER BY round(score, 6) DESC, path) AS place FROM rated QUALIFY place <= 25)"
_ranked("context_working_tree", _working, f", {_LIVE} SELECT * FROM worked")
_ranked("context_filled", _filled, f""", {_LIVE}, most AS (SELECT * FROM worked WHERE NOT follow_only UNION ALL SELECT * FROM (SELECT * FROM worked WHERE follow_only ORDER BY score DESC, path LIMIT 6)),
line AS (SELECT path, score, tokens, row_number() OVER (ORDER BY score DESC, path) AS place FROM most JOIN (SELECT id, size * 100 AS tokens FROM files) ON id = file_id),
fill(place, rest, n, taken) AS (SELECT CAST(0 AS BIGINT), CAST(12000 AS BIGINT), 0, false UNION ALL SELECT l.place, CASE WHEN tokens <= rest THEN rest - tokens ELSE rest END, n + CASE WHEN tokens <= rest OR n = 0 THEN 1 ELSE 0 END, tokens <= rest OR n = 0
  FROM fill f JOIN line l ON l.place = f.place + 1 WHERE n < 25 AND (n = 0 OR rest >= 1))
SELECT path, score, CAST(tokens AS BIGINT) AS tokens FROM line JOIN fill USING (place) WHERE taken""", True)
_ranked("context_tree", lambda g, w: g.files.sparkSession.createDataFrame(list(enumerate(package.architecture(_best(g, w)))), "place long, line string"),
        f", {_BEST}, folders AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS f FROM chosen), tree AS (SELECT repeat('  ', len(f) - len(replace(f, '/', ''))) || regexp_replace(f, '^.*/', '') || '/' AS line FROM folders) SELECT row_number() OVER (ORDER BY line) - 1 AS place, line FROM tree UNION ALL SELECT count(*), '...' FROM tree")
_ranked("context_dependencies", lambda g, w: g.files.sparkSession.createDataFrame(list(enumerate(package.package_dependencies(g, _best(g, w)))), "place long, name string"),
        f", {_BEST}, named AS (SELECT t.path AS name, min(place) AS first FROM chosen JOIN deps ON source = file_id JOIN files t ON t.id = target GROUP BY t.path) SELECT row_number() OVER (ORDER BY first, name) - 1 AS place, name FROM named QUALIFY place < 12")


def _listing(s: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("path", F.lit("python").alias("language"), "size", mtime.cast("long").alias("mtime")) for x, mtime in zip(bindings.snapshots(s, d), (F.lit(1), F.when(F.col("id") % 11 == 0, 2).otherwise(1))))
    return indexing.states(new, old, 2000).select("path", "size", "state")


_add("index_states", _listing, f"WITH {SNAPS} SELECT coalesce(o.path, n.path) AS path, CAST(n.size2 AS BIGINT) AS size, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN CASE WHEN n.size2 > 2000 THEN 'skipped' ELSE 'new' END WHEN n.size2 = o.size AND n.id % 11 <> 0 THEN 'same' ELSE 'check' END AS state FROM old o FULL JOIN (SELECT id, path, octet_length(encode(text)) AS size2 FROM new) n ON o.path = n.path")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
