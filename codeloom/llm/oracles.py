"""DuckDB SQL of the queries whose whole results SQL can express, over the same tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Water-filling in closed form: sources in order of size for weight reach their cap first.
MIXING = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, ('0x' || substr(md5(concat_ws('|', '17', doc_id, text)), 1, 15))::BIGINT AS draw FROM documents
), s AS (
  SELECT source, s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source)
), o AS (
  SELECT *, (sum(s) OVER () - coalesce(3 * sum(s) OVER before, 0))::BIGINT AS lft, (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS heavy
  FROM s WINDOW before AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT lft, heavy FROM o WHERE w * lft <= 3 * s * heavy ORDER BY s::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, s, w, f.lft, f.heavy, 3 * s * f.heavy < w * f.lft OR s = 0 AS clamped, w * f.lft // f.heavy AS flr, w * f.lft % f.heavy AS ovr FROM s, f
), u AS (
  SELECT source, s, CASE WHEN clamped THEN (3 * s)::DOUBLE ELSE (w * lft)::DOUBLE / heavy::DOUBLE END AS target,
    CASE WHEN clamped THEN 3 ELSE w * lft // (heavy * s) END AS whole,
    CASE WHEN clamped THEN 0 ELSE flr + CASE WHEN 2 * ovr > heavy OR (2 * ovr = heavy AND flr % 2 = 1) THEN 1 ELSE 0 END - (w * lft // (heavy * s)) * s END AS rest
  FROM t
)
SELECT doc_id, size, s AS source_size, target,
  (whole * size + least(size, greatest(0, rest - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
"""

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

# Bytes as pairs of hexadecimal digits.
SUFFIX = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1 AS again FROM (SELECT doc_id, k, substr(h, 2 * k + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS k FROM h))),
b AS (SELECT h.doc_id, k, substr(h, 2 * k + 1, 2) AS x FROM h, unnest(range(0, n)) AS t(k)),
c AS (SELECT b.doc_id, b.k, x, coalesce(max(CASE WHEN again THEN b.k END) OVER (PARTITION BY b.doc_id ORDER BY b.k), -100) > b.k - 100 AS gone FROM b LEFT JOIN w USING (doc_id, k)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS starts FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY k) FILTER (NOT gone), ''))) AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, h.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(kept, sha256('')) AS kept_sha256 FROM h LEFT JOIN a USING (doc_id)
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
k AS (SELECT doc_id, k, count(*) OVER (PARTITION BY array_to_string(w[k : k + 34], ' ')) > 1 AS again FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM w)),
p AS (SELECT doc_id, k, w[k] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w)),
c AS (SELECT p.doc_id, p.k, x, coalesce(max(CASE WHEN again THEN p.k END) OVER (PARTITION BY p.doc_id ORDER BY p.k), -99) > p.k - 35 AS gone FROM p LEFT JOIN k USING (doc_id, k)),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY k) FILTER (NOT gone), '')) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)
"""

SQL = {"op4_topk_search": TOPK, "op7_mixing": MIXING, "op8_near_dedup": NEAR, "op9_suffix_dedup": SUFFIX, "op10_substring_dedup": SUBSTRING}
