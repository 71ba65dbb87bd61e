"""DuckDB SQL of the registered queries that SQL can express.

The other queries need a tokenizer, iterated scores, or escaped templates;
tests compare them with brute force.
"""

_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_W} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  len(ln) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs,
  length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper
  FROM l LEFT JOIN cov ON l.r = cov.r),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_bangs > 3 * n_words THEN 8 ELSE 0 END
  + CASE WHEN n_words > 0 AND 10 * n_upper > 6 * word_chars THEN 16 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END
  + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 64 ELSE 0 END AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  (failed_bits & 31) = 0 AS kept, failed_bits FROM f"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
-- a word is covered if a repeated window starts at most 34 words before it
x AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT x.*, max(rep.i) OVER (PARTITION BY x.r ORDER BY x.i) AS last FROM x LEFT JOIN rep ON x.r = rep.r AND x.i = rep.i),
k AS (SELECT r, count(*) FILTER (i - last <= 34) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i - last > 34) AS kept
  FROM y GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r"""

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
walk AS (SELECT vec_id AS a, vec_id AS z FROM v UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.z = link.a),
comp AS (SELECT a, min(z) AS c FROM walk GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id,
  e.vec_id = coalesce(comp.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN comp ON e.vec_id = comp.a"""

_T = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_T} AS t FROM documents),
has AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM has),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM has) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term, docs),
q AS (SELECT row_number() OVER () AS i, item_id, {_T} AS t FROM benchmark),
qt AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT i, item_id, unnest(t) AS term FROM q) GROUP BY i, item_id, term),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN has USING (r), size GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS p FROM s WHERE score > 0)
SELECT item_id, CAST(p AS INTEGER) AS rank, doc_id, score FROM k WHERE p <= 10"""

ORACLES: dict[str, str] = {"op7_substrings": OP7, "op9_quality": OP9, "op10_vectors": OP10, "op11_search": OP11}
