"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER

_WORDS = f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
_PLAIN = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

_OP9 = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
d AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, d.n, item_id FROM d JOIN b ON d.n = b.n AND d.win = b.win),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_OP8 = f"""WITH dw AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - 34)) AS i FROM dw WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM x) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM r), g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM dw),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS kept, count(*) AS n_kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.j = p.j WHERE c.j IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM dw LEFT JOIN k USING (doc_id)"""

_OP11 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
g AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM g JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_OP12 = rf"""WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
pw AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pc), nn AS (SELECT lang, sum(len(w)) AS n FROM pw GROUP BY 1),
g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM pw, (VALUES (1), (2), (3)) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 10), c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
x AS (SELECT c.lang, c.m, c.phrase, c.c AS a, k, array_to_string(list_slice(w, 1, k), ' ') AS p1, array_to_string(list_slice(w, k + 1, c.m), ' ') AS p2 FROM c, (VALUES (1), (2)) t(k) WHERE k < c.m),
s AS (SELECT x.lang, x.m, x.phrase, a, k, l.c AS l, r.c AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.c AS HUGEINT) * r.c) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = p1 JOIN f r ON r.lang = x.lang AND r.phrase = p2
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, k) = 1),
d AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, c AS a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY 1, 2),
z AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank FROM s LEFT JOIN d ON d.lang = s.lang AND d.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN nn USING (lang) WHERE rank <= 2000"""

_OP13 = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
c AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT p.b, c.low FROM c JOIN p ON p.a = c.node WHERE c.low < p.b),
m AS (SELECT node, min(low) AS component_id FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op8_substring_dedup": _OP8, "op9_decontaminate": _OP9, "op11_hard_negatives": _OP11, "op12_collocations": _OP12, "op13_near_vectors": _OP13}
