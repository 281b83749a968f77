"""The queries of the ten operators and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm.bpe import op7_byte_bpe
from lamina.llm.contamination import op6_benchmark_decontamination
from lamina.llm.language import op10_language_id
from lamina.llm.lines import op5_line_dedup
from lamina.llm.pii import op9_personal_data
from lamina.llm.quality import op2_quality_classifier
from lamina.llm.repeats import op8_suffix_dedup
from lamina.llm.secrets import op3_secret_scan
from lamina.llm.simhash import op4_simhash_near_dedup
from lamina.llm.vectors import op1_embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_quality_classifier,
        op3_secret_scan,
        op4_simhash_near_dedup,
        op5_line_dedup,
        op6_benchmark_decontamination,
        op7_byte_bpe,
        op8_suffix_dedup,
        op9_personal_data,
        op10_language_id,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: What parts words in benchmark decontamination.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE good AS MATERIALIZED (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a AS x, b AS r FROM links UNION SELECT x, b FROM reach JOIN links ON r = a),
found AS (SELECT x, least(x, min(r)) AS c FROM reach GROUP BY x),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept
FROM embeddings LEFT JOIN counts ON vec_id = a LEFT JOIN found ON vec_id = x""",
    "op5_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS k FROM parts),
keyed AS (SELECT doc_id, k, line, translate(trim(line, {BLANK}), '{UPPER}', '{LOWER}') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT d.doc_id, d.k, d.line, s.key IS NOT NULL AND s.last <> d.doc_id AS gone FROM keyed d LEFT JOIN shared s ON d.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    # windows as whole strings; near ones by every place at which a word of an item stands in a document
    "op6_benchmark_decontamination": f"""
WITH split AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PARTS}'), lambda x: x <> '') AS w FROM documents),
items AS MATERIALIZED (
  SELECT DISTINCT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PARTS}'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
known AS MATERIALIZED (SELECT row_number() OVER () AS no, item, w, len(w) AS n, least(len(w), 13) AS size FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[s + 1:s + size], ' ') AS key FROM (SELECT *, unnest(range(n - size + 1)) AS s FROM known)),
places AS (SELECT doc_id, s, size, array_to_string(w[s + 1:s + size], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(greatest(len(w) - size + 1, 0))) AS s FROM split, (SELECT DISTINCT size FROM windows))),
found AS MATERIALIZED (SELECT doc_id, s, size, item FROM places JOIN windows USING (size, key)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id),
whole AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id),
spots AS (SELECT no, unnest(w) AS word, unnest(range(n)) AS p FROM known),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split),
aligned AS (SELECT doc_id, no, list(p) AS ps FROM words JOIN spots USING (word) GROUP BY doc_id, no, pos - p),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM aligned JOIN known USING (no)
  WHERE len(ps) >= least(size, 10) AND len(list_filter(range(n - size + 1), lambda s: len(list_filter(ps, lambda p: p >= s AND p < s + size)) >= least(size, 10))) > 0 GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM split LEFT JOIN hits USING (doc_id) LEFT JOIN whole USING (doc_id) LEFT JOIN near USING (doc_id)""",
    # strings are cut from pieces of 299 bytes, as substr takes time in proportion to what it cuts from
    "op8_suffix_dedup": """
WITH texts AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, h, n, unnest(range((n + 100) // 200)) AS j FROM texts WHERE n >= 100),
pieces AS MATERIALIZED (SELECT doc_id, n, j, substr(h, 400 * j + 1, 598) AS piece FROM blocks),
starts AS (SELECT doc_id, j, piece, unnest(range(least(200, n - 99 - 200 * j))) AS o FROM pieces),
strings AS (SELECT doc_id, 200 * j + o AS k, row_number() OVER (PARTITION BY md5_number(substr(piece, 2 * o + 1, 200)) ORDER BY doc_id, j, o) > 1 AS again FROM starts),
repeated AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prior FROM strings WHERE again),
runs AS (SELECT doc_id, k, sum(CASE WHEN prior IS NULL OR k > prior + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM repeated),
spans AS (SELECT doc_id, run, min(k) AS a, max(k) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, b, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS next FROM spans),
rest AS (SELECT doc_id, b, next FROM gaps UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (next - b)), '' ORDER BY b) AS h FROM rest JOIN texts USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN sums USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
}
