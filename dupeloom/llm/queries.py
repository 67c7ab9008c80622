"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bytebpe import encode_documents
from .common import documents
from .htmlmain import extract_main_text
from .langid import identify_languages
from .licenses import find_licenses, signature_rules
from .lm import score_documents
from .minhash import near_duplicates
from .packing import pack_documents
from .secretscan import secret_report
from .topk import exact_top_k


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(documents(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(documents(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(documents(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_ALL = (op1_minhash_near_dedup, op2_secret_scan, op3_best_fit_packing, op4_license_scan, op5_main_text, op6_exact_top_k, op7_nearest_neighbours, op8_language_id, op9_lm_scoring, op10_byte_bpe)
QUERIES = {f.__name__: f for f in _ALL}

#: floor(256 * x) in doubles, and all pairs of a stated query set against all rows.
_TOP_K = """
WITH fine AS (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

#: All pairs that share a shingle, and what links reach.
_NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sh AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.least AS component_id, d.doc_id = c.least AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) c USING (doc_id)
"""

#: Matches by kind, their places by running lengths, links by all pairs of parts that lie apart.
_SECRETS = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM documents
),
cuts AS (
    SELECT r, 'assign' AS kind, 0 AS rank, regexp_extract_all(l, pattern) AS f, regexp_split_to_array(l, pattern) AS b, regexp_extract_all(l, pattern, 2) AS v
    FROM d, (SELECT '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)' AS pattern)
    UNION ALL
    SELECT r, kind, rank, regexp_extract_all(t, pattern), regexp_split_to_array(t, pattern), regexp_extract_all(t, pattern)
    FROM d, (VALUES
        ('access', 1, 'AKIA[A-Z0-9]+'),
        ('hex', 2, '[0-9a-f]+'),
        ('id', 3, '\b(?:(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{8,}|(?i:(?:client|access|account|user|login)[_-]?(?:id|key|name)?["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{4,}))'),
        ('key', 4, '[A-Za-z0-9+/_=-]+'),
        ('endpoint', 5, '\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x20\x09-\x0D"''<>]+')
    ) AS k(kind, rank, pattern)
),
matches AS (SELECT r, kind, rank, unnest(f) AS f, unnest(b[1 : len(f)]) AS b, unnest(v) AS v, unnest(range(len(f))) AS i FROM cuts WHERE len(f) > 0),
spans AS (
    SELECT r, kind, rank, f, v, (sum(length(b) + length(f)) OVER (PARTITION BY r, kind ORDER BY i) - length(f))::BIGINT AS s, sum(length(b) + length(f)) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS e
    FROM matches
),
parts AS (
    SELECT r, kind, rank, s, e, floor(s / 200)::BIGINT - 1 AS low, floor((e - 1) / 200)::BIGINT AS high FROM spans
    WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'access' THEN length(f) >= 20 WHEN 'hex' THEN length(f) >= 24
        WHEN 'key' THEN length(f) >= 20 AND regexp_matches(f, '[0-9]') AND regexp_matches(f, '[A-Z]') AND regexp_matches(f, '[a-z]') ELSE TRUE END
),
linked AS (
    SELECT DISTINCT i.r, unnest(range(greatest(i.low, k.low), least(i.high, k.high) + 1)) AS scope
    FROM parts i JOIN parts k ON i.r = k.r AND i.kind IN ('id', 'access') AND k.kind IN ('assign', 'hex', 'key') AND (i.e <= k.s OR k.e <= i.s)
    WHERE greatest(i.low, k.low) <= least(i.high, k.high)
),
shown AS (SELECT * FROM parts p WHERE rank < 3 OR EXISTS (SELECT 1 FROM linked l WHERE l.r = p.r AND l.scope BETWEEN p.low AND p.high)),
kept AS (
    SELECT * FROM shown w
    WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM shown o WHERE o.r = w.r AND o.s <= w.s AND o.e >= w.e AND (o.s < w.s OR o.e > w.e OR o.rank < w.rank))
),
joined AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) FILTER (rank >= 3) AS n_linked
    FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN joined USING (r)
"""

#: Phrases by their places among the words; rules as a table, all against all texts, and all pairs of what they find.
_LICENSES = (
    r"""
WITH rules(place, label, pattern, priority) AS (VALUES """
    + ", ".join(f"({i}, '{r.label}', '{r.pattern}', {r.priority})" for i, r in enumerate(signature_rules()))
    + r"""),
d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
        regexp_replace(translate(replace(coalesce(text, ''), '©', '(c)'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x21-\x7E]+', ' ', 'g') AS t
    FROM documents
),
phrases(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
places AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
hits AS (SELECT r, i, label FROM places, phrases WHERE w[i + 1 : i + len(phrase)] = phrase),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY r),
cuts AS (SELECT r, place, label, priority, regexp_extract_all(t, pattern) AS f, regexp_split_to_array(t, pattern) AS b FROM d, rules WHERE regexp_matches(t, pattern)),
matches AS (SELECT r, place, label, priority, unnest(f) AS f, unnest(b[1 : len(f)]) AS b, unnest(range(len(f))) AS k FROM cuts),
found AS (
    SELECT r, place, label, priority, sum(length(b) + length(f)) OVER own - length(f) AS s, sum(length(b) + length(f)) OVER own AS e FROM matches WINDOW own AS (PARTITION BY r, place ORDER BY k)
),
kept AS (
    SELECT * FROM found x
    WHERE NOT EXISTS (
        SELECT 1 FROM found o WHERE o.r = x.r AND o.s <= x.s AND o.e >= x.e
            AND (o.priority > x.priority OR o.priority = x.priority AND (o.s < x.s OR o.e > x.e OR o.place < x.place))
    )
),
best AS (SELECT r, max(priority) AS priority FROM kept GROUP BY r),
labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION SELECT r, label FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    greatest(coalesce(priority, 0) / 100.0::DOUBLE, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN labels USING (r)
"""
)

ORACLE_SQL: dict[str, str] = {"op1_minhash_near_dedup": _NEAR_DEDUP, "op2_secret_scan": _SECRETS, "op4_license_scan": _LICENSES, "op6_exact_top_k": _TOP_K}
