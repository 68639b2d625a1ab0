"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaloom.session import table

from . import alignment, chat, decontam, exact_dedup, filter_audit, langid, licenses, line_rules, near_dup, packing, pii, token_store, warc
from .tokens import public_path


#: The key of the example query; a deployment passes its own.
EXAMPLE_KEY = b"lexaloom example key"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize_documents(table(spark, sf_dir, "documents", spread=True), EXAMPLE_KEY)


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", spread=True))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digests(table(spark, sf_dir, "documents", spread=True), public_path(), end_id=2)


def op6_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", spread=True))


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", spread=True), public_path(), end_id=0, capacity=2048)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents", spread=True))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", spread=True))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op12_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_align(table(spark, sf_dir, "documents", spread=True), public_path(), public_path("piece_bpe_32k.model"))


def op13_recursive_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms, op2_bbit_minhash, op3_snapshot_collapse, op4_suffix_automaton, op5_token_store, op6_output_codes, op7_license_join, op8_genetic_packing,
        op9_exact_dedup, op10_warc_segments, op11_line_rules, op12_diagonal_alignment, op13_recursive_audit,
    )
}

_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(licenses.TEMPLATES))
LICENSE_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM doc
), word AS (
  SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE contains(t, 'license')
), base AS (
  SELECT r, i - 1 AS place, CASE WHEN ws[i] = 'mit' AND ws[i + 1] = 'license' THEN 'mit' WHEN ws[i] = 'apache' AND ws[i + 1] = 'license' THEN 'apache'
    WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl' END AS label FROM word
), base_by AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM base WHERE label IS NOT NULL GROUP BY r
), template AS (
  SELECT label, len(string_split(words, ' ')) AS size, list_distinct(string_split(words, ' ')) AS tw FROM (VALUES {_TEMPLATE_ROWS}) v(k, label, words)
), block AS (
  SELECT r, size, list_distinct(ws[i:i + 2 * size - 1]) AS b FROM (SELECT r, ws, size, unnest(range(1, greatest(len(ws), 1) + 1, size)) AS i FROM w, (SELECT DISTINCT size FROM template))
), hit AS (
  SELECT r, label, len(list_intersect(tw, b)) / len(tw) AS c FROM block JOIN template USING (size)
  WHERE len(list_intersect(tw, b)) >= ceil({licenses.THRESHOLD} * len(tw))
), label_by AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM hit UNION ALL SELECT r, label FROM base WHERE label IS NOT NULL) GROUP BY r
), best AS (SELECT r, max(c) AS c FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base_by USING (r) LEFT JOIN label_by USING (r) LEFT JOIN best USING (r)
"""

LINE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{line_rules.SPACE}+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, unnest(range(i, i + 5)) AS k FROM g SEMI JOIN (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1) m ON g.r = m.r AND g.g = m.g),
repeats AS (SELECT r, count(DISTINCT k) AS n FROM rep GROUP BY r),
line AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
own AS (SELECT r, count(*) AS n_lines, count(DISTINCT x) AS n_left FROM line GROUP BY r),
pass AS (
  SELECT r, x, length(regexp_replace(x, '{line_rules.SPACE}+', '', 'g')) AS chars FROM (SELECT DISTINCT r, x FROM line)
  WHERE NOT (length(x) < {line_rules.SHORT} AND (NOT regexp_matches(x, '{line_rules.SENTENCE_END.replace("'", "''")}')
      OR regexp_matches(x || ' ', '{line_rules.MENU}') OR regexp_matches(x, '{line_rules.FURNITURE}')))
    AND NOT (length(regexp_replace(x, '[^{line_rules.SEPARATORS}]', '', 'g')) >= 2
      AND 4 * length(regexp_replace(x, '[^{line_rules.SEPARATORS}]', '', 'g')) >= len(list_filter(regexp_split_to_array(x, '{line_rules.SPACE}+'), lambda y: y <> '')))
    AND NOT 10 * length(regexp_replace(x, '[^{line_rules.SYMBOLS}]', '', 'g')) > length(regexp_replace(x, '{line_rules.SPACE}', '', 'g'))
), kept AS (SELECT r, count(*) AS n, sum(chars) AS chars FROM pass GROUP BY r),
made AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{line_rules.SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{line_rules.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines - n_left, 0) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(kept.n, 0) AS n_lines_kept, CAST(coalesce(kept.chars, 0) AS BIGINT) AS kept_chars
  FROM w LEFT JOIN repeats USING (r) LEFT JOIN own USING (r) LEFT JOIN kept USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (word_chars - kept_chars) <= {line_rules.LOST_PERCENT} * word_chars AS kept
FROM made
"""

ORACLE_SQL = {
    "op11_line_rules": LINE_SQL,
    "op4_suffix_automaton": r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, len(w) AS n
  FROM (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, least(n, 10) AS size, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS words
  FROM (SELECT item, n, w, unnest(range(1, greatest(n - 10, 0) + 2)) AS i FROM item)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), gram AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM win))
), found AS (SELECT r, g.size, i, item FROM gram g JOIN win USING (size, words)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op3_snapshot_collapse": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
step AS (
  SELECT conv_id, turn, role, text,
    coalesce(length(role) || ';' || role, '-;') || coalesce(length(text) || ';' || text, '-;') AS part,
    row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), prefix AS (SELECT conv_id, k, n, sha256(string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY k)) AS h FROM step),
whole AS (SELECT h, min(conv_id) AS conv_id, max(n) AS n, count(*) AS n_copies FROM prefix WHERE k = n GROUP BY h),
kept AS (SELECT * FROM whole WHERE h NOT IN (SELECT h FROM prefix WHERE k < n))
SELECT conv_id, n AS n_turns, n_copies,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM kept JOIN step USING (conv_id, n) GROUP BY conv_id, n, n_copies
UNION ALL
SELECT conv_id, 1, 1, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) FROM conversations WHERE conv_id IS NULL
""",
    "op7_license_join": LICENSE_SQL,
    "op13_recursive_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (
  SELECT w.doc_id, part, [
    len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails,
    coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id
), c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM f GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS p FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT part, array_to_string(list_transform(p, lambda i: chr(CAST(64 + i AS INTEGER))), '') AS filter_order, k.k AS step, p[k.k] AS letter, n, good, bad,
    fails[p[k.k]] AS fail, list_bool_or(list_transform(p[:k.k - 1], lambda i: fails[i])) IS TRUE AS before, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM c, o, k
), m AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT before AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT before AND fail THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN before AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT before AND fail THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT before AND fail THEN bad ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM m
""",
    "op10_warc_segments": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
}
