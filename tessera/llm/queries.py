"""The registered queries of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import chat_format, decontaminate, html_extract, license_scan, near_dedup, packing, quality_lm, quality_rules, toxicity, url_filter
from tessera.llm.common import read


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(extra)))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score", "host_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_quality_classifier, op3_html_extraction, op4_minhash_near_dedup, op5_license_scans,
        op6_toxicity, op7_quality_rules, op8_best_fit_packing, op9_chat_formatting, op10_url_filters,
    )
}

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in quality_rules.STOP_FORMS)

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS n_stops
      FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars / n_words < 1.5 OR word_chars / n_words > 20 OR n_symbols / n_words > 0.3
            OR n_shouts / n_words > 0.3 OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR (n_words >= 100 AND n_stops / n_words < 0.01)) AS kept
FROM f
"""
#: Digests straight from the table: they hold if formatting and reading back lose nothing. A control string's escape is one sign more.
OP9_SQL = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) p(conv_id, turn, role, text)),
f AS (SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
_PHRASES = ", ".join(
    f"('{kind}', '{phrase}', {len(phrase.split())}, '{label}', {license_scan.FREEDOM.get(label, license_scan.UNKNOWN_SCORE)})"
    for kind, table in (("base", license_scan.BASE_PHRASES), ("notice", license_scan.NOTICE_PHRASES))
    for phrase, label in table.items()
)
#: Phrases by comparing words at every place. The expressions of identifier tags have no SQL here, so it holds for tables without such tags, as the given ones are.
OP5_SQL = f"""
WITH phrase(kind, phrase, size, label, freedom) AS (VALUES {_PHRASES}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
m AS (SELECT r, kind, label, freedom, unnest(list_filter(range(len(ws) - size + 1), lambda i: array_to_string(ws[i + 1:i + size], ' ') = phrase)) AS word
      FROM d JOIN phrase ON contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')),
f AS (SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(word) FILTER (kind = 'base') AS first_word, max(word) FILTER (kind = 'base') AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(freedom) AS score,
             list({{'word': word, 'label': label}} ORDER BY word, label) AS places FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(CAST(score AS DOUBLE), 0.0) AS score, coalesce(places, []) AS places
FROM d LEFT JOIN f ON f.r = d.r
"""
ORACLE_SQL: dict[str, str] = {"op5_license_scans": OP5_SQL, "op7_quality_rules": OP7_SQL, "op9_chat_formatting": OP9_SQL}
