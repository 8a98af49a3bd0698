"""Queries on normalization and its failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.operators import normalize as N
from khata.plans.common import Registry, sql_words, table

R = Registry()

_TOKENS = "SELECT * FROM failure_log WHERE token IS NOT NULL AND token <> ''"
_CLASS = f"""CASE WHEN length(token) = 1 AND regexp_matches(token, '^[{N.VOWEL_SIGNS}]$') THEN 'standalone_vowel_sign' WHEN length(token) = 1 AND regexp_matches(token, '^[{N.NASAL_MARKS}]$') THEN 'standalone_nasalization'
    WHEN length(token) = 1 AND regexp_matches(token, '^[{N.SYMBOLS}]$') THEN 'symbol' WHEN token = '{N.HALANT}' THEN 'standalone_halant' WHEN length(token) = 1 AND regexp_matches(token, '^\\p{{M}}$') THEN 'standalone_mark'
    WHEN length(token) = 1 AND regexp_matches(token, '^\\p{{S}}$') THEN 'symbol' WHEN length(token) = 1 THEN 'other_single_char' WHEN len(list_distinct(string_split(token, ''))) = 1 THEN 'repeated_char'
    WHEN regexp_matches(token, '^[{N.VOWEL_SIGNS}]+$') THEN 'stacked_vowel_signs' WHEN regexp_matches(token, '^[{N.NASAL_MARKS}]+$') THEN 'stacked_nasal_marks'
    WHEN regexp_matches(token, '[{N.VOWEL_SIGNS}{N.NASAL_MARKS}]') THEN 'mixed_diacritics' ELSE 'other_multi_char' END"""
_CODE = "'U+' || lpad(upper(to_hex(unicode({}))), 4, '0')"


@R.add(f"SELECT log_id, {_CLASS} AS class, {_CODE.format('token')} AS code FROM ({_TOKENS})")
def classify_tokens(spark, folder):
    log = table(spark, folder, "failure_log").where("token IS NOT NULL AND token <> ''")
    return log.select("log_id", N.failure_class("token").alias("class"), N.code_point("token").alias("code"))


@R.add(
    f"""SELECT token, CAST(sum(n) AS BIGINT) AS n, {_CLASS} AS class, {_CODE.format('token')} AS code, CAST(length(token) AS INTEGER) AS size, string_agg(source || '=' || n, ',' ORDER BY source) AS by_source
    FROM (SELECT token, source, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL) GROUP BY token"""
)
def failure_report(spark, folder):
    return N.failure_report(table(spark, folder, "failure_log"))


@R.add(f"SELECT class, count(*) AS failures, count(DISTINCT token) AS tokens FROM (SELECT token, {_CLASS} AS class FROM ({_TOKENS})) GROUP BY class")
def failure_classes(spark, folder):
    log = table(spark, folder, "failure_log").where("token IS NOT NULL AND token <> ''")
    counts = log.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(N.failure_class("token").alias("class")).agg(F.sum("n").alias("failures"), F.count(F.lit(1)).alias("tokens"))


@R.add("SELECT source, count(*) AS failures, count(DISTINCT token) AS tokens, count(DISTINCT nullif(doc_id, '')) AS docs FROM failure_log GROUP BY source")
def failures_by_source(spark, folder):
    return table(spark, folder, "failure_log").groupBy("source").agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("token").alias("tokens"), F.countDistinct(F.nullif("doc_id", F.lit(""))).alias("docs"))


@R.add(
    f"""SELECT sign, CAST(sum(n) AS BIGINT) AS n, {_CODE.format('sign')} AS code FROM (SELECT n, unnest(list_distinct(string_split(token, ''))) AS sign FROM (SELECT token, count(*) AS n FROM failure_log WHERE length(token) > 1 GROUP BY token)) WHERE sign <> '' GROUP BY sign"""
)
def component_analysis(spark, folder):
    return N.component_analysis(table(spark, folder, "failure_log"))


@R.add(f"SELECT source, token, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS r FROM (SELECT source, token, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL)) WHERE r <= 5")
def top_failures(spark, folder):
    """The five most frequent tokens of each source (a top-k report)."""
    from khata.operators.dedup import ranked

    counts = table(spark, folder, "failure_log").where("token IS NOT NULL AND token <> ''").groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, ["source"], [F.desc("n"), F.asc("token")]).where("rank <= 5")


@R.add("SELECT d.source AS name, count(*) AS failures, count(DISTINCT l.doc_id) AS docs FROM failure_log l JOIN documents d ON TRY_CAST(l.doc_id AS BIGINT) = d.doc_id GROUP BY d.source")
def failures_of_documents(spark, folder):
    """The log joined with its documents. The log is counted by document first, so a document with very many failures is one row in the join."""
    log = table(spark, folder, "failure_log").withColumn("doc_id", F.expr("try_cast(doc_id AS bigint)")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return log.join(table(spark, folder, "documents").select("doc_id", F.col("source").alias("name")), "doc_id").groupBy("name").agg(F.sum("n").alias("failures"), F.count(F.lit(1)).alias("docs"))


_CLEAN = "replace(replace(replace(regexp_replace(regexp_replace(nfc_normalize(text), '(^|[^\\x{9cd}])[\\x{200c}\\x{200d}]+', '\\1', 'g'), '\\x{9cd}{2,}', '্', 'g'), 'য়', 'য়'), 'ড়', 'ড়'), 'ঢ়', 'ঢ়')"
_BAD = "(regexp_matches(w, '[\\x{980}-\\x{9ff}]') AND NOT regexp_matches(w, '[\\x{985}-\\x{9b9}\\x{9ce}\\x{9dc}-\\x{9df}\\x{9e0}\\x{9e1}\\x{9e6}-\\x{9f1}]'))"
_WORDS = sql_words(_CLEAN)


@R.add(
    f"""SELECT doc_id, array_to_string([w FOR w IN own IF NOT {_BAD}], ' ') AS text, CAST(len([w FOR w IN own IF {_BAD}]) AS INTEGER) AS failed FROM (SELECT doc_id, {_WORDS} AS own FROM documents WHERE text IS NOT NULL)"""
)
def bn_normalize(spark, folder):
    own = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", N.normalize_words("text", "drop_and_collect").alias("n"))
    return own.select("doc_id", "n.text", F.size("n.failed").alias("failed"))


@R.add(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w AS token FROM (SELECT doc_id, generate_subscripts(own, 1) AS i, unnest(own) AS w FROM (SELECT doc_id, {_WORDS} AS own FROM documents WHERE text IS NOT NULL)) WHERE {_BAD}")
def bn_normalize_failures(spark, folder):
    own = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.explode(N.normalize_words("text", "collect")["failed"]).alias("f"))
    return own.select("doc_id", "f.pos", "f.token")


@R.add(f"SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS own FROM documents WHERE text IS NOT NULL AND language_region LIKE 'BD%') WHERE len([w FOR w IN own IF {_BAD}]) = 0")
def bn_strict_drop(spark, folder):
    """Documents of region BD without any failed word."""
    own = N.region_gated(table(spark, folder, "documents").where("text IS NOT NULL AND language_region LIKE 'BD%'"))
    return own.where(F.size("failed") == 0).select("doc_id")


_CUT = "list_filter(string_split(regexp_replace(text, '(<\\|[^>]+\\|>)', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '')"
_BODY = "regexp_replace(part, '^<\\|lang_bn\\|>', '')"
_OWN = sql_words(_CLEAN.replace("nfc_normalize(text)", f"nfc_normalize({_BODY})"))


@R.add(
    f"""SELECT doc_id, coalesce(string_agg(done, '' ORDER BY i), '') AS text, CAST(coalesce(sum(bad), 0) AS INTEGER) AS failed FROM (SELECT doc_id, i, CASE WHEN own IS NULL THEN part ELSE '<|lang_bn|>' || array_to_string([w FOR w IN own IF NOT {_BAD}], ' ') END AS done, len([w FOR w IN own IF {_BAD}]) AS bad
    FROM (SELECT doc_id, i, part, CASE WHEN starts_with(part, '<|lang_bn|>') THEN {_OWN} END AS own FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, CASE WHEN len({_CUT}) = 0 THEN [''] ELSE {_CUT} END AS p FROM documents WHERE text IS NOT NULL)))) GROUP BY doc_id"""
)
def segment_normalize(spark, folder):
    own = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", N.normalize_segments("text").alias("n"))
    return own.select("doc_id", "n.text", F.size("n.failed").alias("failed"))
