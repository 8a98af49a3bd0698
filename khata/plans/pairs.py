"""Queries on parallel pairs and JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.operators import ingest
from khata.plans.common import Registry, sql_count, sql_normalize_text, table
from khata.sources import lines

R = Registry()

_CHECKED = f"""(SELECT *, CASE WHEN coalesce(bn, '') = '' OR coalesce(en, '') = '' THEN 'empty' WHEN bn_words < 3 OR en_words < 3 THEN 'short'
    WHEN NOT (CAST(en_words AS DOUBLE) / bn_words BETWEEN CAST(0.4 AS DOUBLE) AND CAST(2.5 AS DOUBLE)) THEN 'ratio' WHEN score < CAST(1.06 AS DOUBLE) THEN 'score' END AS fails
    FROM (SELECT *, coalesce({sql_count('bn')}, 0) AS bn_words, coalesce({sql_count('en')}, 0) AS en_words
    FROM (SELECT pair_id, {sql_normalize_text('bn')} AS bn, {sql_normalize_text('en')} AS en, score, source, batch, received_at FROM parallel_pairs)))"""


def _checked(spark, folder):
    return ingest.pair_checks(table(spark, folder, "parallel_pairs"))


@R.add(f"SELECT pair_id, bn, en, bn_words, en_words FROM {_CHECKED} WHERE fails IS NULL")
def pair_filter(spark, folder):
    own = ingest.good_pairs(table(spark, folder, "parallel_pairs"))
    return own.select("pair_id", "bn", "en", F.col("bn_words").cast("bigint").alias("bn_words"), F.col("en_words").cast("bigint").alias("en_words"))


@R.add(f"SELECT source, coalesce(fails, 'kept') AS state, count(*) AS pairs, CAST(100.0 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY source) AS pct FROM {_CHECKED} GROUP BY source, fails")
def pair_funnel(spark, folder):
    own = _checked(spark, folder).groupBy("source", F.coalesce("fails", F.lit("kept")).alias("state")).agg(F.count(F.lit(1)).alias("pairs"))
    total = own.groupBy("source").agg(F.sum("pairs").alias("total"))
    return own.join(total, own["source"].eqNullSafe(total["source"])).drop(total["source"]).select("source", "state", "pairs", (F.lit(100.0) * F.col("pairs") / F.col("total")).alias("pct"))


_DEDUPED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5(bn) ORDER BY pair_id) AS r FROM {_CHECKED} WHERE fails IS NULL) WHERE r = 1)"


def _deduped(spark, folder):
    return ingest.pair_dedup(ingest.good_pairs(table(spark, folder, "parallel_pairs")))


@R.add(f"SELECT pair_id FROM {_DEDUPED}")
def pair_dedup(spark, folder):
    return _deduped(spark, folder).select("pair_id")


_MIRRORED = f"""(SELECT pair_id, 'bn_en' AS direction, '<|task_translate_bn_en|><|lang_bn|>' || bn || '<|lang_en|>' || en AS text, source, bn_words + en_words AS word_count FROM {_DEDUPED}
    UNION ALL SELECT pair_id, 'en_bn', '<|task_translate_en_bn|><|lang_en|>' || en || '<|lang_bn|>' || bn, source, bn_words + en_words FROM {_DEDUPED})"""


@R.add(f"SELECT * FROM {_MIRRORED}")
def pair_mirror(spark, folder):
    return ingest.mirrored(_deduped(spark, folder)).withColumn("word_count", F.col("word_count").cast("bigint"))


@R.add(f"SELECT source, direction, count(*) AS docs, CAST(sum(word_count) AS BIGINT) AS words FROM {_MIRRORED} GROUP BY ALL")
def pair_words(spark, folder):
    return ingest.mirrored(_deduped(spark, folder)).groupBy("source", "direction").agg(F.count(F.lit(1)).alias("docs"), F.sum("word_count").alias("words"))


@R.add("SELECT source, max(score) AS best, round(avg(score), 8) AS mean, count(*) FILTER (score >= CAST(1.06 AS DOUBLE)) AS passing, count(*) FILTER (score IS NULL) AS unscored FROM parallel_pairs GROUP BY source")
def pair_scores(spark, folder):
    return table(spark, folder, "parallel_pairs").groupBy("source").agg(F.max("score").alias("best"), F.round(F.avg("score"), 8).alias("mean"), F.count_if(F.col("score") >= ingest.MIN_SCORE).alias("passing"), F.count_if(F.col("score").isNull()).alias("unscored"))


@R.add("SELECT pair_id AS ord, bn, en FROM (SELECT pair_id, bn FROM parallel_pairs) JOIN (SELECT pair_id, en FROM parallel_pairs) USING (pair_id)")
def pair_zip(spark, folder):
    """Two aligned streams joined by place."""
    own = table(spark, folder, "parallel_pairs")
    a, b = own.select(F.col("pair_id").alias("ord"), "bn"), own.select(F.col("pair_id").alias("ord"), "en")
    return a.join(b, "ord")


_OBJECT = "json_valid(raw) AND regexp_matches(raw, '^\\s*\\{')"
_READ = "SELECT line_id, file, " + ", ".join(f"CASE WHEN {_OBJECT} THEN raw->>'{f}' END AS {f}" for f in ("text", "source", "source_type", "language_region")) + f", CASE WHEN {_OBJECT} THEN TRY_CAST(raw->>'word_count' AS INTEGER) END AS word_count FROM raw_lines WHERE {_OBJECT}"


@R.add(_READ)
def json_scan(spark, folder):
    """The lines that hold a JSON object, in the canonical schema; others are skipped."""
    return lines.parsed(table(spark, folder, "raw_lines"), "raw").select("line_id", "file", "text", "source", "source_type", "language_region", "word_count")


@R.add(f"SELECT file, count(*) AS total, count(*) FILTER ({_OBJECT}) AS valid, count(*) FILTER (raw IS NULL OR trim(raw) = '') AS blank FROM raw_lines GROUP BY file")
def json_audit(spark, folder):
    own = lines.parsed(table(spark, folder, "raw_lines"), "raw", keep=True)
    blank = F.col("raw").isNull() | (F.trim("raw") == "")
    return own.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(blank).alias("blank"))


@R.add(f"SELECT source, count(*) AS docs, count(DISTINCT md5(text)) AS texts, CAST(coalesce(sum({sql_count('text')}), 0) AS BIGINT) AS words FROM ({_READ}) GROUP BY source")
def json_stats(spark, folder):
    from khata.functions.text import word_count

    own = lines.parsed(table(spark, folder, "raw_lines"), "raw")
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct(F.md5("text")).alias("texts"), F.coalesce(F.sum(word_count("text")), F.lit(0)).cast("bigint").alias("words"))
