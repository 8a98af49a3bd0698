"""Queries on documents: text functions, filters, counts, deduplication, budgets, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import text as X
from khata.operators import dedup, ingest, ordered, stats
from khata.plans.common import SOURCED, Registry, sourced, sql_band, sql_collapse, sql_count, sql_normalize_doc, sql_normalize_text, sql_strip, table

R = Registry()

# text functions


@R.add(f"SELECT doc_id, {sql_normalize_doc('text')} AS text FROM documents")
def normalize_doc(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.normalize_doc("text").alias("text"))


@R.add(f"SELECT doc_id, {sql_normalize_text('text')} AS text FROM documents")
def normalize_inline(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.normalize_text("text").alias("text"))


@R.add(f"SELECT doc_id, {sql_collapse('text')} AS text FROM documents WHERE text IS NOT NULL")
def doc_to_line(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", X.collapse("text").alias("text"))


@R.add(f"SELECT doc_id, md5(text) AS md5, sha256({sql_normalize_text('text')}) AS sha256 FROM documents")
def digests(spark, folder):
    return table(spark, folder, "documents").select("doc_id", dedup.digest("text", False).alias("md5"), dedup.digest("text", True).alias("sha256"))


@R.add(f"SELECT doc_id, sha256(lower({sql_strip('text')})) AS key FROM documents")
def contamination_keys(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.content_key("text").alias("key"))


@R.add(
    f"""SELECT doc_id, '<|lang_bn|>' || t AS text, source, CAST(n AS INTEGER) AS word_count
    FROM (SELECT doc_id, source, t, {sql_count('t')} AS n FROM (SELECT doc_id, source, {sql_normalize_doc('text')} AS t FROM documents)) WHERE n >= 20"""
)
def canonical_docs(spark, folder):
    return ingest.canonical(table(spark, folder, "documents"), X.BN).select("doc_id", "text", "source", "word_count")


@R.add(
    """SELECT doc_id, CASE WHEN r LIKE '%code%' OR r = 'python' THEN '<|lang_code|>' WHEN r LIKE '%banglish%' OR r LIKE '%bnls%' THEN '<|lang_bnls|>' WHEN r LIKE '%mix%' THEN '<|lang_mix|>'
    WHEN r IN ('en', 'english') THEN '<|lang_en|>' WHEN r LIKE '%wb%' OR r LIKE '%west%' THEN '<|lang_wbn|>' ELSE '<|lang_bn|>' END AS token
    FROM (SELECT doc_id, coalesce(lower(language_region), '') AS r FROM documents)"""
)
def language_tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.language_token("language_region").alias("token"))


@R.add(
    """WITH parts AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS part FROM
      (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(<\\|[^>]+\\|>)', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, CAST(place AS INTEGER) AS place, regexp_extract(part, '^(<\\|[^>]+\\|>)?') AS tag, regexp_replace(part, '^<\\|[^>]+\\|>', '') AS body FROM parts"""
)
def segments(spark, folder):
    each = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.segments("text")).alias("place", "s"))
    return each.select("doc_id", "place", "s.tag", "s.body")


# filters


@R.add(f"SELECT doc_id FROM documents WHERE {sql_count('text')} >= 20")
def min_words_filter(spark, folder):
    return table(spark, folder, "documents").where(X.word_count("text") >= ingest.MIN_WORDS).select("doc_id")


@R.add(f"SELECT doc_id, n_words FROM (SELECT doc_id, {sql_count('text')} AS n_words FROM documents) WHERE n_words BETWEEN 50 AND 100000")
def english_band_filter(spark, folder):
    return ingest.english_band(table(spark, folder, "documents")).select("doc_id", F.col("n_words").cast("bigint").alias("n_words"))


WORDS, PHRASES, DENSITY = ["login", "archive", "sports"], [r"status\s*=\s*500", r"read\s+more"], r"(\|\s*\w+\s*){6,}"


@R.add(
    """SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '(?i)(^|[^\\pL\\pM\\pN_])(login|archive|sports)($|[^\\pL\\pM\\pN_])') OR regexp_matches(text, '(?i)(status\\s*=\\s*500|read\\s+more)')
    OR regexp_matches(text, '(\\|[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{2028}\\x{3000}\\x{85}]*[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\x{24b6}-\\x{24e9}]+[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{2028}\\x{3000}\\x{85}]*){6,}'), false)"""
)
def content_filter(spark, folder):
    return ingest.content_filter(table(spark, folder, "documents"), WORDS, PHRASES, DENSITY).select("doc_id")


# counts

_COUNTED = f"(SELECT *, {sql_count('text')} AS n, CAST(length(text) AS BIGINT) AS c FROM {SOURCED} WHERE text IS NOT NULL)"
_TOTALS = "CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words, CAST(sum(c) AS BIGINT) AS signs, CAST(sum(n * n) AS BIGINT) AS squares, min(n) AS least, max(n) AS most"
_DERIVED = "CAST(words AS DOUBLE) / docs AS mean_words, CAST(floor(sqrt(greatest(CAST(squares AS DOUBLE) / docs - (CAST(words AS DOUBLE) / docs) * (CAST(words AS DOUBLE) / docs), 0.0))) AS BIGINT) AS std_words"


@R.add(f"SELECT *, {_DERIVED} FROM (SELECT {_TOTALS} FROM {_COUNTED})")
def word_totals(spark, folder):
    return _big(stats.totals(table(spark, folder, "documents")))


def _big(df):
    return df.select(*(F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


@R.add(f"SELECT *, {_DERIVED} FROM (SELECT name, {_TOTALS} FROM {_COUNTED} GROUP BY name)")
def word_stats_by_source(spark, folder):
    return _big(stats.totals(sourced(spark, folder), ["name"]))


@R.add(f"SELECT *, {_DERIVED} FROM (SELECT language_region, {_TOTALS} FROM {_COUNTED} GROUP BY language_region)")
def word_stats_by_language(spark, folder):
    return _big(stats.totals(table(spark, folder, "documents"), ["language_region"]))


@R.add(
    f"""SELECT name, language_region, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words, CAST(grouping(name) * 2 + grouping(language_region) AS BIGINT) AS level
    FROM {_COUNTED} GROUP BY CUBE (name, language_region)"""
)
def word_stats_cube(spark, folder):
    own = stats.counted(sourced(spark, folder))
    return own.cube("name", "language_region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"), F.grouping_id("name", "language_region").alias("level"))


@R.add(
    f"""WITH b AS (SELECT {sql_band('n')} AS band, count(*) AS docs FROM {_COUNTED} GROUP BY 1),
    names AS (SELECT * FROM (VALUES (0, '20-50'), (1, '50-100'), (2, '100-200'), (3, '200-500'), (4, '500-1k'), (5, '1k-2k'), (6, '2k-5k'), (7, '5k-10k'), (8, '10k+')) t(place, band))
    SELECT place, band, coalesce(docs, 0) AS docs FROM names LEFT JOIN b USING (band)"""
)
def word_histogram(spark, folder):
    return stats.histogram(table(spark, folder, "documents"))


_Q = {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90}


@R.add(
    f"""WITH w AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM {_COUNTED})
    SELECT {', '.join(f"max(CASE WHEN i = least(CAST(floor(total * CAST({s} AS DOUBLE)) AS BIGINT), total - 1) THEN n END) AS {k}" for k, s in _Q.items())} FROM w"""
)
def word_quantiles(spark, folder):
    return _big(ordered.index_quantiles(stats.counted(table(spark, folder, "documents")), "n_words", _Q))


_SCRIPT = "CAST(sum(len(regexp_extract_all(text, '[\\x{980}-\\x{9ff}]'))) AS BIGINT) AS own, CAST(sum(len(regexp_extract_all(text, '[0-9]'))) AS BIGINT) AS digits, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]'))) AS BIGINT) AS latin"


@R.add(
    f"""SELECT *, own / CAST(greatest(signs, 1) AS DOUBLE) AS own_share, digits / CAST(greatest(signs, 1) AS DOUBLE) AS digits_share, latin / CAST(greatest(signs, 1) AS DOUBLE) AS latin_share,
    other / CAST(greatest(signs, 1) AS DOUBLE) AS other_share FROM (SELECT *, signs - own - digits - latin AS other FROM (SELECT language_region, {_SCRIPT}, CAST(sum(length(text)) AS BIGINT) AS signs FROM documents WHERE text IS NOT NULL GROUP BY 1))"""
)
def script_ratio(spark, folder):
    own = stats.script_shares(table(spark, folder, "documents"), ["language_region"])
    return own.withColumn("signs", F.col("own") + F.col("digits") + F.col("latin") + F.col("other"))


@R.add(f"SELECT name, CAST(sum(n) AS BIGINT) AS words, CAST(floor(sum(n) * CAST(1.49 AS DOUBLE)) AS BIGINT) AS tokens FROM {_COUNTED} GROUP BY name")
def token_estimate(spark, folder):
    return stats.token_estimate(sourced(spark, folder), ["name"])


@R.add(f"SELECT name, band, count(*) AS docs FROM (SELECT name, {sql_band('n')} AS band FROM {_COUNTED}) GROUP BY ALL")
def band_by_source(spark, folder):
    return stats.counted(sourced(spark, folder)).groupBy("name", X.band("n_words").alias("band")).agg(F.count(F.lit(1)).alias("docs"))


# deduplication

_HASHED = f"(SELECT *, CASE WHEN {sql_normalize_text('text')} <> '' THEN sha256({sql_normalize_text('text')}) END AS h FROM {SOURCED})"


def _hashed(spark, folder):
    key = X.normalize_text("text")
    return sourced(spark, folder).withColumn("h", F.when(key != "", F.sha2(key, 256)))


@R.add(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY priority, doc_id) AS r FROM {SOURCED} WHERE text IS NOT NULL) WHERE r = 1")
def first_wins_md5(spark, folder):
    return dedup.first_wins(sourced(spark, folder), dedup.digest("text", False)).select("doc_id")


@R.add(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY h ORDER BY priority, doc_id) AS r FROM {_HASHED} WHERE h IS NOT NULL) WHERE r = 1")
def first_wins_norm(spark, folder):
    return dedup.first_wins(_hashed(spark, folder), F.col("h")).select("doc_id")


@R.add(
    f"""WITH m AS (SELECT name, row_number() OVER w = 1 AS kept, first_value(name) OVER w AS absorber FROM {_HASHED} WHERE h IS NOT NULL WINDOW w AS (PARTITION BY h ORDER BY priority, doc_id)),
    own AS (SELECT name, count(*) AS rows_in, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM m GROUP BY name), a AS (SELECT absorber, count(*) AS absorbed FROM m WHERE NOT kept GROUP BY 1)
    SELECT name, rows_in, kept, dropped, coalesce(absorbed, 0) AS absorbed FROM own LEFT JOIN a ON name = absorber"""
)
def dup_attribution(spark, folder):
    return dedup.attribution(dedup.marked(_hashed(spark, folder), F.col("h"), source="name"), "name")


@R.add("SELECT total, distinct_texts, total - distinct_texts AS duplicates, CAST(100.0 AS DOUBLE) * (total - distinct_texts) / greatest(total, 1) AS pct FROM (SELECT count(text) AS total, count(DISTINCT md5(text)) AS distinct_texts FROM documents)")
def dup_summary(spark, folder):
    return dedup.summary(table(spark, folder, "documents"), dedup.digest("text", False))


@R.add("SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)) GROUP BY copies ORDER BY groups DESC, copies LIMIT 10")
def top_group_sizes(spark, folder):
    """The ten most frequent sizes of groups of equal texts (a top-k report)."""
    return dedup.group_sizes(table(spark, folder, "documents"), dedup.digest("text", False)).orderBy(F.desc("groups"), "copies").limit(10)


@R.add("SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)) GROUP BY copies")
def dup_group_sizes(spark, folder):
    return dedup.group_sizes(table(spark, folder, "documents"), dedup.digest("text", False))


_STATES = f"""(WITH d AS (SELECT *, priority <= 2 AS is_base, {sql_count('text')} AS n FROM {_HASHED}),
    b AS (SELECT DISTINCT h FROM d WHERE is_base AND h IS NOT NULL), i AS (SELECT d.*, b.h IS NOT NULL AS known FROM d LEFT JOIN b ON d.h = b.h WHERE NOT is_base)
    SELECT *, CASE WHEN h IS NULL THEN 'empty' WHEN known THEN 'base' WHEN row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 THEN 'self' ELSE 'kept' END AS state FROM i)"""


def _states(spark, folder):
    docs = _hashed(spark, folder).withColumn("n", X.word_count("text"))
    return dedup.against_base(docs.where("priority > 2"), docs.where("priority <= 2"))


@R.add(f"SELECT doc_id FROM {_STATES} WHERE state = 'kept'")
def base_dedup(spark, folder):
    return _states(spark, folder).where("state = 'kept'").select("doc_id")


@R.add(f"SELECT state, count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS words FROM {_STATES} GROUP BY state")
def base_dedup_stats(spark, folder):
    return _states(spark, folder).groupBy("state").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))


@R.add(
    f"""WITH s AS (SELECT *, coalesce(sum(CASE WHEN state = 'kept' THEN 1 ELSE 0 END) OVER w, 0) AS docs_before, coalesce(sum(CASE WHEN state = 'kept' THEN n ELSE 0 END) OVER w, 0) AS words_before FROM {_STATES}
    WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT state, count(*) AS docs FROM s WHERE docs_before < 200 AND words_before < 30000 GROUP BY state"""
)
def base_dedup_capped(spark, folder):
    """What a scan counts that stops at 200 documents or 30,000 words kept (the cap is the feature)."""
    kept = F.col("state") == "kept"
    own = ordered.prefix_sum(_states(spark, folder).select("doc_id", "state", "n"), F.when(kept, 1), "doc_id", "docs_before")
    own = ordered.prefix_sum(own, F.when(kept, F.col("n")), "doc_id", "words_before")
    return own.where("docs_before < 200 AND words_before < 30000").groupBy("state").agg(F.count(F.lit(1)).alias("docs"))


# budgets and orders


@R.add(f"SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_COUNTED}) WHERE b < 50000")
def word_budget(spark, folder):
    own = stats.counted(table(spark, folder, "documents")).select("doc_id", "n_words")
    return ordered.greedy_budget(own, "n_words", "doc_id", 50_000).select("doc_id")


@R.add(f"SELECT doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY name ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM {_COUNTED}")
def words_before(spark, folder):
    own = stats.counted(sourced(spark, folder)).select("doc_id", "name", "n_words")
    return ordered.prefix_sum(own, "n_words", "doc_id", "words_before", ["name"]).select("doc_id", "words_before")


@R.add(
    f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM {_COUNTED} WHERE lang IN ('bn', 'en')) WHERE b < CASE lang WHEN 'bn' THEN 34000 ELSE 6000 END"""
)
def ratio_sample(spark, folder):
    """40,000 words of which 85 % Bangla; each language's budget ends with its documents."""
    own = stats.counted(table(spark, folder, "documents")).where("lang in ('bn', 'en')").select("doc_id", "lang", "n_words")
    total, share = 40_000, 0.85
    budget = F.when(F.col("lang") == "bn", int(total * share)).otherwise(total - int(total * share))
    return ordered.greedy_budget(own, "n_words", "doc_id", budget, ["lang"]).select("doc_id", "lang")


@R.add("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 + CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY lang) AS place FROM documents WHERE lang IN ('bn', 'en')")
def interleave(spark, folder):
    return ordered.interleaved(table(spark, folder, "documents").where("lang in ('bn', 'en')").select("doc_id", "lang"), "doc_id", "lang")


@R.add("SELECT doc_id, md5('44:' || doc_id) AS shuffle_key FROM documents")
def epoch_order(spark, folder):
    return ordered.permuted(table(spark, folder, "documents").select("doc_id"), "doc_id", 42, 2)


@R.add("SELECT doc_id, CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT < 858993459 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark, folder):
    return ordered.hash_split(table(spark, folder, "documents").select("doc_id"), "doc_id", 0.2, 42)


@R.add("SELECT doc_id, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM " + SOURCED + ") WHERE r <= 25")
def head_sample(spark, folder):
    """The first 25 documents of each source (a sampling operator)."""
    return ordered.first_rows(sourced(spark, folder).select("doc_id", "name"), 25, ["doc_id"], ["name"])


@R.add("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 300")
def hash_sample(spark, folder):
    """300 documents by hash order (a sampling operator)."""
    return ordered.first_rows(ordered.permuted(table(spark, folder, "documents").select("doc_id"), "doc_id", 7, 0), 300, ["shuffle_key", "doc_id"]).select("doc_id")


@R.add(f"SELECT doc_id, CAST(priority AS INTEGER) AS priority, name FROM {SOURCED}")
def source_priority(spark, folder):
    return sourced(spark, folder).select("doc_id", "priority", "name")
