"""Queries on hash tokens and packed sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions.text import word_count
from khata.operators import pack
from khata.plans.common import SOURCED, Registry, sourced, sql_count, sql_words, table

R = Registry()
PER_SHARD = 16

_ID = "CAST(146 + (('0x' || substr(md5(w), 1, 8))::BIGINT % 47854) AS INTEGER)"
_IDS = f"list_append(list_transform({sql_words('text')}, lambda w: {_ID}), 3)"
_FLAT = f"""(SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM (SELECT doc_id, generate_subscripts(ids, 1) AS i, unnest(ids) AS t FROM (SELECT doc_id, {_IDS} AS ids FROM documents WHERE text IS NOT NULL)))"""
_SEQS = f"""(SELECT CAST(s // {PER_SHARD} AS INTEGER) AS shard, CAST(s % {PER_SHARD} AS INTEGER) AS seq, input_ids FROM (SELECT g // 2048 AS s, list(t ORDER BY g) AS input_ids FROM {_FLAT} GROUP BY 1) WHERE len(input_ids) = 2048)"""
_LONG = f"(SELECT shard, seq, generate_subscripts(input_ids, 1) - 1 AS pos, unnest(input_ids) AS token FROM {_SEQS})"
_COUNTS = f"(SELECT shard, token, count(*) AS n FROM {_LONG} GROUP BY ALL)"


def _seqs(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return pack.packed(docs, pack.token_ids("text"), "doc_id", per_shard=PER_SHARD, size=word_count("text") + 1)


@R.add(f"SELECT doc_id, {_IDS} AS ids FROM documents WHERE text IS NOT NULL")
def tokenize(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", pack.token_ids("text").alias("ids"))


@R.add(f"SELECT name, CAST(sum(n + 1) AS BIGINT) AS tokens, count(*) AS docs FROM (SELECT name, {sql_count('text')} AS n FROM {SOURCED} WHERE text IS NOT NULL) GROUP BY ROLLUP (name)")
def tokens_rollup(spark, folder):
    own = sourced(spark, folder).where("text IS NOT NULL").select("name", F.size(pack.token_ids("text")).alias("n"))
    return own.rollup("name").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))


@R.add(f"SELECT * FROM {_SEQS}")
def pack_sequences(spark, folder):
    return _seqs(spark, folder)


@R.add(f"SELECT shard, count(*) AS seqs, CAST(count(*) * 2048 AS BIGINT) AS tokens, CAST(count(*) * 2048 // (4 * 64 * 2048) AS BIGINT) AS steps FROM {_SEQS} GROUP BY shard")
def pack_shards(spark, folder):
    own = _seqs(spark, folder).groupBy("shard").agg(F.count(F.lit(1)).alias("seqs")).withColumn("tokens", F.col("seqs") * 2048)
    return own.withColumn("steps", F.expr("tokens div (4 * 64 * 2048)"))


@R.add(
    f"""SELECT shard, count(DISTINCT seq) AS seqs, min(token) AS min_id, max(token) AS max_id, count(*) FILTER (token < 0 OR token >= 48000) AS out_of_range, count(*) = 2048 * count(DISTINCT seq) AS valid_shape FROM {_LONG} GROUP BY shard"""
)
def shard_audit(spark, folder):
    return pack.shard_audit(_seqs(spark, folder))


@R.add(f"SELECT shard, seq, count(*) FILTER (token = 3) AS n_eos, count(*) FILTER (token = 0) AS n_pad FROM {_LONG} GROUP BY ALL")
def eos_density(spark, folder):
    own = pack.densities(_seqs(spark, folder))
    return own.select("shard", "seq", F.col("n_eos").cast("bigint").alias("n_eos"), F.col("n_pad").cast("bigint").alias("n_pad"))


@R.add(f"SELECT shard, CAST(count(*) FILTER (token = 0) AS DOUBLE) / count(*) AS padding FROM {_LONG} GROUP BY shard")
def padding_ratio(spark, folder):
    return pack.padding_ratio(_seqs(spark, folder))


@R.add(
    f"""SELECT shard, seq, CAST(segment AS INTEGER) AS segment, CAST(length AS INTEGER) AS length FROM (SELECT shard, seq, row_number() OVER w - 1 AS segment, pos - coalesce(lag(pos) OVER w, -1) - 1 AS length FROM {_LONG} WHERE token = 3 WINDOW w AS (PARTITION BY shard, seq ORDER BY pos)) WHERE length > 0"""
)
def segment_lengths(spark, folder):
    return pack.segment_lengths(_seqs(spark, folder))


@R.add(f"SELECT v.token, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS token FROM range(48000)) v LEFT JOIN (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM {_COUNTS} GROUP BY token) c ON v.token = c.token")
def token_bincount(spark, folder):
    every = spark.range(pack.VOCABULARY).select(F.col("id").cast("int").alias("token"))
    return every.join(pack.token_counts(_seqs(spark, folder), []), "token", "left").fillna(0, ["n"])


@R.add(f"SELECT shard, round(-sum(p * log2(p)), 7) AS bits FROM (SELECT shard, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY shard) AS p FROM {_COUNTS}) GROUP BY shard")
def shard_entropy(spark, folder):
    return pack.entropy(pack.token_counts(_seqs(spark, folder), ["shard"]), ["shard"]).withColumn("bits", F.round("bits", 7))


@R.add(f"SELECT shard, CAST(count(DISTINCT token) AS DOUBLE) / 48000 * 100 AS pct FROM {_COUNTS} GROUP BY shard")
def vocab_coverage(spark, folder):
    return pack.coverage(pack.token_counts(_seqs(spark, folder), ["shard"]), ["shard"])


@R.add(f"SELECT n, CAST(coalesce(sum(tokens) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_rank, tokens FROM (SELECT n, count(*) AS tokens FROM (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM {_COUNTS} GROUP BY token) GROUP BY n)")
def zipf(spark, folder):
    return pack.zipf(pack.token_counts(_seqs(spark, folder), []))


@R.add(f"SELECT shard, token, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n DESC, token) AS rank FROM {_COUNTS}) WHERE rank <= 50")
def top50_tokens(spark, folder):
    """The 50 most frequent tokens of each shard (a top-k report)."""
    return pack.top_tokens(pack.token_counts(_seqs(spark, folder), ["shard"]), ["shard"])


@R.add(f"SELECT shard, seq, input_ids[1:2047] AS inputs, input_ids[2:2048] AS targets FROM {_SEQS}")
def next_token_pairs(spark, folder):
    return _seqs(spark, folder).select("shard", "seq", F.slice("input_ids", 1, 2047).alias("inputs"), F.slice("input_ids", 2, 2047).alias("targets"))


@R.add(f"SELECT CAST(count(*) AS BIGINT) AS seqs, CAST(min(shard * {PER_SHARD} + seq) AS BIGINT) AS first, CAST(max(shard * {PER_SHARD} + seq) AS BIGINT) AS last FROM {_SEQS} WHERE shard < 2")
def first_shards(spark, folder):
    """The first two shards only (the feature)."""
    own = _seqs(spark, folder).where("shard < 2").withColumn("at", (F.col("shard") * PER_SHARD + F.col("seq")).cast("bigint"))
    return own.agg(F.count(F.lit(1)).alias("seqs"), F.min("at").alias("first"), F.max("at").alias("last"))


@R.add(f"SELECT shard, seq, CAST(row_number() OVER (ORDER BY md5('43:' || (shard * {PER_SHARD} + seq)), shard * {PER_SHARD} + seq) - 1 AS BIGINT) AS place FROM {_SEQS}")
def epoch_resume(spark, folder):
    """Each sequence's place in the permutation of epoch 1. Places come from range-partitioned counts, not from one sorted task."""
    from khata.operators.ordered import permuted, prefix_sum

    own = _seqs(spark, folder).select("shard", "seq", (F.col("shard") * PER_SHARD + F.col("seq")).cast("bigint").alias("at"))
    own = permuted(own, "at", 42, 1)
    number = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
    same = own.withColumn("number", number)
    placed = prefix_sum(same, F.lit(1), "number", "place", bucket=1 << 24, ties=["shuffle_key", "at"])
    return placed.select("shard", "seq", "place")
