"""Queries on ids, tags, names and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import ids as I
from khata.functions import text as X
from khata.operators import pack
from khata.plans.common import Registry, sql_words, table
from khata.plans.packing import _IDS, _SEQS, PER_SHARD, _seqs

R = Registry()


@R.add(f"SELECT doc_id, CASE WHEN ids[1] = 2 THEN ids ELSE list_prepend(2, ids) END AS ids FROM (SELECT doc_id, {_IDS} AS ids FROM documents WHERE text IS NOT NULL)")
def bos_prefix(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", I.with_bos(pack.token_ids("text")).alias("ids"))


@R.add(f"SELECT doc_id, {_IDS}[1:32] AS ids FROM documents WHERE text IS NOT NULL")
def truncated_ids(spark, folder):
    """The first 32 ids of each document (the feature)."""
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", I.truncated(pack.token_ids("text"), 32).alias("ids"))


@R.add("SELECT run_id, CASE WHEN contains(name, '_') THEN regexp_extract(name, '^(.*)_[^_]*$', 1) ELSE name END AS model, CASE WHEN contains(name, '_') THEN regexp_extract(name, '_([^_]*)$', 1) END AS dataset FROM (SELECT run_id, model || '_' || dataset AS name FROM run_results)")
def model_dataset_split(spark, folder):
    own = table(spark, folder, "run_results").select("run_id", I.model_and_dataset(F.concat_ws("_", "model", "dataset")).alias("s"))
    return own.select("run_id", "s.model", "s.dataset")


@R.add(f"SELECT CAST(shard * {PER_SHARD} + seq AS BIGINT) AS at, shard, CAST(seq AS BIGINT) AS row FROM {_SEQS}")
def shard_lookup(spark, folder):
    """The shard and row of every global place, found through the shards' offsets."""
    from khata.operators.ordered import prefix_sum

    sizes = _seqs(spark, folder).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    shards = prefix_sum(sizes, "n", "shard", "start").withColumn("stop", F.col("start") + F.col("n")).select("shard", "start", "stop")
    places = shards.select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("at"))
    return I.located(places, "at", shards)


@R.add("SELECT sample_id, [CASE WHEN regexp_matches(w, '^[A-Z]') THEN 1 ELSE 0 END FOR w IN " + sql_words("text") + "] AS ids FROM lang_samples")
def tag_numbers(spark, folder):
    tags = F.transform(X.words("text"), lambda w: F.when(w.rlike("^[A-Z]"), "B-PER").otherwise("?"))
    return table(spark, folder, "lang_samples").select("sample_id", I.tag_ids(tags, ["O", "B-PER"]).alias("ids"))


@R.add("SELECT md5(text) AS h FROM documents WHERE text IS NOT NULL AND source = 'nllb' INTERSECT SELECT md5(text) FROM documents WHERE text IS NOT NULL AND source = 'titullm'")
def shared_texts(spark, folder):
    own = table(spark, folder, "documents").where("text IS NOT NULL").select("source", F.md5("text").alias("h"))
    return own.where("source = 'nllb'").select("h").intersect(own.where("source = 'titullm'").select("h"))


@R.add("SELECT md5(text) AS h FROM documents WHERE text IS NOT NULL EXCEPT SELECT md5(text) FROM documents WHERE text IS NOT NULL AND language_region LIKE 'BD%'")
def other_texts(spark, folder):
    own = table(spark, folder, "documents").where("text IS NOT NULL").select(F.coalesce(F.col("language_region").startswith("BD"), F.lit(False)).alias("bd"), F.md5("text").alias("h"))
    return own.select("h").subtract(own.where("bd").select("h"))


@R.add("SELECT 'first' AS strategy, doc_id FROM documents WHERE priority_of = 1 UNION ALL SELECT 'second', doc_id FROM documents WHERE priority_of = 2".replace("priority_of = 1", "source = 'nllb'").replace("priority_of = 2", "source = 'titullm'"))
def tagged_union(spark, folder):
    own = table(spark, folder, "documents").select("doc_id", "source")
    of = lambda name, tag: own.where(F.col("source") == name).select(F.lit(tag).alias("strategy"), "doc_id")
    return of("nllb", "first").unionByName(of("titullm", "second"))


@R.add(f"SELECT w AS word, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS w FROM documents WHERE text IS NOT NULL) WHERE NOT regexp_matches(w, '[A-Za-z\\x{{980}}-\\x{{9ff}}]') GROUP BY w) ORDER BY n DESC, w LIMIT 20")
def unknown_words(spark, folder):
    """The 20 most frequent words without a letter of the vocabulary's scripts (a top-k report)."""
    from khata.operators.ordered import first_rows

    own = table(spark, folder, "documents").where("text IS NOT NULL").select(F.explode(X.words("text")).alias("word"))
    counts = own.where(~F.col("word").rlike("[A-Za-z\\x{980}-\\x{9ff}]")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, 20, [F.desc("n"), F.asc("word")])


@R.add("SELECT event_id, contains(lower(trim(coalesce(props, ''))), lower(trim(event_type))) AS holds FROM events")
def answer_containment(spark, folder):
    return table(spark, folder, "events").select("event_id", F.coalesce(I.contains_answer(F.coalesce("props", F.lit("")), "event_type"), F.lit(False)).alias("holds"))
