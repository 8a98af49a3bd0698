"""Queries with public tokenizers, which SQL can't express; they are tested against loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import bpe
from khata.functions import text as X
from khata.operators.ordered import first_rows, index_quantiles
from khata.plans.common import Registry, sourced, table

R = Registry()


@R.add()
def tokenizer_metrics(spark, folder):
    """Fertility, compression, unknown tokens, round trips and fragmentation by source."""
    return bpe.tokenizer_metrics(sourced(spark, folder), ["name"])


@R.add()
def tokens_per_document(spark, folder):
    """One row: documents with text, and the mean, median, least and most tokens, and tokens a word."""
    own = table(spark, folder, "documents").where("text IS NOT NULL").select(F.size(bpe.encoded("text")).alias("n"), X.word_count("text").alias("w"))
    median = index_quantiles(own, "n", {"median_tokens": 0.5}).withColumn("_one", F.lit(1))
    total = own.agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 1).alias("mean_tokens"), F.min("n").alias("least_tokens"), F.max("n").alias("most_tokens"), F.round(F.sum("n").cast("double") / F.greatest(F.sum("w"), F.lit(1)), 3).alias("tokens_per_word"))
    return total.withColumn("_one", F.lit(1)).join(median, "_one").drop("_one")  # one row each


@R.add()
def unknown_signs(spark, folder):
    """The 20 most frequent signs that a vocabulary of pieces has to spell by bytes (a top-k report)."""
    return first_rows(bpe.unknown_signs(table(spark, folder, "documents")), 20, [F.desc("n"), F.asc("sign")])


@R.add()
def cut_texts(spark, folder):
    """Each text cut to its first 64 tokens (the feature), as text."""
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", bpe.cut_text("text", 64).alias("text"))
