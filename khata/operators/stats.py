"""Counts and distributions of words and signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.text import BANDS, LAST_BAND, band, script_counts, word_count

#: Tokens expected per word.
TOKENS_PER_WORD = 1.49


def counted(docs: DataFrame) -> DataFrame:
    """Adds n_words and n_signs; rows with a null text are left out."""
    return docs.where("text IS NOT NULL").withColumn("n_words", word_count("text")).withColumn("n_signs", F.length("text"))


def totals(docs: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """Documents, words, signs, sum of squared word counts, extremes, mean and population standard deviation (whole words)."""
    own = counted(docs).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n_words").alias("words"),
        F.sum("n_signs").alias("signs"),
        F.sum(F.col("n_words") * F.col("n_words")).alias("squares"),
        F.min("n_words").alias("least"),
        F.max("n_words").alias("most"),
    )
    mean = F.col("words").cast("double") / F.col("docs")
    variance = F.col("squares").cast("double") / F.col("docs") - mean * mean
    return own.withColumn("mean_words", mean).withColumn("std_words", F.floor(F.sqrt(F.greatest(variance, F.lit(0.0)))))


def histogram(docs: DataFrame) -> DataFrame:
    """Documents by class of word count; classes without documents count 0."""
    own = counted(docs).groupBy(band("n_words").alias("band")).agg(F.count(F.lit(1)).alias("docs"))
    names = [name for _, name in BANDS] + [LAST_BAND]
    every = docs.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names)], "place INT, band STRING")
    return every.join(own, "band", "left").select("place", "band", F.coalesce("docs", F.lit(0)).alias("docs"))


def script_shares(docs: DataFrame, by: list[str]) -> DataFrame:
    """Signs of the script, ASCII digits, ASCII letters and others, and their shares."""
    own = docs.where("text IS NOT NULL").select(*by, script_counts("text").alias("s"))
    kinds = ("own", "digits", "latin", "other")
    sums = own.groupBy(*by).agg(*(F.sum(f"s.{k}").alias(k) for k in kinds))
    total = F.greatest(sum((F.col(k) for k in kinds[1:]), F.col("own")), F.lit(1)).cast("double")
    return sums.select(*by, *kinds, *((F.col(k) / total).alias(f"{k}_share") for k in kinds))


def token_estimate(docs: DataFrame, by: list[str]) -> DataFrame:
    own = counted(docs).groupBy(*by).agg(F.sum("n_words").alias("words"))
    return own.withColumn("tokens", F.floor(F.col("words") * F.lit(TOKENS_PER_WORD)))
