"""Bringing documents and pairs into the canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions.text import BN, BN_EN, EN, EN_BN, normalize_doc, normalize_text, prefixed, word_count

#: The canonical document.
DOCUMENT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("language_region", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

MIN_WORDS = 20
ENGLISH_WORDS = (50, 100_000)
PAIR_WORDS, PAIR_RATIO, MIN_SCORE = 3, (0.4, 2.5), 1.06


def source_key(c: str | Column) -> Column:
    """A source name without case, white space, hyphens and underscores."""
    return F.lower(F.regexp_replace(c, r"[\s\xa0_\-]+", ""))


def with_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `name`, `priority` and `domain` of the source that a row's spelling means; 'other', 99 and null for an unknown one. The sources have one row each and are few; Spark decides by size whether to broadcast them."""
    known = sources.select(F.col("source").alias("_name"), F.col("priority").alias("_priority"), F.col("domain").alias("_domain"), source_key("source").alias("_key"))
    joined = docs.drop("name", "priority", "domain").join(known, source_key(docs["source"]) == F.col("_key"), "left")
    return joined.withColumn("name", F.coalesce("_name", F.lit("other"))).withColumn("priority", F.coalesce("_priority", F.lit(99))).withColumn("domain", F.col("_domain")).drop("_name", "_priority", "_domain", "_key")


def canonical(docs: DataFrame, tag: str, least: int = MIN_WORDS) -> DataFrame:
    """Documents with normalized text behind a language tag and their word counts; too short and null ones are left out."""
    text = normalize_doc("text")
    own = docs.withColumn("_t", text).withColumn("_n", word_count("_t")).where(F.col("_n") >= least)
    return own.withColumn("text", prefixed(tag, "_t")).withColumn("word_count", F.col("_n").cast("int")).drop("_t", "_n")


def english_band(docs: DataFrame, low: int = ENGLISH_WORDS[0], high: int = ENGLISH_WORDS[1]) -> DataFrame:
    return docs.withColumn("n_words", word_count("text")).where(F.col("n_words").between(low, high))


def content_filter(docs: DataFrame, words: list[str], phrases: list[str], density: str, text: str = "text") -> DataFrame:
    """Rows without any of the words (as whole words), phrases or the density pattern, in any case; null texts are kept."""
    held = [rf"(?iU)\b({'|'.join(words)})\b", rf"(?iU)({'|'.join(phrases)})", f"(?U){density}"]
    bad = F.lit(False)
    for pattern in held:
        bad = bad | F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    return docs.where(~bad)


def pair_checks(pairs: DataFrame) -> DataFrame:
    """Normalized sides, word counts and the first check each pair fails ('empty', 'short', 'ratio', 'score'; null if none)."""
    own = pairs.withColumn("bn", normalize_text("bn")).withColumn("en", normalize_text("en"))
    own = own.withColumn("bn_words", F.coalesce(word_count("bn"), F.lit(0))).withColumn("en_words", F.coalesce(word_count("en"), F.lit(0)))
    ratio = F.col("en_words").cast("double") / F.col("bn_words")
    fails = (
        F.when((F.coalesce("bn", F.lit("")) == "") | (F.coalesce("en", F.lit("")) == ""), "empty")
        .when((F.col("bn_words") < PAIR_WORDS) | (F.col("en_words") < PAIR_WORDS), "short")
        .when(~ratio.between(*PAIR_RATIO), "ratio")
        .when(F.col("score") < MIN_SCORE, "score")
    )
    return own.withColumn("fails", fails)


def good_pairs(pairs: DataFrame) -> DataFrame:
    return pair_checks(pairs).where("fails IS NULL").drop("fails")


def pair_dedup(pairs: DataFrame, key: str = "bn", order: str = "pair_id") -> DataFrame:
    """Of pairs with the same side `key` the first; only pairs that passed the filters come in."""
    first = pairs.groupBy(F.md5(key).alias("_h")).agg(F.min(order).alias(order))
    return pairs.join(first.select(order), order, "left_semi")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Two documents of each pair, one for each direction; both carry the words of both sides."""
    forth = F.concat(F.lit(BN_EN + BN), "bn", F.lit(EN), "en")
    back = F.concat(F.lit(EN_BN + EN), "en", F.lit(BN), "bn")
    both = F.array(F.struct(F.lit("bn_en").alias("direction"), forth.alias("text")), F.struct(F.lit("en_bn").alias("direction"), back.alias("text")))
    return pairs.withColumn("_d", F.explode(both)).withColumn("word_count", F.col("bn_words") + F.col("en_words")).select("pair_id", "_d.direction", "_d.text", "source", "word_count")
