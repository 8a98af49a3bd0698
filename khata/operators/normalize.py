"""Word-wise normalization of Bangla and the analysis of its failures, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.text import BN, nfc, segments, words

BLOCK = "[\u0980-\u09ff]"
#: Letters and digits that can carry a word.
BASE = "[\u0985-\u09b9\u09ce\u09dc-\u09df\u09e0\u09e1\u09e6-\u09f1]"
LATIN = r"[A-Za-z]"
POLICIES = ("drop", "keep_original", "error", "collect", "drop_and_collect")


def cleaned(word: Column) -> Column:
    """A text without joiners that follow no virama, and without doubled viramas; nuktas in composed letters."""
    word = F.regexp_replace(word, "(^|[^\u09cd])[\u200c\u200d]+", "$1")
    word = F.regexp_replace(word, "\u09cd{2,}", "\u09cd")
    for parts, whole in (("\u09af\u09bc", "\u09df"), ("\u09a1\u09bc", "\u09dc"), ("\u09a2\u09bc", "\u09dd")):
        word = F.replace(word, F.lit(parts), F.lit(whole))
    return word


def fails(word: Column, allow_english: bool = True) -> Column:
    """Whether a word can't be normalized: Bangla signs without any base letter, or, where English isn't allowed, Latin letters."""
    bad = word.rlike(BLOCK) & ~word.rlike(BASE)
    return bad if allow_english else bad | word.rlike(LATIN)


def normalize_words(text: str | Column, policy: str = "drop", allow_english: bool = True) -> Column:
    """struct<text, failed array<struct<pos, token>>> of a text's words.

    Words are cleaned first. drop leaves failed words out, keep_original and collect keep
    them, error stops the query; the collecting policies list them with their place (from 0). A null text
    gives null.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")
    own = words(cleaned(nfc(text)))
    failed = F.filter(F.transform(own, lambda w, i: F.struct(i.alias("pos"), w.alias("token"))), lambda x: fails(x["token"], allow_english))
    kept = own if policy in ("keep_original", "collect") else F.filter(own, lambda w: ~fails(w, allow_english))
    done = F.array_join(kept, " ")
    if policy == "error":
        done = F.when(F.size(failed) > 0, F.raise_error(F.concat(F.lit("not normalizable: "), F.element_at(failed, 1)["token"]))).otherwise(done)
    listed = failed if policy in ("collect", "drop_and_collect") else F.filter(failed, lambda x: F.lit(False))
    out = F.struct(done.alias("text"), listed.alias("failed"))
    return F.when((F.col(text) if isinstance(text, str) else text).isNotNull(), out)


def region_gated(docs: DataFrame, policy: str = "drop_and_collect") -> DataFrame:
    """Documents of a region that begins with BD with normalized text and `failed`; others pass as they are."""
    done = normalize_words("text", policy)
    return docs.withColumn("_n", F.when(F.col("language_region").startswith("BD"), done)).withColumn("text", F.coalesce("_n.text", "text")).withColumn("failed", F.col("_n.failed")).drop("_n")


def normalize_segments(text: str | Column) -> Column:
    """struct<text, failed>: only what follows a Bangla tag is normalized; failed words are dropped and listed by segment order."""
    # control tokens are ASCII, so the text and its NFC form have the same segments
    both = F.arrays_zip(segments(text).alias("raw"), segments(nfc(text)).alias("nfc"))
    parts = F.transform(both, lambda s: F.struct(s["raw"]["tag"].alias("tag"), s["raw"]["body"].alias("body"), F.when(s["raw"]["tag"] == BN, words(cleaned(s["nfc"]["body"]))).otherwise(F.array().cast("array<string>")).alias("words")))
    done = F.transform(parts, lambda s: F.concat(s["tag"], F.when(s["tag"] == BN, F.array_join(F.filter(s["words"], lambda w: ~fails(w)), " ")).otherwise(s["body"])))
    return F.struct(F.array_join(done, "").alias("text"), F.filter(F.flatten(F.transform(parts, lambda s: s["words"])), lambda w: fails(w)).alias("failed"))


# Signs of the failure classes.
VOWEL_SIGNS = "\u09be\u09bf\u09c0\u09c1\u09c2\u09c3\u09c7\u09c8\u09cb\u09cc"
NASAL_MARKS = "\u0981\u0982\u0983"
SYMBOLS = "\u09f3\u09f4\u09f5\u09f6\u09f7\u09f9\u09e2\u09e3"
HALANT = "\u09cd"


def failure_class(token: str | Column) -> Column:
    """The class of a failed token; the first rule that fits counts. Null and empty tokens have none."""
    t = F.col(token) if isinstance(token, str) else token
    one = F.length(t) == 1
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(one & t.rlike(f"^[{VOWEL_SIGNS}]$"), "standalone_vowel_sign")
        .when(one & t.rlike(f"^[{NASAL_MARKS}]$"), "standalone_nasalization")
        .when(one & t.rlike(f"^[{SYMBOLS}]$"), "symbol")
        .when(one & (t == HALANT), "standalone_halant")
        .when(one & t.rlike(r"^\p{M}$"), "standalone_mark")
        .when(one & t.rlike(r"^\p{S}$"), "symbol")
        .when(one, "other_single_char")
        .when(F.size(F.array_distinct(F.split(t, ""))) == 1, "repeated_char")
        .when(t.rlike(f"^[{VOWEL_SIGNS}]+$"), "stacked_vowel_signs")
        .when(t.rlike(f"^[{NASAL_MARKS}]+$"), "stacked_nasal_marks")
        .when(t.rlike(f"[{VOWEL_SIGNS}{NASAL_MARKS}]"), "mixed_diacritics")
        .otherwise("other_multi_char")
    )


def code_point(token: str | Column) -> Column:
    """U+XXXX of the first sign."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(token)), 4, "0"))


def failure_report(log: DataFrame) -> DataFrame:
    """By token: count, class, code point, length and the counts by source as 'source=n' in order of name."""
    each = log.where("token IS NOT NULL AND token <> ''").groupBy("token", "source").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(x["source"], F.lit("="), x["n"].cast("string"))), ",")
    return each.groupBy("token").agg(F.sum("n").alias("n"), listed.alias("by_source")).select("token", "n", failure_class("token").alias("class"), code_point("token").alias("code"), F.length("token").alias("size"), "by_source")


def component_analysis(log: DataFrame) -> DataFrame:
    """For each sign of tokens of more than one sign, in how many failures it stands."""
    counts = log.where("length(token) > 1").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("n", F.explode(F.array_distinct(F.split("token", ""))).alias("sign")).where("sign <> ''").groupBy("sign").agg(F.sum("n").alias("n")).withColumn("code", code_point("sign"))
