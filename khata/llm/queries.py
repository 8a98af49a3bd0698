"""The pN_ queries, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from khata.llm import copies, garble, glyphs, langid, leaks, packing, quality, tokens
from khata.plans.common import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    model = langid.train(table(spark, folder, "lang_samples"))
    return langid.mislabelled(table(spark, folder, "documents"), model).select("doc_id", "lang")


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    model = langid.train(table(spark, folder, "lang_samples"))
    return langid.segments(table(spark, folder, "documents"), model)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.same_looking_pairs(table(spark, folder, "documents"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.same_looking_classes(table(spark, folder, "documents"))


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.canonical_texts(table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(table(spark, folder, "documents"))


def p3_stats(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_stats(table(spark, folder, "documents"))


def _held_out(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sentnob").where("split in ('validation', 'test')")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), _held_out(spark, folder))


def p4_alignments(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.alignments(table(spark, folder, "documents"), _held_out(spark, folder))


def p5_doc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.labelled_counts(table(spark, folder, "documents"), table(spark, folder, "sources"))


def p5_budget(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_budget(table(spark, folder, "documents"), table(spark, folder, "sources"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.hidden_copies(table(spark, folder, "documents"), table(spark, folder, "raw_lines")).select("tab", "keep_id", "copy_id")


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapsed(table(spark, folder, "documents"))


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapsed_records(table(spark, folder, "documents"), table(spark, folder, "raw_lines"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return garble.garbled(table(spark, folder, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garble.garbled(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_segments, p2_found, p2_classes, p2_canonical, p3_found, p3_stats, p4_found, p4_alignments, p5_budget, p5_doc_tokens, p6_found, p6_collapsed, p6_records, p7_ids, p8_packed, p9_found, p9_restored)
    }


#: A value without white space, punctuation and letter case.
_CANONICAL = r"lower(regexp_replace({}, '[\p{{P}}\p{{Z}}\t-\r\x1c-\x20\x{{85}}]+', '', 'g'))"
_JSON = "CASE WHEN json_valid(raw) AND regexp_matches(raw, '^\\s*\\{{') THEN raw->>'{}' END"


def oracle_sql() -> dict[str, str]:
    text, source = _CANONICAL.format("text"), _CANONICAL.format("source")
    of_docs = f"SELECT 'documents' AS tab, doc_id AS id, {text} AS t, {source} AS s FROM documents"
    read = f"SELECT line_id, {_JSON.format('text')} AS text, {_JSON.format('source')} AS source FROM raw_lines"
    of_lines = f"SELECT 'raw_lines' AS tab, line_id AS id, {text} AS t, {source} AS s FROM ({read})"
    kept = f"SELECT *, min(id) OVER (PARTITION BY tab, t, s) AS keep_id FROM ({of_docs} UNION ALL {of_lines}) WHERE t <> ''"
    return {
        "p6_found": f"SELECT tab, keep_id, id AS copy_id FROM ({kept}) WHERE id <> keep_id",
        "p6_collapsed": f"SELECT min(id) AS doc_id, count(*) AS n_copies FROM ({of_docs}) WHERE t <> '' GROUP BY t, s",
        "p6_records": f"SELECT tab, min(id) AS keep_id, count(*) AS n_copies FROM ({of_docs} UNION ALL {of_lines}) WHERE t <> '' GROUP BY tab, t, s",
    }
