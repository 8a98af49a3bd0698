"""Exact deduplication across prioritised sources.

Digests travel, texts don't: the survivor of a digest is the least (priority, order)
by partial aggregation, and the rows are found again by their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.text import normalize_text
from khata.session import written


def digest(text: str | Column, normalized: bool) -> Column:
    """MD5 of a text as it is, or SHA-256 of its normalized form."""
    return F.sha2(normalize_text(text), 256) if normalized else F.md5(F.col(text) if isinstance(text, str) else text)


def marked(docs: DataFrame, key: Column, order: str = "doc_id", source: str = "source", priority: str = "priority") -> DataFrame:
    """(order, source, priority, kept, absorber): whether each row survives and the source that its digest survives in. Rows with a null key are left out."""
    own = written(docs.select(order, source, priority, key.alias("_h")).where("_h IS NOT NULL"), "digests")  # read twice
    first = own.groupBy("_h").agg(F.min(F.struct(priority, order, source)).alias("_first"))
    return own.join(first, "_h").select(order, source, priority, (F.col(order) == F.col(f"_first.{order}")).alias("kept"), F.col(f"_first.{source}").alias("absorber"))


def first_wins(docs: DataFrame, key: Column, order: str = "doc_id", priority: str = "priority") -> DataFrame:
    """One row of each digest: the one of least (priority, order). Rows with a null key are left out."""
    own = docs.select(order, priority, key.alias("_h")).where("_h IS NOT NULL")
    first = own.groupBy("_h").agg(F.min(F.struct(priority, order)).alias("_first"))
    return docs.join(first.select(F.col(f"_first.{order}").alias(order)), order, "left_semi")


def attribution(rows: DataFrame, source: str = "source") -> DataFrame:
    """By source: rows in, kept, dropped of its own, and dropped elsewhere because it holds the survivor."""
    own = rows.groupBy(source).agg(F.count(F.lit(1)).alias("rows_in"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    absorbed = rows.where(~F.col("kept")).groupBy(F.col("absorber").alias(source)).agg(F.count(F.lit(1)).alias("absorbed"))
    return own.join(absorbed, source, "left").select(source, "rows_in", "kept", "dropped", F.coalesce("absorbed", F.lit(0)).alias("absorbed"))


def against_base(increment: DataFrame, base: DataFrame, key: str = "h", order: str = "doc_id") -> DataFrame:
    """Adds `state` to the increment: 'empty' for a null key, 'base' for one that the base holds, 'self' for a repeat of an earlier row, else 'kept'. The base comes before a repeat."""
    known = base.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    # rows without a key get one of their own, so that they don't gather in one task
    own = increment.withColumn("_k", F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col(order).cast("string")))).join(known, "_k", "left")
    first = own.where(F.col("_known").isNull() & F.col(key).isNotNull()).groupBy("_k").agg(F.min(order).alias("_first"))
    state = F.when(F.col(key).isNull(), "empty").when(F.col("_known"), "base").when(F.col(order) > F.col("_first"), "self").otherwise("kept")
    return own.join(first, "_k", "left").withColumn("state", state).drop("_known", "_first", "_k")


def group_sizes(docs: DataFrame, key: Column) -> DataFrame:
    """Sizes of groups of equal digests: (copies, groups)."""
    return docs.select(key.alias("_h")).where("_h IS NOT NULL").groupBy("_h").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))


def summary(docs: DataFrame, key: Column) -> DataFrame:
    """One row: total, distinct, duplicates and their percentage."""
    sizes = group_sizes(docs, key)
    total = sizes.agg(F.coalesce(F.sum(F.col("copies") * F.col("groups")), F.lit(0)).alias("total"), F.coalesce(F.sum("groups"), F.lit(0)).alias("distinct_texts"))
    return total.select("total", "distinct_texts", (F.col("total") - F.col("distinct_texts")).alias("duplicates"), (F.lit(100.0) * (F.col("total") - F.col("distinct_texts")) / F.greatest("total", F.lit(1))).alias("pct"))


def ranked(df: DataFrame, within: list[str], order: list[Column]) -> DataFrame:
    """Adds `rank` from 1 within groups."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
