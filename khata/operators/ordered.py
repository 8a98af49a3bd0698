"""Operators that depend on an order: prefix sums, budgets, quantiles by index, interleaving, permutations.

No window ever holds a whole table: ordered prefix sums go by buckets of the order
(range of `order`), whose totals are summed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in one bucket of a prefix sum, about.
BUCKET = 50_000


def bucket_of(df: DataFrame, order: str, rows: int = BUCKET) -> Column:
    """The bucket of each row's `order`, a number: equal spans between the least and the greatest, as many as give about `rows` rows each. Takes one pass over that column."""
    seen = df.agg(F.min(order).cast("double").alias("a"), F.max(order).cast("double").alias("b"), F.count(order).alias("n")).first()
    low, high = seen["a"] or 0.0, seen["b"] or 0.0
    width = (high - low) / max(1, -(-seen["n"] // rows)) or 1.0
    return F.floor((F.col(order).cast("double") - F.lit(low)) / F.lit(width))


def prefix_sum(df: DataFrame, weight: str | Column, order: str, name: str, within: list[str] | None = None, bucket: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Adds `name`: the sum of `weight` over the rows before each row in `order`, a number, within groups; `ties` orders equal ones.

    Null weights count as 0. Two shuffles: one of bucket totals, one by bucket. Buckets
    follow the order's range and number of rows (dense ids, hashes and fractions alike),
    unless `bucket` says the span of each.
    """
    keys = within or []
    own = df.withColumn("_w", F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0)).cast("bigint")).withColumn("_b", bucket_of(df, order) if bucket is None else F.floor(F.col(order) / bucket))
    totals = own.groupBy(*keys, "_b").agg(F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    local = Window.partitionBy(*keys, "_b").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    inside = own.withColumn("_l", F.coalesce(F.sum("_w").over(local), F.lit(0)))
    same = [inside[k].eqNullSafe(offsets[k]) for k in [*keys, "_b"]]
    joined = inside.join(offsets, _all(same))
    for k in [*keys, "_b"]:
        joined = joined.drop(offsets[k])
    return joined.withColumn(name, F.col("_o") + F.col("_l")).drop("_w", "_b", "_o", "_l")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def greedy_budget(df: DataFrame, weight: str | Column, order: str, budget: int | Column, within: list[str] | None = None) -> DataFrame:
    """The rows before which less than `budget` has been used; the last one may overshoot. A budget of 0 or null is no limit."""
    limit = F.lit(budget) if not isinstance(budget, Column) else budget
    summed = prefix_sum(df, weight, order, "_before", within)
    return summed.where((F.coalesce(limit, F.lit(0)) == 0) | (F.col("_before") < limit)).drop("_before")


def index_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at index floor(n x share) of the sorted values; null for no rows.

    Works on the value counts, so only distinct values are sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(every))
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * F.lit(s)), F.col("total") - 1), F.col("v"))).alias(name) for name, s in shares.items()]
    return ranked.agg(*picks)


def interleaved(df: DataFrame, order: str, stream: str) -> DataFrame:
    """Adds `place`: rows of each stream in their order, streams mixed in proportion to their lengths."""
    numbered = prefix_sum(df, F.lit(1), order, "_i", [stream])
    sizes = df.groupBy(stream).agg(F.count(F.lit(1)).alias("_n"))
    return numbered.join(sizes, stream).withColumn("place", (F.col("_i") + F.lit(0.5)) / F.col("_n")).drop("_i", "_n")


def permuted(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds `shuffle_key`: sorting by it (and `key`) gives the permutation of an epoch, the same on every run."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string"))))


def hash_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds `split`: 'test' for about `share` of the keys, 'train' for the rest, by hash."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("split", F.when(number < int(share * 2**32), "test").otherwise("train"))


def first_rows(df: DataFrame, n: int, order: list[Column | str], within: list[str] | None = None) -> DataFrame:
    """The first `n` rows, of each group where groups are named."""
    if not within:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
