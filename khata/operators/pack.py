"""Hash tokens, fixed-length sequences of them, and audits of the packed shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.text import words
from khata.operators.ordered import prefix_sum

#: Ids: how many are reserved, how many there are, and the end-of-text one.
RESERVED, VOCABULARY, EOS, PAD = 146, 48_000, 3, 0
LENGTH = 2048


def hash_id(word: Column) -> Column:
    """The id of a word, from its MD5."""
    return (F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), F.lit(VOCABULARY - RESERVED)) + RESERVED).cast("int")


def token_ids(text: str | Column, end: bool = True) -> Column:
    """The ids of a text's words, with the end-of-text id."""
    ids = F.transform(words(text), hash_id)
    return F.concat(ids, F.array(F.lit(EOS))) if end else ids


def packed(docs: DataFrame, ids: str | Column, order: str, length: int = LENGTH, per_shard: int = 100_000, size: Column | None = None) -> DataFrame:
    """(shard, seq, input_ids): all ids in order cut into sequences of `length`; the tail is discarded.

    Only slices of the documents' arrays are shuffled, one for each sequence that a
    document reaches into. Null and empty arrays add nothing. `size`, how many ids a
    document has, keeps the sums of lengths from making the ids a second time.
    """
    made = F.col(ids) if isinstance(ids, str) else ids
    at = prefix_sum(docs.select(order, F.coalesce(F.size(made) if size is None else size, F.lit(0)).alias("n")).where("n > 0"), "n", order, "start").select(order, "start")
    own = docs.select(order, made.alias("ids")).join(at, order).withColumn("n", F.size("ids"))
    first, last = F.expr(f"start div {length}"), F.expr(f"(start + n - 1) div {length}")
    pieces = own.select("start", "n", "ids", F.explode(F.sequence(first, last)).alias("seq"))
    begin = F.greatest(F.expr(f"seq * {length} - start"), F.lit(0))
    end = F.least(F.expr(f"(seq + 1) * {length} - start"), F.col("n").cast("bigint"))
    pieces = pieces.select("seq", F.col("start").alias("_s"), F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    joined = pieces.groupBy("seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_s", "part"))), lambda x: x["part"])).alias("input_ids"))
    return joined.where(F.size("input_ids") == length).select(F.expr(f"cast(seq div {per_shard} as int)").alias("shard"), F.expr(f"cast(seq % {per_shard} as int)").alias("seq"), "input_ids")


def shard_audit(seqs: DataFrame, length: int = LENGTH, vocabulary: int = VOCABULARY) -> DataFrame:
    """By shard: sequences, least and greatest id, ids out of range, and whether all have the length."""
    return seqs.groupBy("shard").agg(
        F.count(F.lit(1)).alias("seqs"),
        F.min(F.array_min("input_ids")).alias("min_id"),
        F.max(F.array_max("input_ids")).alias("max_id"),
        F.sum(F.size(F.filter("input_ids", lambda x: (x < 0) | (x >= vocabulary)))).alias("out_of_range"),
        F.bool_and(F.size("input_ids") == length).alias("valid_shape"),
    )


def densities(seqs: DataFrame) -> DataFrame:
    """Of each sequence the ends of text, and the padding."""
    count = lambda value: F.size(F.filter("input_ids", lambda x: x == value))
    return seqs.select("shard", "seq", count(EOS).alias("n_eos"), count(PAD).alias("n_pad"))


def padding_ratio(seqs: DataFrame) -> DataFrame:
    """By shard the share of padding among all ids."""
    pads = F.size(F.filter("input_ids", lambda x: x == PAD))
    return seqs.groupBy("shard").agg((F.sum(pads).cast("double") / F.sum(F.size("input_ids"))).alias("padding"))


def segment_lengths(seqs: DataFrame) -> DataFrame:
    """(shard, seq, segment, length): ids before each end of text since the one before; what follows the last one and empty segments are left out."""
    ends = seqs.select("shard", "seq", F.transform(F.filter(F.transform("input_ids", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] == EOS), lambda s: s["i"]).alias("ends"))
    each = ends.select("shard", "seq", F.posexplode(F.transform("ends", lambda e, k: e - F.when(k > 0, F.get("ends", k - 1)).otherwise(F.lit(-1)) - 1)).alias("segment", "length"))
    return each.where("length > 0")


def token_counts(seqs: DataFrame, by: list[str]) -> DataFrame:
    return seqs.select(*by, F.explode("input_ids").alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """Shannon entropy in bits of the token distribution."""
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    share = F.col("n").cast("double") / F.col("total")
    return counts.join(total, by).groupBy(*by).agg((-F.sum(share * F.log2(share))).alias("bits"))


def coverage(counts: DataFrame, by: list[str], vocabulary: int = VOCABULARY) -> DataFrame:
    return counts.groupBy(*by).agg((F.countDistinct("token").cast("double") / vocabulary * 100).alias("pct"))


def top_tokens(counts: DataFrame, by: list[str], n: int = 50) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def zipf(counts: DataFrame) -> DataFrame:
    """(n, first_rank, tokens): ranks by falling count, tokens of equal count together, so that no window holds the vocabulary."""
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return by.withColumn("first_rank", F.coalesce(F.sum("tokens").over(above), F.lit(0)) + 1)
