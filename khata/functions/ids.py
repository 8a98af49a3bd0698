"""Small functions on ids, tags and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS = 2


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_bos(ids: str | Column, bos: int = BOS) -> Column:
    """The ids with the beginning-of-text id in front, unless it is there."""
    ids = _col(ids)
    return F.when(F.coalesce(F.get(ids, F.lit(0)) == bos, F.lit(False)), ids).otherwise(F.concat(F.array(F.lit(bos)), ids))


def truncated(ids: str | Column, most: int) -> Column:
    return F.slice(_col(ids), 1, most)


def plain_pieces(text: str | Column) -> Column:
    """Decoded pieces with their word marks as spaces, none in front."""
    return F.ltrim(F.replace(_col(text), F.lit("▁"), F.lit(" ")))


def unmasked(labels: Column, guesses: Column, ignore: int = -100) -> Column:
    """Pairs (label, guess) of the positions that count."""
    both = F.arrays_zip(labels.alias("label"), guesses.alias("guess"))
    return F.filter(both, lambda x: x["label"] != ignore)


def model_and_dataset(name: str | Column) -> Column:
    """(model, dataset) of 'model_dataset', split at the last underscore; a name without one is all model."""
    c = _col(name)
    split = c.contains("_")
    return F.struct(F.when(split, F.regexp_extract(c, "^(.*)_[^_]*$", 1)).otherwise(c).alias("model"), F.when(split, F.regexp_extract(c, "_([^_]*)$", 1)).alias("dataset"))


def tag_ids(tags: str | Column, names: list[str], other: str = "O") -> Column:
    """Numbers of tags by their place in `names`; a tag that isn't there counts as `other`."""
    table = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, k)))
    return F.transform(_col(tags), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(names.index(other))))


def tag_names(ids: str | Column, names: list[str], other: str = "O") -> Column:
    """Tags of numbers; a number out of range is `other`."""
    table = F.array(*map(F.lit, names))
    return F.transform(_col(ids), lambda k: F.coalesce(F.get(table, k), F.lit(other)))


def located(places: DataFrame, at: str, shards: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(at, shard, row) of global places, `shards` being (shard, start, stop) without overlap.

    Both sides are joined by blocks of `block` places, so the join has a key: a shard
    is in each block that it reaches into.
    """
    spread = shards.where("stop > start").withColumn("_block", F.explode(F.expr(f"sequence(cast(start div {block} as bigint), cast((stop - 1) div {block} as bigint))")))
    own = places.withColumn("_block", F.expr(f"cast(`{at}` div {block} as bigint)"))
    return own.join(spread, "_block").where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop"))).select(at, "shard", (F.col(at) - F.col("start")).alias("row"))


def contains_answer(given: str | Column, expected: str | Column) -> Column:
    """Whether an answer holds what was expected, in any case."""
    return F.contains(F.lower(F.trim(_col(given))), F.lower(F.trim(_col(expected))))
