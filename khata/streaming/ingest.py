"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """The files of a folder as they come; `files` at most in a batch."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def append(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Appends what is new since the last run and ends; the checkpoint takes the place of counting rows to skip."""
    return stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key. Its state grows with the keys unless an event time and a delay bound it, which lets repeats through after the delay."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], length: str, delay: str, slide: str | None = None) -> DataFrame:
    """Rows by window of event time and `by`; rows later than `delay` are left out."""
    window = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    return stream.withWatermark(event_time, delay).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def within_budget(stream: DataFrame, group: str, weight: str, order: str, budget: int) -> DataFrame:
    """(group, order, weight): rows of each group until `budget` is used, in arrival order of batches and by `order` within one; the last row may overshoot. Weights are not negative; rows of weight 0 after the budget is met are left out."""
    schema = stream.select(group, order, weight).schema

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        held: pd.DataFrame | None = None
        total = 0
        for frame in frames:
            own = frame[weight].fillna(0).astype("int64")
            total += int(own.sum())
            rows = frame.assign(_w=own) if held is None else pd.concat([held, frame.assign(_w=own)])
            rows = rows.sort_values(order, kind="stable")
            # rows beyond the budget can only move further back, so what is held is bounded by the budget
            held = rows.loc[used + rows["_w"].cumsum() - rows["_w"] < budget]
        state.update((used + total,))
        if held is not None:
            yield held[[group, order, weight]]

    return stream.select(group, order, weight).groupBy(group).applyInPandasWithState(keep, schema, "used BIGINT", "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends metric rows batch by batch, each batch a partition of its own (`batch`), so that one that comes again takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
