"""Queries that run a stream over a table's file to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.plans.common import Registry, table
from khata.session import scratch
from khata.streaming import ingest

R = Registry()


def _place(spark) -> str:
    return scratch(spark, "stream")


def _stream(spark, folder, name):
    """The table as a stream: a folder of files or one file, by its name."""
    return ingest.file_stream(spark, f"{folder}/{name}.parque[t]", table(spark, folder, name).schema)


def _run(spark, stream):
    place = _place(spark)
    ingest.append(stream, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@R.add("SELECT log_id, token, source FROM failure_log")
def stream_append(spark, folder):
    return _run(spark, _stream(spark, folder, "failure_log").select("log_id", "token", "source"))


@R.add("SELECT DISTINCT md5(text) AS h FROM documents WHERE text IS NOT NULL")
def stream_first_seen(spark, folder):
    own = _stream(spark, folder, "documents").where("text IS NOT NULL").select(F.md5("text").alias("h"))
    return _run(spark, ingest.first_seen(own, "h"))


@R.add("SELECT source, log_id, position FROM (SELECT *, coalesce(sum(coalesce(position, 0)) OVER (PARTITION BY source ORDER BY log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM failure_log) WHERE b < 5000")
def stream_budget(spark, folder):
    return _run(spark, ingest.within_budget(_stream(spark, folder, "failure_log"), "source", "position", "log_id", 5000))


@R.add("SELECT run_id, task, accuracy, macro_f1 FROM run_results")
def stream_metric_rows(spark, folder):
    """Metric rows appended by a stream, then by a second run that finds nothing new."""
    place = _place(spark)
    for _ in range(2):
        ingest.into_table(_stream(spark, folder, "run_results").select("run_id", "task", "accuracy", "macro_f1"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")
