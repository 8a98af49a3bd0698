"""Tables and reports as files."""

from __future__ import annotations

import datetime
import glob
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from khata.functions.text import collapse
from khata.session import drop, scratch
from khata.sources import places


def existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The sources whose path is there, on whatever file system."""
    return {k: p for k, p in paths.items() if places.exists(spark, p)}


def prioritised_union(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of frames, each with its place as `priority`; missing columns are null."""
    out = None
    for k, df in enumerate(frames):
        own = df.withColumn("priority", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out


def until_met(sources: list[Callable[[], DataFrame]], weight: str | Column, order: str, budget: int) -> DataFrame:
    """The rows of the first sources until `budget` is used, the last row may overshoot; with the source's place as `priority`.

    A source is opened only if those before it don't suffice; one that can't be opened
    is passed over. Each source that is taken is summed once, and only the last one is
    cut. A budget of 0 takes all.
    """
    from khata.operators.ordered import greedy_budget

    frames: list[DataFrame] = []
    used = 0
    for open_ in sources:
        if budget and used >= budget:
            break
        try:
            df = open_()
            own = df.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")).first()[0]
        except AnalysisException:
            continue
        if budget and used + own >= budget:
            df = greedy_budget(df, weight, order, budget - used)
        used += own
        frames.append(df)
    return prioritised_union(frames)


def write_jsonl(df: DataFrame, path: str, append: bool = False, stamped: bool = False) -> None:
    """JSON lines, null fields kept; `stamped` adds the time of writing."""
    own = df.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")) if stamped else df
    own.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet_shards(df: DataFrame, path: str, rows: int = 250_000, group_rows: int = 50_000, stem: str = "data") -> list[str]:
    """Parquet files of at most `rows` rows in zstd row groups of `group_rows`, named {stem}_shard_0000.parquet and so on.

    They are written beside `path` and take their names at the end, so a run that fails
    leaves no shard. Their paths.
    """
    spark = df.sparkSession
    passing = scratch(spark, "shards")
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").option("parquet.block.row.count.limit", group_rows).parquet(passing)
    fs, place = places._at(spark, path)
    fs.mkdirs(place)
    for old in places.listed(spark, path, f"{stem}_shard_*.parquet"):
        places.removed(spark, old)
    out = []
    for k, old in enumerate(places.listed(spark, passing, "part-*.parquet")):
        out.append(f"{path.rstrip('/')}/{stem}_shard_{k:04d}.parquet")
        places.renamed(spark, old, out[-1])
    drop(spark, passing)
    return out


def write_if_any(df: DataFrame, path: str) -> bool:
    """Writes a side output and deletes it again if it has no rows; the plan runs once."""
    seen = Observation()
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    if seen.get["n"]:
        return True
    drop(df.sparkSession, path)
    return False


def write_or_count(df: DataFrame, path: str, dry: bool = False) -> dict[str, int]:
    """Writes JSON lines and counts them and their words (column word_count, if there is one); `dry` only counts."""
    words = F.sum("word_count") if "word_count" in df.columns else F.lit(None)
    if dry:
        row = df.agg(F.count(F.lit(1)).alias("docs"), words.alias("words")).first()
        return {"docs": row["docs"], "words": row["words"] or 0}
    seen = Observation()
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("docs"), words.alias("words")), path)
    return {"docs": seen.get["docs"], "words": seen.get["words"] or 0}


def concatenated(spark: SparkSession, paths: list[str], out: str, remove: bool = False) -> None:
    """Line files written as one table in their order; `remove` deletes them once that is done."""
    prioritised_union([spark.read.text(p) for p in paths]).select("value").write.mode("overwrite").text(out)
    for p in paths if remove else ():
        places.removed(spark, p)


def write_lines(df: DataFrame, path: str, text: str = "text") -> None:
    """One document a line."""
    df.where(F.col(text).isNotNull()).select(collapse(text).alias("value")).write.mode("overwrite").text(path)


def line_count(spark: SparkSession, path: str) -> int:
    """The line feeds in files: lines as Spark splits them, less the files whose last line is open."""

    def open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size:
                    with places.opened(name) as f:
                        f.seek(size - 1)
                        n += f.read(1) != b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    lines = spark.read.option("lineSep", "\n").text(path).count()
    ends = spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(open_ends, "n BIGINT").agg(F.sum("n")).first()[0]
    return lines - (ends or 0)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric CSVs with a header, looked for in all folders below `path`; an empty cell is null."""
    return spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)


def append_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both logs under the union of their headers, old columns first."""
    return old.unionByName(new, allowMissingColumns=True)


def guessed_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """The wanted columns under their names, each from the first candidate (in any case) that the table has."""
    have = {c.lower().strip(): c for c in df.columns}
    found = {}
    for name, candidates in wanted.items():
        match = next((have[c.lower()] for c in candidates if c.lower() in have), None)
        if match is None:
            raise ValueError(f"no column for {name!r}; the table has {', '.join(df.columns)}")
        found[name] = match
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in found.items()))


def split_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Files named after a split; dev and val mean validation."""
    names = {"train": "train", "test": "test", "dev": "validation", "val": "validation", "valid": "validation", "validation": "validation"}
    out: dict[str, str] = {}
    for path in places.listed(spark, folder):
        stem = path.rsplit("/", 1)[-1].split(".")[0].lower()
        for key, split in names.items():
            if stem == key or stem.endswith(f"_{key}"):
                out.setdefault(split, path)
    return out


def read_report(path: str, *fallbacks: str) -> dict | None:
    """A JSON or YAML report of the driver's own disk; where it isn't there, the last by name of the first fallback pattern that names any; else None."""
    if not os.path.exists(path):
        found = next((sorted(many) for pattern in fallbacks if (many := glob.glob(pattern, recursive=True))), None)
        if not found:
            return None
        path = found[-1]
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def report_rows(spark: SparkSession, report: dict[str, dict], name: str = "name") -> DataFrame:
    """A report's entries as rows: their keys as `name`, their fields as columns, null where an entry lacks one."""
    fields = list(dict.fromkeys(k for entry in report.values() for k in entry))
    rows = [(key, *(entry.get(f) for f in fields)) for key, entry in report.items()]
    return spark.createDataFrame(rows, [name, *fields], samplingRatio=1.0)


def stamped_name(folder: str, stem: str, ending: str = "yaml", now: datetime.datetime | None = None) -> str:
    """A report's path with the time in its name."""
    return os.path.join(folder, f"{stem}_{now or datetime.datetime.now():%Y%m%d_%H%M%S}.{ending}")


def write_report(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            yaml.safe_dump(report, f, allow_unicode=True, sort_keys=False)
        else:
            json.dump(report, f, ensure_ascii=False, indent=2)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small result as a Markdown table; what is missing shows as N/A."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return head + "".join("| " + " | ".join(str(r.get(c) if r.get(c) is not None else "N/A") for c in columns) + " |\n" for r in rows)
