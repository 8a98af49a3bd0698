"""Files on whatever file system Spark reaches."""

from __future__ import annotations

import fnmatch
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """The files of a folder whose names fit, in order of name; none for a folder that isn't there."""
    fs, place = _at(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(place) if s.isFile() and fnmatch.fnmatchcase(s.getPath().getName(), pattern))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path with wildcards names, in order."""
    fs, place = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(place) or [] if s.isFile())


def renamed(spark: SparkSession, old: str, new: str) -> None:
    fs, place = _at(spark, old)
    if not fs.rename(place, _at(spark, new)[1]):
        raise OSError(f"{old} can't be renamed to {new}")


def removed(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def _system(path: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file to read from inside a task, as a stream; for any file system that Arrow knows."""
    system, inner = _system(path)
    return system.open_input_file(inner)


def created(path: str):
    """A file to write from inside a task, as a stream."""
    system, inner = _system(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def mounted(path: str) -> str:
    """A path of a mounted file system without its scheme."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} is not mounted")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
