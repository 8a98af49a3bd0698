"""Members of archives as lines, read as streams."""

from __future__ import annotations

import hashlib
import io
import shutil
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from khata.sources import places

#: Signs in one batch of a member, about.
TOGETHER = 4 << 20


def _members(path: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """The members one after another; a tar of any compression is a stream, so memory doesn't follow its size."""
    with places.opened(path) as f:
        if path.endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                for name in z.namelist():
                    if not name.endswith("/"):
                        yield name, z.open(name)
        else:
            with tarfile.open(fileobj=f, mode="r|*") as t:
                for m in t:
                    if m.isfile():
                        yield m.name, t.extractfile(m)


def _lines(member: io.BufferedIOBase) -> Iterator[bytes]:
    """The lines of a member, without their line feeds; an open last line counts."""
    rest = b""
    while chunk := member.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def write_archives(files: DataFrame, folder: str, member: str = "lines.jsonl") -> DataFrame:
    """(archive): each file (path, length) as the one member of an archive of its own in `folder`, tar.bz2 and zip by turns of `path`'s hash; copied as a stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = hashlib.md5(path.encode()).hexdigest()
                name = f"{folder}/{key}" + (".zip" if int(key[0], 16) % 2 else ".tar.bz2")
                with places.opened(path) as f, places.created(name) as to:
                    if name.endswith(".zip"):
                        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w") as m:
                            shutil.copyfileobj(f, m, 1 << 20)
                    else:
                        with tarfile.open(fileobj=to, mode="w|bz2") as t:
                            info = tarfile.TarInfo(member)
                            info.size = length
                            t.addfile(info, f)
                out.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["archive"])

    return files.select("path", "length").mapInArrow(pack, "archive STRING")


def read_lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, line_no, value) from the members, ending in `suffix`, of tar (any compression) and zip files; one task reads one archive, as a stream."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for name, member in _members(archive):
                    if not name.endswith(suffix):
                        continue
                    rows: list[tuple] = []
                    size = 0
                    for k, raw in enumerate(_lines(member)):
                        rows.append((archive, name, k, raw.decode("utf-8", "replace")))
                        size += len(raw)
                        if size >= TOGETHER:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(lines, "archive STRING, member STRING, line_no BIGINT, value STRING")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["archive", "member", "line_no", "value"])
