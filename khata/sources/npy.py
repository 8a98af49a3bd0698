"""A data source for shards of packed sequences: .npy files of unsigned 16-bit matrices, in Arrow batches both ways."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "shard INT, seq INT, input_ids ARRAY<INT>"
#: Ids in one batch that is read.
TOGETHER = 1 << 20


class Shard(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


def shard_files(folder: str) -> list[str]:
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".npy"))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("max_shards", 0))

    def partitions(self) -> list[Shard]:
        files = shard_files(self.folder)
        return [Shard(k, p) for k, p in enumerate(files[: self.most] if self.most else files)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        whole = np.load(partition.path, mmap_mode="r")
        step = max(1, TOGETHER // max(1, whole.shape[1]))
        for at in range(0, len(whole), step):
            part = whole[at : at + step].astype(np.int32)
            offsets = np.arange(len(part) + 1, dtype=np.int32) * whole.shape[1]
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), partition.number, np.int32)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), ids], names=["shard", "seq", "input_ids"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class Open:
    """A shard while it is written: its ids go to a raw file as they come, only the sequence numbers are held."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, f".{uuid.uuid4().hex}.raw")
        self.out = open(self.path, "wb")
        self.seqs: list[np.ndarray] = []
        self.width: int | None = None

    def add(self, seqs: np.ndarray, ids: np.ndarray) -> None:
        width = ids.shape[1]
        if self.width not in (None, width):
            raise ValueError(f"sequences of {self.width} and of {width} ids in one shard")
        if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
            raise ValueError("an id is no unsigned 16-bit number")
        self.width = width
        self.seqs.append(seqs)
        self.out.write(ids.astype("<u2").tobytes())

    def close(self) -> str:
        """The finished file under a passing name, its rows in order of seq."""
        self.out.close()
        order = np.argsort(np.concatenate(self.seqs), kind="stable")
        passing = self.path.removesuffix(".raw") + ".tmp"
        with open(passing, "wb") as out:
            np.lib.format.write_array_header_1_0(out, {"descr": "<u2", "fortran_order": False, "shape": (len(order), self.width)})
            if (np.diff(order) == 1).all():
                with open(self.path, "rb") as raw:
                    shutil.copyfileobj(raw, out, 1 << 20)
            else:
                raw = np.memmap(self.path, "<u2", "r", shape=(len(order), self.width))
                for at in range(0, len(order), 4096):
                    out.write(raw[order[at : at + 4096]].tobytes())
        os.remove(self.path)
        return passing


class Writer(DataSourceArrowWriter):
    """One file for each shard number of a task, written under a passing name and renamed when all tasks are done; a shard that two tasks wrote is an error."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.stem = options["path"], options.get("stem", "shard")
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        by: dict[int, Open] = {}
        for batch in batches:
            shards, seqs = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("shard", "seq"))
            lists = batch.column(batch.schema.get_field_index("input_ids"))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for number in np.unique(shards):
                at = np.flatnonzero(shards == number)
                width = int(sizes[at[0]])
                if (sizes[at] != width).any():
                    raise ValueError("sequences of one shard have different lengths")
                ids = flat[(starts[at][:, None] + np.arange(width)).ravel()].reshape(len(at), width)
                by.setdefault(int(number), Open(self.folder)).add(seqs[at], ids)
        return Written([(open_.close(), number, f"{self.stem}_{number:05d}.npy") for number, open_ in by.items()])

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for _, _, name in files]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            self.abort(messages)
            raise ValueError(f"written by more than one task (partition by shard first): {', '.join(twice)}")
        for passing, _, name in files:
            os.replace(passing, os.path.join(self.folder, name))
        if self.overwrite:
            for old in shard_files(self.folder):
                if os.path.basename(old) not in names:
                    os.remove(old)

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            for passing, _, _ in message.files if message else ():
                if os.path.exists(passing):
                    os.remove(passing)


class NpyShards(DataSource):
    """spark.read.format("npy_shards").load(folder); rows are to be partitioned by shard before writing."""

    @classmethod
    def name(cls) -> str:
        return "npy_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyShards)
