"""One file from pieces in order, without their bytes in the driver.

Tasks write parts, each under a name of its own; the driver learns a name and a size for each. Then

- where files are written by place (``file:``), each task copies its ranges to their offsets in a file under another name, which is renamed at the end;
  a task that runs twice writes the same bytes, and ranges whose tasks don't see the file (a folder of the driver's machine alone) are copied by the driver;
- where the file system joins files itself (``concat``, HDFS), the parts are joined and renamed;
- else (object stores) the driver appends piece after piece, some megabytes at a time. ``write_parts`` avoids this.

The file is there as a whole or not at all in the first two; parts are removed in any case.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits
from .store import frame, remove, scratch

#: Bytes of a range that one task copies, and of one read.
RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20
RANGES = pa.schema([("uri", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("at", pa.int64())])


@dataclass(frozen=True)
class Piece:
    """A range of a file, or some few bytes."""

    uri: str = ""
    start: int = 0
    end: int = 0
    data: bytes = b""

    @property
    def size(self) -> int:
        return len(self.data) or self.end - self.start


class ByteStream:
    """A new file in whatever file system its path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        self.held, self.size = [], 0

    def write(self, data: bytes) -> None:
        """Some megabytes at a time go to the file."""
        self.held.append(data)
        self.size += len(data)
        if self.size >= READ_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write(bytearray(b"".join(self.held)))
        self.held, self.size = [], 0

    def close(self) -> None:
        try:
            self.flush()
        finally:
            self.out.close()


def read_range(uri: str, start: int, end: int) -> Iterator[bytes]:
    with splits.opened(uri) as file:
        file.seek(start)
        while start < end:
            data = file.read(min(READ_BYTES, end - start))
            if not data:
                raise OSError(f"{uri} ends at byte {start}, not {end}")
            yield data
            start += len(data)


def copy_range(uri: str, start: int, end: int, target: str, at: int) -> None:
    with open(target, "r+b") as out:
        out.seek(at)
        for data in read_range(uri, start, end):
            out.write(data)


def part_writer(folder: str, pack: Callable):
    """A partition's rows, packed into one column of bytes -> the part it wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = splits.system_of(folder)
        system.create_dir(where, recursive=True)
        name, size, out = f"part-{uuid.uuid4().hex}", 0, None
        try:
            for batch in pack(batches):
                for data in batch.column(0).to_pylist():
                    out = out or system.open_output_stream(f"{where}/{name}")
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        if size:
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([part, pa.array([name]), pa.array([size], pa.int64())], names=["part", "name", "size"])

    return run


def copier(target: str):
    """Ranges to their places in the target -> those whose task doesn't see it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = os.path.exists(target)
            if there:
                for r in batch.to_pylist():
                    copy_range(r["uri"], r["start"], r["end"], target, r["at"])
            yield batch.slice(0, 0 if there else batch.num_rows)

    return run


def place(spark: SparkSession, pieces: list[Piece], target: str) -> None:
    """Writes the pieces to a local path that all machines see: tasks copy ranges, the driver its few bytes."""
    ranges, at = [], 0
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as out:
        for p in pieces:
            if p.data:
                out.seek(at)
                out.write(p.data)
            elif p.size:
                ranges.append((p.uri, p.start, p.end, at))
            at += p.size
        out.truncate(at)
    if not ranges:
        return
    step = F.explode(F.sequence(F.lit(0), F.col("end") - F.col("start") - 1, F.lit(RANGE_BYTES))).alias("step")
    cut = frame(spark, ranges, RANGES).select("*", step).select("uri", (F.col("start") + F.col("step")).alias("start"), F.least("end", F.col("start") + F.col("step") + RANGE_BYTES).alias("end"), (F.col("at") + F.col("step")).alias("at"))
    tasks = min(10_000, at // RANGE_BYTES + len(ranges) // 100 + 1)
    for r in cut.repartition(tasks, "at").mapInArrow(copier(target), cut.schema).toLocalIterator():
        copy_range(r["uri"], r["start"], r["end"], target, r["at"])


def concatenated(spark: SparkSession, paths: list[str], target: str) -> bool:
    """Whether the file system joined the files, all of one folder, into the target."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    first = path(paths[0])
    system = first.getFileSystem(spark._jsc.hadoopConfiguration())
    rest = spark.sparkContext._gateway.new_array(path, len(paths) - 1)
    for i, p in enumerate(paths[1:]):
        rest[i] = path(p)
    try:
        system.concat(first, rest)
    except UnsupportedOperationException:
        return False
    system.delete(path(target), False)
    return system.rename(first, path(target))


def append(spark: SparkSession, pieces: list[Piece], path: str) -> None:
    out = ByteStream(spark, path)
    try:
        for p in pieces:
            for data in [p.data] if p.data else read_range(p.uri, p.start, p.end):
                out.write(data)
    finally:
        out.close()


def join(spark: SparkSession, pieces: list[Piece], path: str) -> None:
    """The pieces, one after another, as the file at path."""
    uri = splits.qualified(spark, path)
    if not uri.startswith("file:"):
        return append(spark, pieces, path)
    rough = f"{path}.{uuid.uuid4().hex}"
    try:
        place(spark, pieces, splits.system_of(splits.qualified(spark, rough))[1])
        where, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (rough, path))
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(to, False)  # its checksum too
        if not system.rename(where, to):
            raise OSError(f"can't rename {rough} to {path}")
    finally:
        remove(spark, rough)


def write_joined(rows: DataFrame, pack: Callable, path: str, head: bytes, tail: bytes) -> None:
    """head, the rows (partitions are in order, and so are their rows) as ``pack`` makes them bytes, tail. ``pack``: batches to batches of one column, data; it runs in the worker that writes."""
    spark = rows.sparkSession
    local = splits.qualified(spark, path).startswith("file:")
    folder = scratch(spark, "parts") if local else f"{path}.parts-{uuid.uuid4().hex}"
    uri = splits.qualified(spark, folder)
    if splits.system_of(uri) is None:
        out = ByteStream(spark, path)
        try:
            out.write(head)
            for r in rows.mapInArrow(pack, "data binary").toLocalIterator(prefetchPartitions=True):
                out.write(bytes(r[0]))
            out.write(tail)
        finally:
            out.close()
        return
    try:
        made = sorted(rows.mapInArrow(part_writer(uri, pack), "part int, name string, size long").collect())  # a row a task
        ends = [Piece(data=d) for d in (head, tail)]
        pieces = [ends[0], *(Piece(f"{uri}/{name}", 0, size) for _, name, size in made), ends[1]]
        if not local:
            names = [f"{folder}/{name}" for _, name, _ in made]
            for at, piece in ((0, ends[0]), (len(names) + 1, ends[1])):
                if piece.data:
                    append(spark, [piece], f"{folder}/end-{at}")
                    names.insert(at, f"{folder}/end-{at}")
            if len(names) > 1 and concatenated(spark, names, path):
                return
        join(spark, pieces, path)
    finally:
        remove(spark, folder)
