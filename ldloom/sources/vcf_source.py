"""``spark.read.format("vcf")``: a data source with partitions of its own, which are byte ranges of plain and block-gzip files.

``build_index`` runs over the file once and stores a zone map beside it: for each range how many data lines it has, and for each chromosome the least and the greatest
position in it. With it the source leaves out ranges that a filter on chrom or pos can't meet, whatever the file's order, and row_idx is
a line's number among the data lines. Without it all ranges are read, and row_idx only grows with the file. Spark applies every filter again, so what is left out is
only what can't pass.

Options: path (one file), samples, mode (FAILFAST, DROPMALFORMED), dosageField, splitBytes, index (a path).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import splits
from .decode import FIXED, VcfError, decoder

SCHEMA = "row_idx long, chrom string, pos int, id string, ref string, alt string, info_af double, af double, has_ds boolean, ds array<double>"
#: Bytes of small ranges that one task of ``build_index`` looks at.
TASK_BYTES = 1 << 20
ZONES = "start long, stop long, n long, zones array<struct<chrom: string, low: int, high: int>>"


def data_lines(kind: str, uri: str, start: int, end: int) -> Iterator[pa.Array]:
    """Lines of a range that are neither empty nor header."""
    for data in splits.lines_of(kind, uri, start, end):
        lines = splits.line_array(data)
        yield lines.filter(pc.and_(pc.greater(pc.binary_length(lines), 0), pc.invert(pc.starts_with(lines, "#"))))


@dataclass
class Range(InputPartition):
    start: int
    end: int
    first: int


def zone_rows(kind: str, uri: str, size: int, most: int):
    """Numbers of ranges of ``most`` bytes -> their zones; a task knows no other range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for batch in batches for i in batch.column("id").to_pylist()):
            start, end = i * most, min(size, (i + 1) * most)
            n, zones = 0, {}
            for lines in data_lines(kind, uri, start, end):
                n += len(lines)
                fields = pc.split_pattern(lines, "\t", max_splits=2)
                if not len(lines) or pc.min(pc.list_value_length(fields)).as_py() < 2:
                    if len(lines):
                        raise VcfError(f"a line of {uri} has no position")
                    continue
                parts = pa.table({"chrom": pc.list_element(fields, 0), "pos": pc.list_element(fields, 1).cast(pa.int32())})
                for r in parts.group_by("chrom").aggregate([("pos", "min"), ("pos", "max")]).to_pylist():
                    low, high = zones.get(r["chrom"], (r["pos_min"], r["pos_max"]))
                    zones[r["chrom"]] = min(low, r["pos_min"]), max(high, r["pos_max"])
            told = [{"chrom": c, "low": low, "high": high} for c, (low, high) in sorted(zones.items())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("chrom", pa.string()), ("low", pa.int32()), ("high", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((start, end, n, told), kinds)], names=["start", "stop", "n", "zones"])

    return run


def build_index(spark: SparkSession, path: str, out: str = "", split_bytes: int = splits.SPLIT_BYTES) -> str:
    """Writes the zone map of a file, a row for each range, to ``out`` (the file's path and .zones); its path. The ranges are looked at in parallel."""
    uri, out = splits.qualified(spark, path), out or f"{path}.zones"
    if not (kind := splits.kind_of(uri)):
        raise VcfError(f"{path}: Arrow has no file system for it")
    with splits.opened(uri) as file:
        size = file.size()
    most = (size or 1) if kind == "gzip" else split_bytes
    n = -(-size // most)
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)))
    rows = spark.range(0, n, 1, tasks).mapInArrow(zone_rows(kind, uri, size, most), ZONES).orderBy("start").collect()  # a row for a range
    told = [{"start": r["start"], "end": r["stop"], "n": r["n"], "zones": [list(z) for z in r["zones"]]} for r in rows]
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(json.dumps({"size": size, "ranges": told}).encode()))
    finally:
        stream.close()
    return out


class VcfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        from .vcf import is_float, resolve_samples, split_text

        self.uri = local(options["path"])
        if not (kind := splits.kind_of(self.uri)):
            raise VcfError(f"{options['path']}: Arrow has no file system for it")
        self.kind, self.index = kind, options.get("index")
        self.split = int(options.get("splitbytes", options.get("splitBytes", splits.SPLIT_BYTES)))
        head = []
        for data in splits.lines_of(kind, self.uri, 0, 1 if kind == "block" else splits.CHUNK_BYTES):
            lines = [x.decode() for x in data.splitlines() if x.startswith(b"#")]
            head += lines
            if len(lines) < data.count(b"\n"):
                break
        named = [x for x in head if x.startswith("#CHROM")]
        if not named:
            raise VcfError(f"{options['path']}: no #CHROM line in the header's first block")
        samples = split_text(named[0], "\t")[FIXED:]
        field = options.get("dosagefield", options.get("dosageField", "DS"))
        ds = field == "GT" or is_float(head, "FORMAT", field)
        self.how = (["row_idx"], "value", len(samples), resolve_samples(samples, options.get("samples", "")), is_float(head, "INFO", "AF"), ds, field, True, options.get("mode", "FAILFAST"), True, True)
        self.chroms: set[str] | None = None
        self.low, self.high = -1, 1 << 31

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on chrom and pos narrow the ranges; all are left to Spark too."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("chrom",) and isinstance(f, EqualTo | In):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.chroms = wanted if self.chroms is None else self.chroms & wanted
            elif name == ("pos",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if name == ("pos",) and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.high = min(self.high, value - isinstance(f, LessThan))
            yield f

    def meets(self, zones: list) -> bool:
        return any((self.chroms is None or c in self.chroms) and high >= self.low and low <= self.high for c, low, high in zones)

    def partitions(self) -> list[Range]:
        with splits.opened(self.uri) as file:
            size = file.size()
        if not self.index:
            found = splits.ranges(self.uri, size, (size or 1) if self.kind == "gzip" else self.split)
            return [Range(s, e, i << 40) for i, (_, s, e) in enumerate(found)]
        with splits.opened(local(self.index)) as file:
            known = json.loads(file.read())
        if known["size"] != size:
            raise VcfError(f"the index is of another file: {known['size']} bytes, not {size}")
        first = np.concatenate([[0], np.cumsum([r["n"] for r in known["ranges"]])]).tolist()
        return [Range(r["start"], r["end"], n) for r, n in zip(known["ranges"], first) if r["n"] and self.meets(r["zones"])] or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end == 0:
            return
        at = partition.first

        def batches() -> Iterator[pa.RecordBatch]:
            nonlocal at
            for lines in data_lines(self.kind, self.uri, partition.start, partition.end):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(lines))), lines], names=["row_idx", "value"])
                at += len(lines)

        yield from decoder(*self.how)(batches())


def local(path: str) -> str:
    """A path as Arrow takes it."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


class VcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VcfReader:
        return VcfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("vcf") known to a session, with filters passed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VcfSource)
