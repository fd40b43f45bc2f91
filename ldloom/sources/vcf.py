"""VCF text in: plain, gzip or block gzip.

A file is read as lines; the header's last line gives the samples, header declarations say whether AF and DS may be used. Plain files are split by
Spark's text reader, block gzip by ``splits``; a single gzip stream is one task. Row order is line order: lines are numbered per split, and only the counts of the
splits are put in order. Lines become columns in ``decode``, once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.variants import BITS, rows_in
from . import splits
from .decode import FIXED, VcfError, decode
from .store import frame

RAW = "row_idx long, chrom string, pos int, id string, ref string, alt string, info_af double, ds array<float>"
LINES = "_file string, _start long, _seq long, value string"
OFFSETS = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("_shift", pa.int64())])
RANGES = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
#: Ranges are dealt to so many tasks at most.
TASKS = 10_000


def split_text(text: str, delimiter: str) -> list[str]:
    """Parts of a text; empty ones inside stay, one at the end goes."""
    parts = text.split(delimiter)
    return parts[:-1] if parts and parts[-1] == "" else parts


def header_lines(spark: SparkSession, path: str) -> list[str]:
    """A file is read up to its first data line; a folder of parts is searched for lines that start with #."""
    file = splits.opened(uri := splits.qualified(spark, path))
    if file is None:
        return [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).toLocalIterator()]
    file.close()
    out = []
    with pa.input_stream(splits.opened(uri), compression="gzip" if re.search(r"\.b?gz$", path) else None) as text:
        rest = b""
        while data := text.read(1 << 16):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                if not line.startswith(b"#"):
                    return out
                out.append(line.decode().rstrip("\r"))
    return out


def read_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(sample names, header lines)."""
    lines = header_lines(spark, path)
    named = [x for x in lines if x.startswith("#CHROM")]
    if not named:
        raise VcfError(f"{path}: no #CHROM line")
    samples = split_text(named[0], "\t")[FIXED:]
    if not samples:
        raise VcfError(f"{path}: no samples")
    return samples, lines


def resolve_samples(header: list[str], wanted: str = "") -> list[int]:
    """Positions of the wanted names in the order asked, repeats included; unknown names are left out; no names: all."""
    if not wanted.strip(" \t"):
        return list(range(len(header)))
    place = {name: i for i, name in enumerate(header)}
    found = [place[n] for n in (x.strip(" \t") for x in split_text(wanted, ",")) if n in place]
    if not found:
        raise VcfError("none of the samples asked for is in the file")
    return found


def is_float(lines: list[str], kind: str, name: str) -> bool:
    """Whether a field is declared Float; an undeclared or otherwise declared one counts as absent."""
    return any(re.match(rf"##{kind}=<(?=.*\bID={name}[,>])(?=.*\bType=Float[,>])", x) for x in lines)


def parse_lines(lines: DataFrame, n_samples: int | None = None, af: bool = True, ds: bool = True, value: str = "value", dosage_field: str = "DS") -> DataFrame:
    """The raw columns of data lines; other columns of ``lines`` stay. A DS with several values gives its first. With
    ``dosage_field="GT"`` dosages are counted from genotypes instead. A line with fewer fields has nulls for them."""
    return decode(lines, n_samples, af=af, ds=ds, field=dosage_field, value=value)


def _packed_lines(groups: list[list[tuple[str, int, int]]], count: bool):
    """A partition's ranges of block-gzip files -> their lines, or how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, end in (r for i in batch.column("id").to_pylist() for r in groups[i]):
                n = 0
                for data in splits.whole_lines(uri, start, end):
                    lines = splits.line_array(data)
                    if not count:
                        columns = [pa.array([uri] * len(lines)), pa.array([start] * len(lines)), pa.array(range(n, n + len(lines)), pa.int64()), lines]
                        yield pa.RecordBatch.from_arrays(columns, names=["_file", "_start", "_seq", "value"])
                    n += len(lines)
                if count and n:
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([start]), pa.array([n], pa.int64()), pa.array([0], pa.int64())], names=["_file", "_start", "n", "first"])

    return run


def packed_lines(spark: SparkSession, files: list[str], count: bool = False) -> DataFrame:
    """Lines of block-gzip files by byte range, a task for about ``SPLIT_BYTES`` of them."""
    groups, held = [], splits.SPLIT_BYTES
    for r in (r for f in files for r in splits.ranges(f, file_size(spark, f), splits.SPLIT_BYTES)):
        if held >= splits.SPLIT_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(r)
        held += r[2] - r[1]
    schema = "_file string, _start long, n long, first long" if count else LINES
    return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(_packed_lines(groups, count), schema)


def file_size(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def located_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(_file, _start, _seq, value of all lines; _file, _start, n, first of each split)."""
    files = [path] if isinstance(path, str) else path
    packed = [u for f in files if re.search(r"\.b?gz$", f) and splits.kind_of(u := splits.qualified(spark, f)) == "block"]
    rest = [f for f in files if splits.qualified(spark, f) not in packed] if packed else files
    lines = counts = None
    if rest:
        lines = spark.read.text(rest).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_seq"), "value")
        counts = lines.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_seq").alias("first"))
    if packed:
        own, n = packed_lines(spark, packed), packed_lines(spark, packed, count=True)
        lines, counts = (lines.unionByName(own), counts.unionByName(n)) if rest else (own, n)
    return lines, counts


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """row_idx, value of the data lines of a file, a folder or several files in the order given (by name within a
    folder). One light pass counts the lines of each split; the splits, few, are ordered by file and place, and a line's
    number is its split's offset plus its place in the split."""
    lines, per = located_lines(spark, path)
    nth = {} if isinstance(path, str) else {p.rsplit("/", 1)[-1]: i for i, p in enumerate(path)}
    place = lambda file: (nth.get(file.rsplit("/", 1)[-1], 0), file)
    found, at, rows = sorted((place(r["_file"]), r["_start"], r["n"], r["first"]) for r in per.collect()), 0, []
    for (_, file), start, n, first in found:
        rows.append((file, start, at - first))
        at += n
    offsets = frame(spark, rows, OFFSETS)
    data = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    return data.join(F.broadcast(offsets), ["_file", "_start"]).select((F.col("_seq") + F.col("_shift")).alias("row_idx"), "value")


def numbered_ranges(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """id, uri, start, end, first, n of the ranges of a block-gzip file that have lines: the number of the first one and how many they are; how many ranges. None for
    other files."""
    if not re.search(r"\.b?gz$", path) or splits.kind_of(uri := splits.qualified(spark, path)) != "block":
        return None, 0
    size, at, rows = file_size(spark, path), 0, []
    for r in sorted(packed_lines(spark, [uri], count=True).collect(), key=lambda r: r["_start"]):  # a row a range
        rows.append((len(rows), uri, r["_start"], min(size, r["_start"] + splits.SPLIT_BYTES), at, r["n"]))
        at += r["n"]
    return frame(spark, rows, RANGES), len(rows)


def with_bits(ranges: DataFrame, bits: DataFrame) -> DataFrame:
    """kept: the rows of a bitmap that a range's lines meet. A range that meets none goes."""
    met = ranges.select("id", F.explode(F.sequence(F.floor(F.col("first") / BITS), F.floor((F.col("first") + F.col("n") - 1) / BITS))).alias("bucket"))
    kept = met.join(bits.select("bucket", "bits"), "bucket").groupBy("id").agg(F.collect_list(F.struct("bucket", "bits")).alias("kept"))
    return ranges.join(kept, "id")


def in_bits(kept: dict[int, bytes], rows: np.ndarray) -> np.ndarray:
    """Which rows are in a bitmap."""
    out = np.zeros(len(rows), bool)
    for bucket in np.unique(rows // BITS).tolist():
        if bucket in kept:
            own = rows // BITS == bucket
            place = rows[own] % BITS
            out[own] = np.frombuffer(kept[bucket], np.uint8)[place // 8] >> (place % 8).astype(np.uint8) & 1
    return out


def range_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges -> row_idx, value of their data lines, or of those that are kept."""
    for batch in batches:
        for r in batch.to_pylist():
            at, kept = r["first"], {k["bucket"]: k["bits"] for k in r["kept"]} if "kept" in r else None
            for data in splits.whole_lines(r["uri"], r["start"], r["end"]):
                lines = splits.line_array(data)
                rows = np.arange(at, at + len(lines))
                at += len(lines)
                good = pc.and_not(pc.greater(pc.binary_length(lines), 0), pc.starts_with(lines, "#"))
                if kept is not None:
                    good = pc.and_(good, pa.array(in_bits(kept, rows)))
                yield pa.RecordBatch.from_arrays([pa.array(rows), lines], names=["row_idx", "value"]).filter(good)


class VcfFile:
    """A VCF file with some of its samples chosen."""

    def __init__(self, spark: SparkSession, path: str, samples: str = "", mode: str = "FAILFAST", dosage_field: str = "DS"):
        header, head = read_header(spark, path)
        self.chosen = resolve_samples(header, samples)
        self.names = [header[i] for i in self.chosen]
        self.ranges, self.tasks = numbered_ranges(spark, path)
        self.lines = numbered_lines(spark, path) if self.ranges is None else self._dealt(self.ranges).mapInArrow(range_lines, "row_idx long, value string")
        self.how = {"samples": len(header), "chosen": self.chosen, "af": is_float(head, "INFO", "AF"), "ds": dosage_field == "GT" or is_float(head, "FORMAT", dosage_field), "field": dosage_field, "mode": mode}

    def _dealt(self, ranges: DataFrame) -> DataFrame:
        """A range a task."""
        return ranges.repartitionByRange(max(1, min(TASKS, self.tasks)), "id")

    def _decoded(self, bits: DataFrame | None = None, **how) -> DataFrame:
        """Ranges are read by the workers that decode their lines, so a task has one."""
        if self.ranges is not None:
            ranges = self.ranges if bits is None else with_bits(self.ranges, bits)
            return decode(self._dealt(ranges), **self.how, **how, impute=True, emit_af=True, reader=range_lines)
        return decode(self.lines if bits is None else rows_in(self.lines, bits), **self.how, **how, impute=True, emit_af=True)

    def variants(self, bits: DataFrame | None = None) -> DataFrame:
        """row_idx, chrom, pos, id, ref, alt, info_af, af, has_ds, ds (missing ones 0) of all lines, or of those in a bitmap, a written table."""
        return self._decoded(bits)

    def heads(self) -> DataFrame:
        """The same without ds: cells are read only where a frequency must be made from them."""
        return self._decoded(emit_ds=False)


def read_vcf(spark: SparkSession, path: str, samples: str = "", mode: str = "FAILFAST", dosage_field: str = "DS") -> tuple[DataFrame, list[str]]:
    """(variants with the chosen samples' dosages, their names). ``mode``: FAILFAST raises on a line with a bad position
    or a wrong number of fields, DROPMALFORMED leaves it out."""
    file = VcfFile(spark, path, samples, mode, dosage_field)
    return file.variants(), file.names
