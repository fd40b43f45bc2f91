"""VCF text out: lines are made in Arrow batches, files are plain text or block gzip.

Values have four decimals as C's printf gives them, which none of Spark's formatters does. Rows are put in order before
their values are made, so nothing is made twice. A single ordered file is made of parts that tasks write (and compress) and
join (``joined``). ``write_parts`` and ``write_files`` are written by the tasks alone: a folder whose parts in the order of their names are
the file, and a file for every value of a column.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joined import write_joined

# What the two packagings write.
PROFILES = {"standard": ("T", "PASS"), "chunked": ("", ".")}
FORMAT_LINE = '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dosage">'
SOURCE = "##source=ldloom"
#: An empty block, which ends a block-gzip file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
#: Rows, and bytes of Arrow's, of which texts are made at once: Python's own objects take some times as much, in each worker.
PART_ROWS, PART_BYTES = 1000, 1 << 20


def header(n_traits: int, profile: str = "standard", source: str = SOURCE) -> str:
    prefix = PROFILES[profile][0]
    names = [f"{prefix}{i + 1}" for i in range(n_traits)]
    return "\n".join(["##fileformat=VCFv4.1", source, FORMAT_LINE, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]) + "\n"


def bgzf(data: bytes, level: int = 6) -> bytes:
    """Blocks of at most 64 KiB, each a gzip member that says its size."""
    out = []
    for at in range(0, len(data), BLOCK):
        raw = data[at : at + BLOCK]
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(raw) + packer.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw)))
    return b"".join(out)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def line_texts(batch: pa.RecordBatch, status: str) -> list[str]:
    return ["\t".join([*map(str, key), ".", status, ".", "DS", *("%.4f" % v for v in values)]) for *key, values in zip(*(batch.column(c).to_pylist() for c in ("chrom", "pos", "id", "ref", "alt", "dosages")))]


def lines(df: DataFrame, profile: str = "standard", schema: str = "row_idx long, line string") -> DataFrame:
    """row_idx, line of variants with ``dosages``."""
    status = PROFILES[profile][1]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            yield pa.RecordBatch.from_arrays([batch.column("row_idx"), pa.array(line_texts(batch, status), pa.string())], names=["row_idx", "line"])

    return df.select("row_idx", "chrom", "pos", "id", "ref", "alt", "dosages").mapInArrow(make, schema)


def key_lines(df: DataFrame, key: str, profile: str) -> DataFrame:
    """key, row_idx, line; the row_idx of ``lines`` carries the key through."""
    both = df.withColumn("row_idx", F.struct(F.col(key).alias("k"), F.col("row_idx").alias("i")))
    made = lines(both, profile, "row_idx struct<k:int,i:long>, line string")
    return made.select(F.col("row_idx.k").alias(key), F.col("row_idx.i").alias("row_idx"), "line")


def in_order(df: DataFrame) -> DataFrame:
    """Rows sorted by row_idx in each partition, partitions in row order. Do this before values are made."""
    return df.repartitionByRange("row_idx").sortWithinPartitions("row_idx")


def packer(texts: Callable, compress: bool, level: int = 6):
    """Batches -> data: their lines, as ``texts`` makes them, joined and packed, some at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                data = "".join(f"{x}\n" for x in texts(part)).encode()
                yield pa.RecordBatch.from_arrays([pa.array([bgzf(data, level) if compress else data])], names=["data"])

    return pack


def write_vcf(df: DataFrame, path: str, n_traits: int, profile: str = "standard", compress: bool = False, source: str = SOURCE, level: int = 6, ordered: bool = False, make: tuple | None = None) -> None:
    """One ordered file. Block gzip if asked for or if the name ends in .gz. ``ordered``: df comes from in_order(). ``make``: what makes dosages of df's
    batches, and its schema; it runs in the worker that writes."""
    status, rows = PROFILES[profile][1], df if ordered else in_order(df)
    rows = rows if make else rows.select("chrom", "pos", "id", "ref", "alt", "dosages")
    write_texts(rows, lambda batch: line_texts(batch, status), path, header(n_traits, profile, source), compress or path.endswith(".gz"), level, make)


def write_lines(ordered: DataFrame, path: str, head: str, packed: bool, level: int = 6) -> None:
    """``ordered``: row_idx, line in row order."""
    write_texts(ordered.select("line"), lambda batch: batch.column("line").to_pylist(), path, head, packed, level)


def write_texts(ordered: DataFrame, texts: Callable, path: str, head: str, packed: bool, level: int = 6, make: tuple | None = None) -> None:
    """The lines that ``texts`` makes of batches of rows in order; a task has one Python worker, which makes, packs and writes them."""
    pack, text = packer(texts, packed, level), head.encode()
    write_joined(ordered, (lambda batches: pack(make[0](batches))) if make else pack, path, bgzf(text, level) if packed else text, BGZF_END if packed else b"")


def write_parts(df: DataFrame, folder: str, n_traits: int, profile: str = "standard", compress: bool = False, source: str = SOURCE) -> None:
    """A folder of text parts (gzip if asked for), written by the tasks: joined in the order of their names they are the
    file. read_vcf reads such a folder."""
    head = [(i - (1 << 20), x) for i, x in enumerate(header(n_traits, profile, source).splitlines())]
    rows = lines(in_order(df), profile)
    first = df.sparkSession.createDataFrame(head, "row_idx long, line string").coalesce(1)
    first.unionByName(rows).select("line").write.mode("overwrite").option("compression", "gzip" if compress else "none").text(folder)


def write_files(df: DataFrame, folder: str, key: str, names: str, n_traits: int, profile: str = "chunked", compress: bool = False, source: str = SOURCE, level: int = 6, make: tuple | None = None) -> list[str]:
    """A file in folder for every value of an integer column, named by ``names`` with the value for {}; their paths. One job, however many values.

    ``df`` is partitioned by ``key`` and sorted by (key, row_idx). The tasks write the files and the driver renames them (``vcf_sink``). In file systems
    that Arrow doesn't reach, Spark's text writer takes its place, for plain files only. ``make``: as in write_vcf."""
    from . import splits, vcf_sink

    spark = df.sparkSession
    if vcf_sink.reached(uri := splits.qualified(spark, folder)):
        return [f"{folder}/{n}" for n in vcf_sink.write_files(df, uri, key, names, n_traits, profile, compress, source, level, make)]
    if compress:
        raise ValueError(f"{folder}: compressed files need a file system that Arrow reaches")
    df = df.mapInArrow(*make) if make else df
    head = header(n_traits, profile, source)[:-1]
    first = F.lag(key).over(Window.partitionBy(key).orderBy("row_idx")).isNull()  # the partitioning and order are there already
    titled = key_lines(df, key, profile).select(key, F.when(first, F.concat(F.lit(f"{head}\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))
    rough = f"{folder}/_parts-{uuid.uuid4().hex}"
    titled.write.option("maxRecordsPerFile", 0).partitionBy(key).text(rough)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system, found = path(rough).getFileSystem(spark._jsc.hadoopConfiguration()), []
    for file in spark.read.text(rough).select("_metadata.file_path").distinct().collect():  # a row a file
        value = int(file[0].rsplit("/", 2)[1].split("=")[1])
        found.append((value, f"{folder}/{names.replace('{}', str(value))}"))
        system.delete(path(found[-1][1]), False)
        system.rename(path(file[0]), path(found[-1][1]))
    system.delete(path(rough), True)
    return [n for _, n in sorted(found)]
