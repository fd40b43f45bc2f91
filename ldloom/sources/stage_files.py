"""Stage files of the command-line tool this flow follows: trait tiles and chunks as raw little-endian doubles, row after row, with text files that tell
their sizes. They become this library's folders, so that ``simulate`` runs on them, and these folders become stage files again.

Files are read in ranges of whole records by many tasks, whatever their size. A file that is shorter or longer than its text file tells raises, where the
tool itself would go on with zeros.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traits import SAMPLES
from . import splits
from .joined import Piece, append
from .store import remove, write_json

#: Bytes of records that a task reads at once.
RANGE_BYTES = 16 << 20
# The names of the files.
TILE, TILES, CHUNK, META = "traits/W_tile_{}.bin", "traits/metadata.txt", "chunks/chunk_{}.bin", "chunks/chunk_{}.meta"


class StageError(ValueError):
    """A stage file doesn't hold what its text file tells."""


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def settings(text: str, lines: int | None = None) -> dict[str, str]:
    """key=value lines, the first so many of the text."""
    return dict(x.split("=", 1) for x in text.splitlines()[:lines] if "=" in x)


def sized(spark: SparkSession, path: str, records: int, width: int) -> str:
    """The path for Arrow, if the file holds so many records."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    if found != records * width * 8:
        raise StageError(f"{path}: {found} bytes, not {records} records of {width} numbers")
    return splits.qualified(spark, path)


def records(spark: SparkSession, files: list[tuple[int, str, int]], width: int) -> DataFrame:
    """part, nth, row: every record of the files, given as (number, path for Arrow, records)."""
    step = max(1, RANGE_BYTES // max(1, width * 8))
    ranges = [(part, uri, at, min(n, at + step)) for part, uri, n in files for at in range(0, n, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, uri, start, end in (ranges[i] for batch in batches for i in batch.column("id").to_pylist()):
            with splits.opened(uri) as file:
                file.seek(start * width * 8)
                data = file.read((end - start) * width * 8)
            if len(data) != (end - start) * width * 8:
                raise StageError(f"{uri}: cut off in record {start + len(data) // (width * 8)}")
            offsets = pa.array(np.arange(0, (end - start) * width + 1, width, dtype=np.int32))
            rows = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(data, "<f8")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(end - start, part, np.int32)), pa.array(np.arange(start, end)), rows], names=["part", "nth", "row"])

    return spark.range(0, len(ranges), 1, max(1, len(ranges))).mapInArrow(run, "part int, nth long, row array<double>")


def read_tiles(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    """(trait, tile_id, block, w as ``traits`` makes them; the sizes told)."""
    told = settings(text_of(spark, f"{folder}/{TILES}"))
    counts = [int(x) for x in told["tile_trait_counts"].split(",") if x]
    n = {k: int(told[k]) for k in ("n_traits", "n_samples", "n_tiles")}
    if len(counts) != n["n_tiles"] or sum(counts) != n["n_traits"]:
        raise StageError(f"{folder}/{TILES}: {n['n_traits']} traits in {n['n_tiles']} tiles, but the tiles hold {counts}")
    files = [(t, sized(spark, f"{folder}/{TILE.replace('{}', str(t))}", c, n["n_samples"]), c) for t, c in enumerate(counts)]
    first = F.element_at(F.array(*(F.lit(sum(counts[:t])) for t in range(len(counts)))), F.col("part") + 1)
    rows = records(spark, files, n["n_samples"]).select((first + F.col("nth")).cast("int").alias("trait"), F.col("part").alias("tile_id"), F.col("row"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(max(0, n["n_samples"] - 1) // SAMPLES)), lambda b: F.slice("row", b * SAMPLES + 1, F.lit(SAMPLES)))
    return rows.select("trait", "tile_id", F.posexplode(blocks).alias("block", "w")), n | {"traits_per_tile": max([1, *counts])}


def read_chunks(spark: SparkSession, folder: str, n_samples: int) -> tuple[DataFrame, int, int]:
    """(row_idx, chrom, pos, id, ref, alt, z, chunk_id, row_in_chunk; how many rows, how many chunks)."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/chunks")
    names = [s.getPath().getName() for s in jvm.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm)]
    found = sorted(int(m[1]) for x in names if (m := re.fullmatch(r"chunk_(\d+)\.meta", x)))
    files, start, starts = [], 0, []
    paths = [f"{folder}/{META.replace('{}', str(c))}" for c in found]
    lines = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"chunk_(\d+)", 1).cast("int").alias("chunk_id"), F.posexplode(F.split("value", "\n")).alias("nth", "line"))
    heads: dict[int, list[str]] = {}
    for c, _, line in sorted(lines.where("nth < 3").collect()):  # three rows a chunk
        heads.setdefault(c, []).append(line)
    for c in found:
        head = settings("\n".join(heads.get(c, [])))
        if int(head["n_samples"]) != n_samples:
            raise StageError(f"chunk {c} holds {head['n_samples']} samples, the tiles {n_samples}")
        files.append((c, sized(spark, f"{folder}/{CHUNK.replace('{}', str(c))}", int(head["n_variants"]), n_samples), int(head["n_variants"])))
        starts.append((c, start, int(head["n_variants"])))
        start += int(head["n_variants"])
    first = spark.createDataFrame(starts, "chunk_id int, first long, n long")
    told = lines.where("nth >= 3 AND line != ''").select("chunk_id", (F.col("nth") - 3).cast("long").alias("nth"), F.split("line", "\t").alias("f"))
    fields = [F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("chrom", "pos", "id", "ref", "alt"))]
    wrong = told.groupBy("chunk_id").agg(F.count("*").alias("m")).join(first, "chunk_id", "right").where("coalesce(m, 0) != n").select("chunk_id").first()
    if wrong:
        raise StageError(f"chunk {wrong[0]} has another number of variants in its text file than it tells there")
    values = records(spark, files, n_samples).select(F.col("part").alias("chunk_id"), "nth", F.col("row").alias("z"))
    rows = values.join(told.select("chunk_id", "nth", *fields), ["chunk_id", "nth"]).join(F.broadcast(first), "chunk_id")
    return rows.select((F.col("first") + F.col("nth")).alias("row_idx"), "chrom", F.col("pos").cast("int"), "id", "ref", "alt", "z", "chunk_id", F.col("nth").cast("int").alias("row_in_chunk")), start, len(found)


def import_stages(spark: SparkSession, folder: str, out: str) -> dict[str, int]:
    """Writes out/traits, out/chunks and out/manifest from a folder of stage files; the manifest. It holds no seed: the tiles are what they are."""
    tiles, n = read_tiles(spark, folder)
    rows, n_variants, n_chunks = read_chunks(spark, folder, n["n_samples"])
    tiles.write.mode("overwrite").partitionBy("tile_id").parquet(f"{out}/traits")
    rows.repartition("chunk_id").write.mode("overwrite").partitionBy("chunk_id").parquet(f"{out}/chunks")
    manifest = n | {"n_variants": n_variants, "n_chunks": n_chunks, "seed": None}
    write_json(spark, manifest, f"{out}/manifest")
    return manifest


def write_files(rows: DataFrame, folder: str, names: str, encode: Callable[[pa.RecordBatch], bytes], order: list[str]) -> dict[int, int]:
    """A file for every value of ``part``, its rows in ``order``; value -> bytes. A task writes a file under a name of its own, the driver renames it, so files
    of failed tasks are never seen."""
    from pyarrow import fs

    uri = splits.qualified(rows.sparkSession, folder)
    job = f"_parts-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(uri)
        system.create_dir(f"{where}/{job}", recursive=True)
        made: list[tuple[int, str, int]] = []
        out = None
        try:
            for batch in batches:
                parts = batch.column("part").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
                for start, end in zip(cuts, cuts[1:]):
                    if end > start and (not made or made[-1][0] != parts[start]):
                        if out:
                            out.close()
                        made.append((int(parts[start]), uuid.uuid4().hex, 0))
                        out = system.open_output_stream(f"{where}/{job}/{made[-1][1]}")
                    if end > start:
                        out.write(data := encode(batch.slice(start, end - start)))
                        made[-1] = (*made[-1][:2], made[-1][2] + len(data))
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["part", "name", "size"])

    system, where = fs.FileSystem.from_uri(uri)
    system.create_dir(f"{where}/{names}".rsplit("/", 1)[0], recursive=True)
    try:
        made = rows.repartition("part").sortWithinPartitions("part", *order).mapInArrow(run, "part int, name string, size long").collect()  # a row a file
        for part, name, _ in made:
            system.move(f"{where}/{job}/{name}", f"{where}/{names.replace('{}', str(part))}")
    finally:
        remove(rows.sparkSession, f"{folder}/{job}")
    return {part: size for part, _, size in made}


def doubles(batch: pa.RecordBatch) -> bytes:
    return batch.column("row").flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()


def text_lines(batch: pa.RecordBatch) -> bytes:
    return "".join(f"{x}\n" for x in batch.column("line").to_pylist()).encode()


def export_stages(spark: SparkSession, prep: str, out: str) -> None:
    """Writes the tiles and chunks of ``preprocess`` as stage files, so that the tool goes on from them. Rows of a wrong length raise."""
    n = json.loads(spark.read.text(f"{prep}/manifest").first()[0])
    width = 8 * n["n_samples"]
    tiles = spark.read.parquet(f"{prep}/traits").select(F.col("tile_id").cast("int").alias("part"), "trait", "block", F.col("w").alias("row"))
    counts = dict(sorted((r[0], r[1]) for r in tiles.groupBy("part").agg(F.count_distinct("trait")).collect()))  # a row a tile
    chunks = spark.read.parquet(f"{prep}/chunks").withColumn("part", F.col("chunk_id").cast("int"))
    sizes = chunks.groupBy("part").agg(F.count("*").alias("n"))
    held = {r[0]: r[1] for r in sizes.collect()}  # a row a chunk
    told = F.array(*(F.concat(F.lit(k), v.cast("string")) for k, v in (("chunk_id=", F.col("part")), ("n_variants=", F.col("n")), ("n_samples=", F.lit(n["n_samples"])))))
    heads = sizes.select("part", F.posexplode(told).alias("place", "line")).withColumn("place", F.col("place") - 3)
    lines = chunks.select("part", F.col("row_in_chunk").alias("place"), F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt").alias("line"))
    made = write_files(tiles, out, TILE, doubles, ["trait", "block"])
    written = write_files(chunks.select("part", "row_in_chunk", F.col("z").alias("row")), out, CHUNK, doubles, ["row_in_chunk"])
    wrong = [names.replace("{}", str(p)) for names, sizes_, want in ((TILE, made, counts), (CHUNK, written, held)) for p in want if sizes_.get(p, 0) != want[p] * width]
    if wrong:
        raise StageError(f"rows that don't hold {n['n_samples']} numbers: {wrong[:5]}")
    write_files(heads.unionByName(lines), out, META, text_lines, ["place"])
    text = f"n_traits={sum(counts.values())}\nn_samples={n['n_samples']}\nn_tiles={len(counts)}\ntile_trait_counts={','.join(map(str, counts.values()))}\n"
    append(spark, [Piece(data=text.encode())], f"{out}/{TILES}")
