"""The flow in stages that share Parquet folders: preprocess writes chunks and trait tiles, simulate reads any range of
chunks and writes a file for each, merge puts the files in one. Chunk folders are partitions, so a range reads only its own.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MergeConfig, PreprocessConfig, SimulateConfig, traits_per_tile
from ..operators import variants as V
from ..operators.blocked import blocked_product
from ..operators.simulate import MATRIX_BYTES, gemm, multiplier
from ..operators.traits import SAMPLES, fresh_seed, traits, whole_rows
from ..sources import splits
from ..sources.store import stored, write_json
from ..sources.vcf import header_lines, numbered_lines
from ..sources.vcf_merge import merge_blocks
from ..sources.vcf_write import in_order, write_files, write_lines
from .standard import passing, timed, with_z


def preprocess(spark: SparkSession, cfg: PreprocessConfig) -> dict:
    """out/traits (tiles), out/chunks (standardized dosages), out/manifest; returns the manifest."""
    variants, names, counts = passing(spark, cfg.vcf, cfg.samples, cfg.maf, "chunked")
    if not (n := counts["filtered"]):
        raise ValueError("no variant passed the filters")
    seed = fresh_seed() if cfg.seed is None else cfg.seed
    tile = traits_per_tile(cfg.n_traits, len(names), cfg.traits_per_tile)
    with timed("traits"):
        traits(spark, cfg.n_traits, len(names), seed, tile).write.mode("overwrite").partitionBy("tile_id").parquet(f"{cfg.out}/traits")
    with timed("chunks"):
        z = stored(with_z(variants), "standardized")
        V.assign_chunks(z, cfg.chunk_size).write.mode("overwrite").partitionBy("chunk_id").parquet(f"{cfg.out}/chunks")
    manifest = {"n_traits": cfg.n_traits, "n_samples": len(names), "n_tiles": -(-cfg.n_traits // tile), "traits_per_tile": tile, "n_variants": n, "n_chunks": -(-n // cfg.chunk_size), "seed": seed, "n_total": counts["total"], "n_duplicates": counts["duplicates"]}
    write_json(spark, manifest, f"{cfg.out}/manifest")
    return manifest


def read_manifest(spark: SparkSession, prep: str) -> dict:
    return json.loads(spark.read.text(f"{prep}/manifest").first()[0])


def read_chunks(spark: SparkSession, prep: str, start: int = -1, end: int = -1) -> DataFrame:
    return V.chunk_range(spark.read.parquet(f"{prep}/chunks"), start, end)


def read_trait_blocks(spark: SparkSession, prep: str) -> DataFrame:
    """trait, tile_id, block, w as preprocess wrote them. The seed in the manifest makes the same numbers."""
    return spark.read.parquet(f"{prep}/traits").select("trait", "tile_id", "block", "w")


def read_traits(spark: SparkSession, prep: str) -> DataFrame:
    """trait, tile_id, w: whole rows."""
    return whole_rows(read_trait_blocks(spark, prep))


def held(matrix: DataFrame, n_traits: int, n_samples: int) -> np.ndarray:
    """Stored trait blocks as one matrix."""
    out = np.zeros((n_traits, n_samples))
    for r in matrix.toLocalIterator():
        out[r["trait"], r["block"] * SAMPLES : r["block"] * SAMPLES + len(r["w"])] = r["w"]
    return out


def product(z: DataFrame, matrix: DataFrame, n_traits: int, n_samples: int) -> DataFrame:
    """Stored rows z times stored trait blocks: a matrix up to ``MATRIX_BYTES`` goes to all tasks, a larger one is multiplied in blocks."""
    if 8 * n_traits * n_samples > MATRIX_BYTES:
        return blocked_product(z, matrix, n_samples)
    return gemm(z, held(matrix, n_traits, n_samples))


def simulate(spark: SparkSession, cfg: SimulateConfig) -> list[str]:
    """A file chunk_<id>.vcf[.gz] for every chunk in range; their paths. One job for all chunks, from the stored trait tiles."""
    m = read_manifest(spark, cfg.prep)
    chunks, matrix = read_chunks(spark, cfg.prep, cfg.start_chunk, cfg.end_chunk), read_trait_blocks(spark, cfg.prep)
    by_chunk = lambda rows: rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "row_idx")
    small = 8 * m["n_traits"] * m["n_samples"] <= MATRIX_BYTES  # then the narrower z is dealt out, and multiplied by the workers that write; else the products are
    make = multiplier(chunks, held(matrix, m["n_traits"], m["n_samples"])) if small else None
    made = chunks if small else product(chunks, matrix, m["n_traits"], m["n_samples"])
    with timed("simulate and write"):
        return write_files(by_chunk(made), cfg.out, "chunk_id", "chunk_{}.vcf" + ".gz" * cfg.compress, m["n_traits"], "chunked", cfg.compress, make=make)


def chunk_files(spark: SparkSession, folder: str, order: str = "numeric") -> list[str]:
    """Files chunk_*.vcf or chunk_*.vcf.gz by number, or by name; indexes beside them are left out."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in jvm.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm)]
    found = [n for n in names if re.fullmatch(r"chunk_.*\.vcf(\.gz)?", n)]
    if not found:
        raise FileNotFoundError(f"no chunk files in {folder}")
    number = lambda n: (int(m[1]) if (m := re.match(r"chunk_(\d+)", n)) else 1 << 62, n)
    return [f"{folder}/{n}" for n in sorted(found, key=number if order == "numeric" else None)]


def merge_lines(files: DataFrame, order: list[str]) -> DataFrame:
    """Data lines of several files in order. files: the order columns and value. Header lines and empty lines go."""
    return files.where((F.length("value") > 0) & ~F.col("value").startswith("#")).orderBy(*order)


def merge(spark: SparkSession, cfg: MergeConfig) -> int:
    """One file from all chunk files; how many they are. Block-gzip files that become one are copied block by block. A file that can't be read raises."""
    files = chunk_files(spark, cfg.chunks, cfg.order)
    uris = [splits.qualified(spark, f) for f in files]
    if cfg.compress and all(splits.kind_of(u) == "block" for u in uris):
        merge_blocks(spark, uris, cfg.out)
        return len(files)
    head = "".join(f"{x}\n" for x in header_lines(spark, files[0]))
    rows = numbered_lines(spark, files).select("row_idx", F.col("value").alias("line"))
    write_lines(in_order(rows), cfg.out, head, cfg.compress)
    return len(files)
