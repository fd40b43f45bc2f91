"""Standardized dosages times the trait matrix, by three plans that agree: matrix products in Arrow batches (the way for
large data), array functions, and a long-form join.

The matrix is never broadcast unchecked: up to ``MATRIX_BYTES`` it travels with the tasks; beyond that tasks make its
tiles from the seed. All tiles for a batch are made in one task, so the range of each variant is known there and no
second pass over tiles is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dosage as D
from .traits import trait_tile

MATRIX_BYTES = 64 << 20
#: Values of a block of standardized dosages or of results held at once.
BLOCK_VALUES = 1 << 22


def scaled_rows(y: np.ndarray) -> np.ndarray:
    """Each row to [0, 2]; 1 where a row is constant, NaN where it holds NaN."""
    if not y.shape[1]:
        return y
    lo, hi = y.min(1, keepdims=True), y.max(1, keepdims=True)
    span = hi - lo
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(span == 0, 1.0, 2 * (y - lo) / np.where(span == 0, 1, span))


def gemm(df: DataFrame, matrix: np.ndarray | None = None, **how) -> DataFrame:
    """df with ``out`` (array<double>, one value a trait) in place of ``z``. Give the matrix (traits x samples) or a seed."""
    return df.mapInArrow(*multiplier(df, matrix, **how))


def multiplier(df: DataFrame, matrix: np.ndarray | None = None, *, seed: int | None = None, n_traits: int = 0, per_tile: int = 2000, z: str = "z", out: str = "dosages", scale: bool = True) -> tuple:
    """(batches of df to batches of ``gemm``, their schema), for a worker that goes on with them."""
    if matrix is not None and matrix.nbytes > MATRIX_BYTES:
        raise ValueError("a matrix this large is made in the tasks: give its seed")
    others = [f for f in df.schema.fields if f.name not in (z, out)]
    names = [f.name for f in others]

    def product(block: np.ndarray) -> np.ndarray:
        n = block.shape[1]
        if matrix is not None:
            return block @ matrix.T / n
        tiles = (trait_tile(seed, t, min(per_tile, n_traits - t), n) for t in range(0, n_traits, per_tile))
        return np.concatenate([block @ w.T for w in tiles], axis=1) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(z)
            if not batch.num_rows:
                continue
            width = max(len(lists[0]), n_traits or (len(matrix) if matrix is not None else 1), 1)
            step = max(1, BLOCK_VALUES // width)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = part.column(z).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                y = product(values)
                y = scaled_rows(y) if scale else y
                offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], names=[*names, out])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return run, StructType([*others, StructField(out, ArrayType(DoubleType()))])


def by_arrays(df: DataFrame, matrix: DataFrame, z: str = "z", out: str = "dosages", scale: bool = True) -> DataFrame:
    """The same by array functions: the matrix is one row (an array of trait rows), small enough to be broadcast.
    ``matrix``: trait, w."""
    held = matrix.agg(F.coalesce(F.sum(F.size("w") * F.lit(8)), F.lit(0))).first()[0]
    if held > MATRIX_BYTES:
        raise ValueError("a matrix this large isn't broadcast: use gemm with its seed, or the long form")
    one = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct("trait", "w"))), lambda r: r["w"]).alias("_m"))
    y = F.transform("_m", lambda w: D.dot(F.col(z), w) / F.size(z))
    with_y = df.crossJoin(F.broadcast(one)).withColumn(out, y).drop("_m", z)
    return with_y.withColumn(out, D.scale_to_dosage(F.col(out))) if scale else with_y
