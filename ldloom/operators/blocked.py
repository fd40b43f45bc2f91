"""Standardized dosages times the trait matrix in blocks, for matrices of any size.

Rows are cut into blocks of ``ROWS`` rows by ``SAMPLES`` samples, the matrix into blocks of ``TRAITS`` traits by as many samples. Blocks of one range of samples
meet in cells of ``CELL`` by ``CELL`` blocks; a task holds one of each and yields their product. Products over the ranges of samples are summed in the order
of the ranges, so the numbers don't depend on the partitioning. The least and the greatest value of a row come from a narrow sum over the blocks' own; values are scaled block by
block, and a row's are put together where its line is made. No task holds a row of the matrix or a tile of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .traits import SAMPLES

ROWS, TRAITS, CELL = 256, 256, 16
#: Ranges of samples with more blocks than a cell takes are no more than the ranges, which are few: their sizes are sent to all tasks up to so many.
BROADCAST_KEYS = 50_000

LEFT = "rows long, range int, n int, ids binary, values binary"
RIGHT = "traits int, range int, width int, first int, matrix binary"
PRODUCTS = "rows long, traits int, range int, n int, first int, ids binary, product binary"


def cut_rows(z: str, size: int, width: int):
    """row_idx and z -> blocks of rows, cut into ranges of samples; rows of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                values = part.column(z).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                ids = part.column("row_idx").to_numpy().astype(np.int64).tobytes()
                for r, first in enumerate(range(0, values.shape[1], width)):
                    block = np.ascontiguousarray(values[:, first : first + width])
                    columns = (pa.array([at]), pa.array([r], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([ids]), pa.array([block.tobytes()]))
                    yield pa.RecordBatch.from_arrays([*columns], names=["rows", "range", "n", "ids", "values"])
                at += 1

    return run


def cut_matrix(size: int):
    """trait, block, w sorted by (traits, block, trait) -> blocks of traits for a range of samples."""

    def packed(key: tuple, rows: list) -> pa.RecordBatch:
        traits, block = key
        matrix = np.array([w for _, w in rows])
        values = (traits, block, matrix.shape[1], rows[0][0])
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in values), pa.array([matrix.tobytes()])], names=["traits", "range", "width", "first", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for i, own in enumerate(zip(batch.column("traits").to_pylist(), batch.column("block").to_pylist())):
                if rows and own != key:
                    yield packed(key, rows)
                    rows = []
                key = own
                rows.append((batch.column("trait")[i].as_py(), batch.column("w")[i].values.to_numpy(zero_copy_only=False)))
        if rows:
            yield packed(key, rows)

    return run


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
            values = np.frombuffer(r["values"]).reshape(r["n"], -1)
            made = values @ np.frombuffer(r["matrix"]).reshape(-1, r["width"]).T
            columns = [batch.column(c).slice(i, 1) for c in ("rows", "traits", "range", "n", "first", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([made.tobytes()])], names=["rows", "traits", "range", "n", "first", "ids", "product"])


def summed(n_samples: int):
    """Products sorted by (rows, traits, range) -> rows of row_idx, first trait, values, low, high, whether one is NaN."""

    def told(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        ids, first = key[2], key[3]
        y = total / n_samples
        with np.errstate(invalid="ignore"):
            low, high = y.min(1), y.max(1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
        columns = [pa.array(np.frombuffer(ids, np.int64)), pa.array(np.full(len(y), first, np.int32)), lists, pa.array(low), pa.array(high), pa.array(np.isnan(y).any(1))]
        return pa.RecordBatch.from_arrays(columns, names=["row_idx", "first", "y", "low", "high", "nan"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                own = (r["rows"], r["traits"], r["ids"], r["first"])
                part = np.frombuffer(r["product"]).reshape(r["n"], -1)
                if own[:2] != (key or ())[:2]:
                    if key:
                        yield told(key, total)
                    key, total = own, part.copy()
                else:
                    total += part
        if key:
            yield told(key, total)

    return run


def in_cells(left: DataFrame, right: DataFrame, cell: int) -> DataFrame:
    """Every block of rows with every block of traits of its range of samples; both are dealt into rows and columns of cells, so no key holds more than a cell."""
    sizes = left.groupBy("range").agg(F.count("*").alias("_l")).join(right.groupBy("range").agg(F.count("*").alias("_r")), "range")
    grid = sizes.select("range", F.ceil(F.col("_l") / cell).alias("down"), F.ceil(F.col("_r") / cell).alias("across"))
    if grid.count() <= BROADCAST_KEYS:
        grid = F.broadcast(grid)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = left.join(grid, "range").withColumn("y", F.pmod(F.xxhash64("rows"), "down")).withColumn("x", each("across")).drop("down", "across")
    other = right.join(grid, "range").withColumn("x", F.pmod(F.xxhash64("traits"), "across")).withColumn("y", each("down")).drop("down", "across")
    return mine.join(other, ["range", "x", "y"])


def blocked_product(df: DataFrame, matrix: DataFrame, n_samples: int, z: str = "z", out: str = "dosages", scale: bool = True, rows: int = ROWS, traits: int = TRAITS, width: int = SAMPLES, cell: int = CELL) -> DataFrame:
    """df with ``out`` in place of ``z``, as gemm makes it. ``df``: a written table with row_idx, a row once; ``matrix``: trait, block, w, in blocks of ``width`` samples."""
    left = df.select("row_idx", z).mapInArrow(cut_rows(z, rows, width), LEFT)
    by = matrix.select(F.floor(F.col("trait") / traits).cast("int").alias("traits"), "block", "trait", "w")
    right = by.repartition("traits", "block").sortWithinPartitions("traits", "block", "trait").mapInArrow(cut_matrix(traits), RIGHT)
    left, right = stored(left, "row-blocks"), stored(right, "matrix-blocks")
    made = in_cells(left, right, cell).mapInArrow(products, PRODUCTS)
    together = made.repartition("rows", "traits").sortWithinPartitions("rows", "traits", "range")
    y = stored(together.mapInArrow(summed(n_samples), "row_idx long, first int, y array<double>, low double, high double, nan boolean"), "products")
    if scale:
        ends = y.groupBy("row_idx").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.max("nan").alias("_nan"))
        span = F.col("_high") - F.col("_low")
        value = lambda v: F.when(F.col("_nan"), F.lit(float("nan"))).when(span == 0, F.lit(1.0)).otherwise(F.lit(2.0) * (v - F.col("_low")) / F.when(span != 0, span))
        y = y.join(ends, "row_idx").withColumn("y", F.transform("y", value))
    whole = y.groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("first", "y"))).alias("_parts")).select("row_idx", F.flatten("_parts.y").alias(out))
    return df.drop(z, out).join(whole, "row_idx")
