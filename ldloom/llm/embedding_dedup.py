"""Embedding near-dedup with a subspace pigeonhole join.

Unit vectors at cosine c or more are within a squared distance of 2 - 2c. A fixed random rotation spreads that distance
over the axes; the axes are split into blocks of ``BLOCK`` dimensions, and a pair within the whole budget is within the
budget's share of some block. So each block is range-joined under its share: vectors fall into cells as wide as the
radius along several axes of the block, and a cell meets itself and those cells beside it that exist. The more vectors a label has, the
more axes cut it into cells, up to all of the block: a cell is meant to hold a bundle at least. The union over the blocks is verified
exactly, in double precision on the vectors as given; a pair is judged only in the first block that finds it, by one formula on
coordinates that don't depend on the vectors beside it, so none is counted twice or never.

Vectors travel in bundles of about ``BUNDLE`` rows, and bundles of neighbouring cells are compared whole with matrix products; a task
never holds more than two bundles. The left bundles of a cell are dealt in groups of ``PART``, so a cell with many is joined in many
tasks. What comes out is no pair list: per bundle pair the link count of each vector and a
spanning forest of the links, so a group of copies or near copies costs rows in proportion to its size. Equal vectors are
one representative with a count, whatever their number.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing, and so
does one with a null label or id; vectors of different lengths don't link; repeated rows are vectors of their own; an
empty table gives no rows; only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import cut, drop, table
from .components import components

COSINE = 0.93
BLOCK = 8
BUNDLE = 1024
PART = 8

VALID = "vec_id long, label long, dim int, vec binary"
PLACED = "label long, dim int, block int, cell binary, id long, n long, vec binary"
BUNDLES = "label long, dim int, block int, cell binary, bundle int, size int, ids binary, ns binary, vecs binary"
MEETS = "label long, dim int, block int, r_cell binary, l_cell binary"
FOUND = "id long, other long, n long"


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int) -> np.ndarray:
    blocks = max(1, dim // BLOCK)
    return np.array([len(x) for x in np.array_split(np.arange(dim), blocks)]).cumsum()


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance, in proportion to its dimensions, and a little for rounding."""
    return np.diff(block_edges(dim), prepend=0) / dim * (2 - 2 * cosine) * (1 + 1e-9) + 1e-9


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); scaled first, so that squares neither overflow nor vanish."""
    scale = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / scale
    norm = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return scaled / norm, norm * scale


def rotated(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on some rotated axes; summed row by row, so that they are the same whatever rows are beside."""
    return np.einsum("ij,kj->ik", unit, axes)


def axes_used(vectors):
    """Axes along which a label of so many vectors is cut; a cell spans about a quarter of an axis' vectors."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.log(4.0, vectors / BUNDLE)))).cast("int")


def valid(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := valid_rows(batch, kind):
                yield found

    return run


def valid_rows(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch | None:
    rows = []
    for vec_id, label, value in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
        flat = value.values
        if flat is None or flat.null_count or not len(flat):
            continue
        v = flat.to_numpy(zero_copy_only=False)
        if np.isfinite(v).all() and v.any():
            rows.append((vec_id, label, len(v), (v + v.dtype.type(0)).astype(kind).tobytes()))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["vec_id", "label", "dim", "vec"])


def place(cosine: float, kind: str):
    """Each vector's cell in each block: the numbers of its cell along the axes used for its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cuts = batch.column("dim").to_numpy(), batch.column("axes").to_numpy()
            for dim, axes in sorted(set(zip(dims.tolist(), cuts.tolist()))):
                own = batch.filter(pa.array((dims == dim) & (cuts == axes)))
                edges, radius = block_edges(dim), np.sqrt(budgets(dim, cosine))
                for at in range(0, own.num_rows, 2000):
                    part = own.slice(at, 2000)
                    v = np.frombuffer(b"".join(part.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                    unit = units(v)[0]
                    for block, (lo, hi) in enumerate(zip([0, *edges.tolist()], edges.tolist())):
                        used = rotation(dim)[lo : min(hi, lo + axes)]
                        cells = np.floor(rotated(unit, used) / radius[block]).astype(">i4")
                        codes = pa.array([c.tobytes() for c in cells], pa.binary())
                        yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array([block] * part.num_rows, pa.int32()), codes, part.column("id"), part.column("n"), part.column("vec")], names=["label", "dim", "block", "cell", "id", "n", "vec"])

    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells -> the cells at most one step away along each axis that come no earlier: every two cells meet once."""
    steps: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, cell in enumerate(batch.column("cell").to_pylist()):
            own = np.frombuffer(cell, ">i4")
            if len(own) not in steps:
                every = np.array(list(product((-1, 0, 1), repeat=len(own))), np.int32)
                steps[len(own)] = every[len(every) // 2 :]  # in order: from no step at all on
            beside = (own + steps[len(own)]).astype(">i4")
            row = batch.slice(i, 1).take(pa.array(np.zeros(len(beside), np.int64)))
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("label", "dim", "block", "cell")), pa.array([c.tobytes() for c in beside], pa.binary())], names=["label", "dim", "block", "r_cell", "l_cell"])


def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, dim, block, cell, bundle) to one row for each run."""
    key, rows = None, []

    def packed() -> pa.RecordBatch:
        ids, ns, vecs = zip(*rows)
        values = [[x] for x in (*key, len(ids), np.array(ids, np.int64).tobytes(), np.array(ns, np.int64).tobytes(), b"".join(vecs))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 3)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["label", "dim", "block", "cell", "bundle", "size", "ids", "ns", "vecs"])

    for batch in batches:
        for *own, i, n, vec in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "block", "cell", "bundle", "id", "n", "vec"))):
            if own != key:
                if rows:
                    yield packed()
                key, rows = own, []
            rows.append((i, n, vec))
    if rows:
        yield packed()


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and the links (x, y): the smallest node that each can reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        new = new[new]
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == least).all():
            return least
        least = new


STEP = 1 << 15


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((p - q) ** 2).sum(1)


def compare(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                dim, block = r["dim"], r["block"]
                edges, share = block_edges(dim), budgets(dim, cosine)
                lo = np.concatenate([[0], edges[:-1]])
                same = r["l_cell"] == r["r_cell"] and r["l_bundle"] == r["r_bundle"]
                side = []
                for s in "lr":
                    v = np.frombuffer(r[f"{s}_vecs"], kind).reshape(-1, dim).astype(np.float64)
                    u = units(v)[0]
                    side.append((np.frombuffer(r[f"{s}_ids"], np.int64), np.frombuffer(r[f"{s}_ns"], np.int64), u, rotated(u, rotation(dim)[: edges[block]])))
                (ids_a, n_a, u_a, t_a), (ids_b, n_b, u_b, t_b) = side
                p, q = t_a[:, lo[block] :], t_b[:, lo[block] :]
                close = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T) <= share[block] + 1e-9  # none within is left out
                x, y = np.nonzero(np.triu(close, 1) if same else close)
                for j in [block, *range(block)]:  # within this block, and in none before
                    near = np.concatenate([np.zeros(0, bool), *(apart(t_a[x[c : c + STEP], lo[j] : edges[j]], t_b[y[c : c + STEP], lo[j] : edges[j]]) <= share[j] for c in range(0, len(x), STEP))])
                    x, y = (x[near], y[near]) if j == block else (x[~near], y[~near])
                ok = np.zeros(len(x), bool)
                for at in range(0, len(x), STEP):
                    ok[at : at + (STEP)] = np.einsum("ij,ij->i", u_a[x[at : at + (STEP)]], u_b[y[at : at + (STEP)]]) >= cosine
                x, y = x[ok], y[ok]
                if not len(x):
                    continue
                links_a = np.bincount(x, n_b[y], len(ids_a)).astype(np.int64)
                links_b = np.bincount(y, n_a[x], len(ids_b)).astype(np.int64)
                if same:
                    ids, reach = ids_a, forest(len(ids_a), x, y)
                    links_a, links_b = links_a + links_b, np.zeros(0, np.int64)
                else:
                    ids, reach = np.concatenate([ids_a, ids_b]), forest(len(ids_a) + len(ids_b), x, y + len(ids_a))
                links = np.concatenate([links_a, links_b])
                linked, joined = np.flatnonzero(links), np.flatnonzero(reach != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[linked], ids[joined]])),
                        pa.array([None] * len(linked) + ids[reach[joined]].tolist(), pa.int64()),
                        pa.array(np.concatenate([links[linked], np.zeros(len(joined), np.int64)])),
                    ],
                    names=["id", "other", "n"],
                )

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    every = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    kind = "<f4" if isinstance(every.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    good = cut(every.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(valid(kind), VALID), "vectors")
    reps = cut(good.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "reps")
    of_label = reps.groupBy("label", "dim").agg(axes_used(F.count("*")).alias("axes"))
    placed = reps.join(of_label, ["label", "dim"]).select("id", "n", "label", "dim", "axes", "vec").mapInArrow(place(cosine, kind), PLACED)
    cell = ["label", "dim", "block", "cell"]
    sizes = cut(placed.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / BUNDLE).cast("int").alias("bundles")), "cells")
    dealt = placed.join(sizes, cell).withColumn("bundle", F.pmod(F.xxhash64("id"), "bundles").cast("int"))
    key = [*cell, "bundle"]
    bundles = cut(dealt.repartition(*key).sortWithinPartitions(*key).select(*key, "id", "n", "vec").mapInArrow(bundle, BUNDLES), "bundles")
    there = sizes.select("label", "dim", "block", F.col("cell").alias("l_cell"), F.ceil(F.col("bundles") / PART).cast("int").alias("parts"))
    meets = sizes.select(*cell).mapInArrow(neighbours, MEETS).join(there, ["label", "dim", "block", "l_cell"])
    named = lambda s: bundles.select("label", "dim", "block", *(F.col(c).alias(f"{s}_{c}") for c in ("cell", "bundle", "ids", "ns", "vecs")))
    right = named("r").join(meets, ["label", "dim", "block", "r_cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left = named("l").withColumn("part", F.floor(F.col("l_bundle") / PART).cast("int"))
    met = left.join(right, ["label", "dim", "block", "l_cell", "part"]).where("l_cell != r_cell OR l_bundle <= r_bundle")
    found = cut(met.mapInArrow(compare(cosine, kind), FOUND), "found")
    links = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("links"))
    of_row = good.join(reps, ["label", "dim", "vec"]).select("vec_id", "id", "n")
    of_row = cut(of_row.join(links, "id", "left").select("vec_id", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "rows")
    roots = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(of_row.select(F.col("id").alias("a"), F.col("vec_id").alias("b"))))
    for t in (bundles, sizes, found, reps, good):
        drop(t)
    rest = every.where("vec_id IS NULL OR label IS NULL OR embedding IS NULL").select("vec_id")
    bad = every.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(
        (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(True)))
    )
    alone = rest.unionByName(bad.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    all_rows = of_row.select("vec_id", "n_links").unionByName(alone)
    component = F.coalesce("root", "vec_id")
    out = all_rows.join(roots, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", F.col("n_links").cast("long"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked with those of their label at a cosine of 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
