"""Hard-negative mining with a pivot table.

Inner products become distances: with a coordinate more, sqrt(M2 - |x|^2) for a row and 0 for a query, |q - x|^2 = |q|^2 + M2 - 2 q.x, M2
being the largest squared length in a shard. Beside its rows a shard stores their distances to a few pivots. By the triangle inequality |d(q, p) - d(x, p)| <= d(q, x)
<= d(q, p) + d(x, p) for each pivot p, so every score lies in a bracket; rows lie in the shard by nearest pivot, and chunks of them whose bracket misses what is
wanted are left out whole, then single rows. What survives is checked exactly.

1. Positives: the best rows of an anchor's own label. Shards are cut by label, and anchors packed by label into blocks.
2. Negatives: for each positive the best rows of other labels whose score lies in its window. One pass serves all windows of an anchor.

Both passes are one search, for the k best of each window of scores; a window's k-th best so far raises its lower end. Every block of the anchors
meets every shard (a stated query set against all rows, in blocks): blocks and shards are dealt into cells of a few of each, so neither a label with a third
of the rows nor a table with many anchors makes a task large, and a task yields k rows a window, not a pair list. Ranked windows merge the cells.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part; vectors of different lengths don't meet; rows with the
anchor's own vec_id are never its positives or negatives; repeated rows are each a row (an anchor that stands twice has its rows twice); an empty vector scores 0; scores are held to
the range of long, and windows are made of scores so held; an empty table gives no rows; only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table, task_uid
from .search import LARGEST

SHARD, CHUNK, BLOCK = 2048, 128, 512
#: Shards and blocks of a cell: some 10**9 scores a task, and a shard travels once for 32,768 anchors.
CELL_SHARDS, CELL_BLOCKS = 16, 64
#: Pivots of a vector length, taken from so many rows, those with the least hashes, each far from the ones before. Lengths that the sample doesn't hold have none.
PIVOTS, SAMPLE = 8, 256
#: Keys with more shards or blocks than a cell takes are sent to all tasks if they are no more than these.
BROADCAST_KEYS = 50_000
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LEAST, MOST = -(2**63), 2**63 - 1

VALID = "vec_id long, label long, dim int, vec binary"
SHARDS = "uid long, dim int, low long, high long, n int, ids binary, labels binary, vecs binary, far binary"
BLOCKS = "block long, dim int, label long, a_n int, aids binary, a_ids binary, a_labels binary, a_vecs binary, p_n binary, p_ids binary, p_scores binary"
FOUND = "aid long, anchor_id long, which int, positive_id long, positive_score long, id long, score long"


def numbers(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.floor(np.clip(np.frombuffer(data, kind).astype(np.float64), -LARGEST, LARGEST) * SCALE).reshape(-1, dim)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def valid(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, label, value in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
                flat = value.values
                if flat.null_count:
                    continue
                v = flat.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(v).all():
                    rows.append((vec_id, label, len(v), v.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["vec_id", "label", "dim", "vec"])

    return run


def far_apart(vectors: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Some of the vectors: the first, then always the one farthest from those taken."""
    if not len(vectors):
        return vectors
    taken, away = [0], ((vectors - vectors[0]) ** 2).sum(1)
    while len(taken) < most and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, ((vectors - vectors[taken[-1]]) ** 2).sum(1))
    return vectors[taken]


def to_pivots(vectors: np.ndarray, more: np.ndarray, pivots: np.ndarray, m2: float) -> np.ndarray:
    """Distances to the pivots (one row a vector); ``more``: the squared added coordinate of each vector, pivots have theirs up to m2."""
    own = np.sqrt(np.maximum(0.0, m2 - (pivots * pivots).sum(1)))
    plain = np.maximum(0.0, (vectors * vectors).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (vectors @ pivots.T))
    return np.sqrt(plain + (np.sqrt(more)[:, None] - own[None, :]) ** 2)


def shards(kind: str, pivots: dict[int, np.ndarray], size: int):
    """Rows sorted by (dim, label) -> packed shards, in each label by nearest pivot, with their distances to the pivots."""

    def packed(uid: int, dim: int, rows: list) -> pa.RecordBatch:
        ids, labels, vecs = zip(*rows)
        x, own = numbers(b"".join(vecs), kind, dim) if dim else np.zeros((len(ids), 0)), pivots.get(dim, np.zeros((0, dim)))
        with np.errstate(over="ignore", invalid="ignore"):
            norms = (x * x).sum(1)
            far = to_pivots(x, norms.max() - norms, own, norms.max())
        labels = np.array(labels, np.int64)
        order = np.lexsort((far.min(1), far.argmin(1), labels)) if far.shape[1] else np.arange(len(ids))
        values = (uid, dim, labels[0], labels[-1], len(ids), np.array(ids, np.int64)[order].tobytes(), labels[order].tobytes(), b"".join(vecs[i] for i in order.tolist()), far[order].tobytes())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["uid", "dim", "low", "high", "n", "ids", "labels", "vecs", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, at, rows = task_uid(), None, []
        for batch in batches:
            for dim, *row in zip(*(batch.column(c).to_pylist() for c in ("dim", "vec_id", "label", "vec"))):
                if rows and (dim != at or len(rows) >= size):
                    yield packed(next(uid), at, rows)
                    rows = []
                at = dim
                rows.append(row)
        if rows:
            yield packed(next(uid), at, rows)

    return run


def by_label(kind: str):
    """Shards -> their runs of one label."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = task_uid()
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                labels = longs(r["labels"])
                ends = [*(np.flatnonzero(np.diff(labels)) + 1).tolist(), r["n"]]
                for s, e in zip([0, *ends], ends):
                    part = {c: r[c][s * w : e * w] for c, w in (("ids", 8), ("labels", 8), ("vecs", r["dim"] * width), ("far", len(r["far"]) // r["n"]))}
                    values = (next(uid), r["dim"], labels[s], labels[s], e - s, *part.values())
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["uid", "dim", "low", "high", "n", "ids", "labels", "vecs", "far"])

    return run


def blocks(size: int, pure: bool):
    """Anchors sorted by (dim, label) -> packed blocks; ``pure``: of one label each."""

    def packed(uid: int, rows: list) -> pa.RecordBatch:
        aids, ids, labels, dims, vecs, p_ids, p_scores = zip(*rows)
        flat = lambda lists: np.array([x for own in lists for x in own], np.int64).tobytes()
        own = [np.array(x, np.int64).tobytes() for x in (aids, ids, labels)]
        values = (uid, dims[0], labels[0], len(rows), *own, b"".join(vecs), np.array([len(x) for x in p_ids], np.int64).tobytes(), flat(p_ids), flat(p_scores))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["block", "dim", "label", "a_n", "aids", "a_ids", "a_labels", "a_vecs", "p_n", "p_ids", "p_scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, at, rows = task_uid(), None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("aid", "vec_id", "label", "dim", "vec", "p_ids", "p_scores"))):
                key = (row[3], row[2] if pure else None)
                if rows and (key != at or len(rows) >= size):
                    yield packed(next(uid), rows)
                    rows = []
                at = key
                rows.append(row)
        if rows:
            yield packed(next(uid), rows)

    return run


class Wanted:
    """For each anchor of a block some windows of scores [low, high], and the k best so far in each, by score, then smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), LEAST, np.int64)
        self.ids = np.full((*low.shape, k), MOST, np.int64)
        self.filled = np.zeros(low.shape, np.int64)
        self.checked = 0  # scores computed exactly

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that an anchor can still use; the least over the greatest where it can use none."""
        low = np.where(self.filled >= self.k, np.maximum(self.low, self.score[..., -1]), self.low)
        open_ = low <= self.high
        return np.where(open_, low, MOST).min(1, initial=MOST), np.where(open_, self.high, LEAST).max(1, initial=LEAST)

    def offer(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, ~score))
        ids, score = ids[order], score[order]
        for w in range(self.low.shape[1]):
            at = np.searchsorted(~score, ~self.high[i, w])
            s, own = score[at : at + self.k], ids[at : at + self.k]
            good = s >= self.low[i, w]
            if not good.any():
                continue
            n = self.filled[i, w]
            s, own = np.concatenate([self.score[i, w, :n], s[good]]), np.concatenate([self.ids[i, w, :n], own[good]])
            top = np.lexsort((own, ~s))[: self.k]
            self.filled[i, w] = len(top)
            self.score[i, w, : len(top)], self.ids[i, w, : len(top)] = s[top], own[top]


def survivors(qq: np.ndarray, qd: np.ndarray, m2: float, far: np.ndarray, low: np.ndarray, high: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """(anchors, rows): whose bracket of scores meets [low, high] of the anchor. qq: squared lengths, qd: distances to the pivots."""
    out = np.zeros((len(qq), len(far)), bool)
    slack = 1e-9 * (qq + m2) + 1.0
    most, least = qq + m2 - 2 * (low - slack), qq + m2 - 2 * (high + slack)  # of the squared distance

    def meets(near: np.ndarray, reach: np.ndarray, own: np.ndarray) -> np.ndarray:
        shape = (-1, *[1] * (near.ndim - 1))
        return (near * near <= most[own].reshape(shape)) & (reach * reach >= least[own].reshape(shape))

    for at in range(0, len(far), chunk):
        t = far[at : at + chunk]
        near = np.maximum(0.0, np.maximum(qd - t.max(0), t.min(0) - qd)).max(1, initial=0.0)
        reach = (qd + t.max(0)).min(1, initial=np.inf)
        own = np.flatnonzero(meets(near, reach, slice(None)) & (low <= high))
        if len(own):
            near, reach = np.zeros((len(own), len(t))), np.full((len(own), len(t)), np.inf)
            for p in range(t.shape[1]):
                np.maximum(near, np.abs(qd[own, p, None] - t[None, :, p]), out=near)
                np.minimum(reach, qd[own, p, None] + t[None, :, p], out=reach)
            out[own, at : at + chunk] = meets(near, reach, own)
    return out


def products(q: np.ndarray, v: np.ndarray, wide: bool) -> np.ndarray:
    """Exact inner products as longs; ``wide``: by Python's integers, held to the range of long."""
    if not wide:
        return (q @ v.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side.tolist()] for side in (q, v)]
    return np.array([[max(LEAST, min(MOST, sum(map(int.__mul__, a, b)))) for b in whole[1]] for a in whole[0]], np.int64).reshape(len(q), len(v))


def meet_shard(wanted: Wanted, q_ids: np.ndarray, q_labels: np.ndarray, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, far: np.ndarray, pivots: np.ndarray, same: bool) -> None:
    """Offer what a shard holds; ``same``: rows of the anchor's label, else of other labels."""
    low, high = wanted.ends()
    wide = q.shape[1] == 0 or np.abs(q).max() * np.abs(v).max() * q.shape[1] >= 2**52
    if wide:
        there = np.broadcast_to((low <= high)[:, None], (len(q), len(v))).copy()
    else:
        qq, m2 = (q * q).sum(1), (v * v).sum(1).max()
        there = survivors(qq, to_pivots(q, np.zeros(len(q)), pivots, m2), m2, far, low.astype(np.float64), high.astype(np.float64))
    there &= ((q_labels[:, None] == labels[None, :]) == same) & (q_ids[:, None] != ids[None, :])
    rows, columns = np.flatnonzero(there.any(1)), np.flatnonzero(there.any(0))
    if not len(rows):
        return
    score = products(q[rows], v[columns], wide)
    wanted.checked += int(there.sum())
    good = there[np.ix_(rows, columns)] & (score >= low[rows, None]) & (score <= high[rows, None])
    for k in np.flatnonzero(good.any(1)).tolist():
        wanted.offer(int(rows[k]), ids[columns[good[k]]], score[k, good[k]])


def windows_of(r: dict, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, positive ids, positive scores), a column a window. Scores are in a positive's window if they are half of its score to 95 in 100 of it."""
    n = r["a_n"]
    if same:
        return np.full((n, 1), LEAST), np.full((n, 1), MOST), np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64)
    sizes = longs(r["p_n"])
    ids, scores = np.zeros((n, max(1, sizes.max())), np.int64), np.full((n, max(1, sizes.max())), -1)
    there = np.arange(ids.shape[1])[None, :] < sizes[:, None]
    ids[there], scores[there] = longs(r["p_ids"]), longs(r["p_scores"])
    low, high = scores // 2 + scores % 2, scores // 100 * 95 + scores % 100 * 95 // 100
    low[~there], high[~there] = MOST, LEAST
    return low, high, ids, scores


def search(kind: str, pivots: dict[int, np.ndarray], same: bool, k: int):
    """Pairs of a block and a shard -> the k best of each window; pairs of one block that follow one another share theirs."""

    def told(r: dict, wanted: Wanted, p_ids: np.ndarray, p_scores: np.ndarray) -> pa.RecordBatch:
        i, w, j = np.nonzero(np.arange(k)[None, None, :] < wanted.filled[..., None])
        columns = (longs(r["aids"])[i], longs(r["a_ids"])[i], w.astype(np.int32), p_ids[i, w], p_scores[i, w], wanted.ids[i, w, j], wanted.score[i, w, j])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["aid", "anchor_id", "which", "positive_id", "positive_score", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if held is None or held[0]["block"] != r["block"]:
                    if held:
                        yield told(*held)
                    low, high, p_ids, p_scores = windows_of(r, same)
                    held = (r, Wanted(low, high, k), p_ids, p_scores)
                dim = r["dim"]
                q, v = (numbers(r[c], kind, dim) if dim else np.zeros((n, 0)) for c, n in (("a_vecs", r["a_n"]), ("vecs", r["n"])))
                own = pivots.get(dim, np.zeros((0, dim)))
                meet_shard(held[1], longs(r["a_ids"]), longs(r["a_labels"]), q, longs(r["ids"]), longs(r["labels"]), v, np.frombuffer(r["far"], np.float64).reshape(r["n"], len(own)), own, same)
        if held:
            yield told(*held)

    return run


def in_cells(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every block with every shard of its key. A key with more of either than a cell takes is a grid of cells: each block is in a row of cells, each shard in
    a column of them."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).join(asked.groupBy(*keys).agg(F.count("*").alias("_a")), keys)
    many = sizes.where((F.col("_n") > CELL_SHARDS) | (F.col("_a") > CELL_BLOCKS)).select(*keys, F.ceil(F.col("_n") / CELL_SHARDS).alias("across"), F.ceil(F.col("_a") / CELL_BLOCKS).alias("down"))
    if many.count() <= BROADCAST_KEYS:
        many = F.broadcast(many)

    def dealt(df: DataFrame, number: str, own: str, other: str, size: str, copies: str) -> DataFrame:
        met = df.join(many, keys, "left").withColumn(own, F.pmod(F.xxhash64(number), F.coalesce(size, F.lit(1))))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(copies, F.lit(1)) - 1))).drop("across", "down")

    return dealt(asked, "block", "y", "x", "down", "across").join(dealt(rows, "uid", "x", "y", "across", "down"), [*keys, "x", "y"])


def best(found: DataFrame, k: int) -> DataFrame:
    """rank: 1 to k, in each window."""
    order = Window.partitionBy("aid", "which").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``label``: what stands for the label, made of the columns of vectors."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    there = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = there.select(F.col("vec_id").cast("long"), (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    good = cut(rows.where("label IS NOT NULL").mapInArrow(valid(kind), VALID), "vectors")
    sample: dict[int, list[bytes]] = {}
    for r in good.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["vec"])
    pivots = {d: far_apart(x) for d, v in sample.items() if d and np.abs(x := numbers(b"".join(v), kind, d)).max() < 2**25}
    order = ["dim", "label"]
    every = cut(good.repartitionByRange(*order, F.xxhash64("vec_id", "vec")).sortWithinPartitions(*order).mapInArrow(shards(kind, pivots, SHARD), SHARDS), "shards")
    no_list = F.array().cast("array<long>")
    asked = cut(good.where(is_anchor).select(F.monotonically_increasing_id().alias("aid"), "*"), "anchors")
    alone = asked.select("*", no_list.alias("p_ids"), no_list.alias("p_scores")).repartitionByRange(*order, "aid").sortWithinPartitions(*order)
    first = cut(alone.mapInArrow(blocks(BLOCK, True), BLOCKS), "blocks")
    parts = every.mapInArrow(by_label(kind), SHARDS).withColumn("label", F.col("low"))
    near = best(in_cells(first, parts, order).mapInArrow(search(kind, pivots, True, positives), FOUND), positives)
    lists = near.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    told = asked.join(lists, "aid").select(*asked.columns, F.col("p.id").alias("p_ids"), F.col("p.score").alias("p_scores"))
    second = cut(told.sortWithinPartitions(*order).mapInArrow(blocks(BLOCK, False), BLOCKS), "blocks")
    met = in_cells(second.drop("label"), every, ["dim"])
    out = cut(met.mapInArrow(search(kind, pivots, False, negatives), FOUND), "negatives")
    for t in (good, every, asked, first, second):
        drop(t)
    return best(out, negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 50; a seventh of the labels move on by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


OP11_SQL = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
