"""Exact top-k by integer inner product with MaxScore.

A dimension is a term, with the sign of the query's weight on it: of its posting list a shard knows the largest and the
smallest value, which bound what the term can add. Per query, terms are sorted by bound; those whose bounds together
stay below the k-th best score so far are non-essential. Queries with the same essential terms are scored on these alone for a chunk of
vectors at once (a product over those columns, the others aren't read); the others are probed only for vectors whose score plus the bounds that remain still reaches the k-th best. Each shard
yields k rows a query, and a ranked window merges the shards.

Vectors are packed into shards of ``SHARD`` rows and queries into blocks of ``QUERIES`` rows; every query block meets
every shard (a stated query set against all rows, in blocks). They meet in cells, by a shuffle whatever their size: a broadcast would put the queries' copies, one for each column
of cells, into the driver. A task holds one block and one shard. Copies of a vector are ordinary rows: ties go to the smaller vec_id.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, neither as query nor as candidate; vectors of
different lengths don't meet; a null id is no query and no candidate; repeated rows (one id twice) are each a candidate,
never of their own id; sums beyond 2**53 are computed with exact integers and held to the range of long; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARD = 4096
CHUNK = 512
QUERIES = 512
#: Blocks and shards of a cell. Up to ``COLUMNS`` shards have a column of cells each, so that few rows are searched in as many tasks.
CELL_BLOCKS = CELL_SHARDS = 16
COLUMNS = 64
TASKS = 10_000
K = 10
SCALE = 1024
PACKED = "dim int, n int, ids binary, values binary"
FOUND = "query_id long, vec_id long, score long"
LONG = 2**63 - 1
#: Components beyond are taken as this, so that their multiples stay finite; scores of such vectors end at long's range anyway.
LARGEST = 2.0**1000


def bundle(size: int):
    """Vectors of one length packed as rows of (ids, float64 values): at most ``size`` of them each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, values = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.concatenate(values).tobytes()])], names=["dim", "n", "ids", "values"])

        for batch in batches:
            for vec_id, value in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                flat = value.values
                if flat.null_count or vec_id is None:
                    continue
                v = flat.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                values.append(np.floor(np.clip(v, -LARGEST, LARGEST) * SCALE))
                if len(ids) >= size:
                    yield row(len(v))
        for dim in list(held):
            yield row(dim)

    return run


def unpack(dim: int, n: int, ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.float64).reshape(n, dim)


class Best:
    """The k best of each query so far, by score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.touched = 0  # terms added to scores, of queries x vectors x dimensions
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def threshold(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        top = np.lexsort((i, -s))[: self.k]
        self.score[q], self.ids[q] = s[top], i[top]


def essential(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, their essential terms) for every distinct set of essential terms."""
    kinds, of = np.unique(np.packbits(mask, axis=1), axis=0, return_inverse=True)
    by_kind = np.argsort(of.ravel(), kind="stable")
    for group in np.split(by_kind, np.cumsum(np.bincount(of.ravel(), minlength=len(kinds)))[:-1]):
        yield group, np.flatnonzero(mask[group[0]])


def probe(best: Best, i: int, q, c, c_ids, own, score, rest, floor, order, spare, bound) -> None:
    """Add query i's non-essential terms to its candidates ``own``, the largest bounds first; what can't compete drops out."""
    left = rest[i]
    for term in order[i, : spare[i]][::-1].tolist():
        keep = score + left >= floor[i]
        own, score = own[keep], score[keep]
        if not len(own):
            return
        score = score + q[i, term] * c[own, term]
        best.touched += len(own)
        left -= bound[i, term]
    best.offer(i, c_ids[own], score)


def maxscore(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int = K, chunk: int = CHUNK) -> Best:
    best = Best(len(q), k)
    high, low = v.max(0), v.min(0)
    bound = np.maximum(q * high, q * low)  # the most that a term can add in this shard
    order = np.argsort(bound, axis=1, kind="stable")  # least first: non-essential terms are a prefix of it
    upto = np.cumsum(np.take_along_axis(bound, order, 1), 1)
    rank = np.argsort(order, axis=1)
    columns = np.ascontiguousarray(v.T)  # a posting list a term
    for at in range(0, len(ids), chunk):
        c_ids, c = ids[at : at + chunk], v[at : at + chunk]
        floor = best.threshold()
        spare = (upto < floor[:, None]).sum(1)  # so many terms can't lift a vector over the k-th best by themselves
        rest = np.where(spare > 0, np.take_along_axis(upto, np.maximum(spare - 1, 0)[:, None], 1)[:, 0], 0.0)
        for group, terms in essential(rank >= spare[:, None]):
            part = q[np.ix_(group, terms)] @ columns[terms, at : at + len(c)]
            best.touched += part.size * len(terms)
            alive = part + rest[group][:, None] >= floor[group][:, None]
            alive &= q_ids[group][:, None] != c_ids[None, :]
            for row in np.flatnonzero(alive.any(1)):
                own = np.flatnonzero(alive[row])
                probe(best, group[row], q, c, c_ids, own, part[row, own], rest, floor, order, spare, bound)
    return best


def exact(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """For numbers too large for float64: Python's integers."""
    vs, out = [[int(x) for x in r] for r in v.tolist()], []
    for a, x in zip(q_ids.tolist(), q.tolist()):
        x = [int(t) for t in x]
        scored = sorted((-sum(map(int.__mul__, x, y)), b) for b, y in zip(ids.tolist(), vs) if a != b)[:k]
        out += [(a, b, max(-LONG - 1, min(LONG, -s))) for s, b in scored]
    return out


def search_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = unpack(r["dim"], r["qn"], r["qids"], r["qvalues"])
                ids, v = unpack(r["dim"], r["n"], r["ids"], r["values"])
                if r["dim"] == 0 or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * r["dim"] >= 2**52:
                    rows = exact(q_ids, q, ids, v, k)
                else:
                    best = maxscore(q_ids, q, ids, v, k)
                    found = np.isfinite(best.score)
                    rows = list(zip(np.repeat(q_ids, found.sum(1)).tolist(), best.ids[found].tolist(), best.score[found].astype(np.int64).tolist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: the condition that picks the queries among the rows."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding IS NOT NULL")
    shards = cut(rows.mapInArrow(bundle(SHARD), PACKED), "shards")
    asked = cut(rows.where(is_query).mapInArrow(bundle(QUERIES), PACKED), "queries")
    # A grid of cells, each with few shards and few query blocks: no key of the join gathers more than a cell.
    n = shards.count()
    across, down = max(1, min(n, COLUMNS), -(-n // CELL_SHARDS)), max(1, -(-asked.count() // CELL_BLOCKS))
    tasks = min(across * down, TASKS)
    number = F.monotonically_increasing_id()  # of a row of a written table
    left = shards.withColumn("x", F.pmod(F.xxhash64(number), F.lit(across)).cast("long")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = asked.select("dim", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("values").alias("qvalues"), F.pmod(F.xxhash64(number), F.lit(down)).cast("int").alias("y"))
    right = right.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    cell = ["dim", "x", "y"]
    met = left.repartition(tasks, *cell).hint("merge").join(right.repartition(tasks, *cell), cell)
    found = met.mapInArrow(search_blocks(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for each vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
