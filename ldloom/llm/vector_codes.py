"""Vector code compression (product quantisation in integers) by Heap Lloyd.

A vector's components become integers, its 8 equal parts each get the number of the nearest of 16 codebook entries. Lloyd's rounds
look again only at parts that may have changed: in each bundle of vectors (the partition of the work) every entry of a codebook has a heap
of the parts assigned to it. A part's key is its slack, the distance to the second nearest entry minus that to its own (a lower minus an
upper bound), plus the entry's cumulative drift when it was pushed; an entry's drift grows each round by its own
move and the largest move of any other. As long as the key is over the drift, no other entry can have become as near, and the heap isn't
touched below its top. Parts whose key the drift has passed are popped and rescanned exactly, in integers, so ties and results are those of the plain
method. Only parts that change their entry alter the sums, so a round's shuffle holds differences: sums of integers, exact in any order.

Vectors are written once, in bundles, into a table bucketed by bundle; each round's heaps are written to a table bucketed alike, so that the join of
both moves nothing, a lost executor costs a task, and a round reads what the last wrote. Codebooks (16 times a vector) and drifts
are all that the driver holds.

Defined cases: vectors that are null, or hold a null or non-finite component, are dropped, as are those whose length isn't a positive
multiple of 8; vectors of each length have codebooks of their own; the first entries come from the smallest vec_ids, ties by the vectors' bytes, null ids
last, fewer than 16 where fewer are kept; repeated rows are rows of their own; components too large for exact products of float64 are
computed with Python's integers, sums and errors held to the range of long only where they are returned; an empty table gives no rows; only vec_id, label
and embedding are read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete_on_exit, drop, remove, shared_folder, table, task_uid

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of the vectors of a bundle, and bytes of them that a bucket of bundles is meant to hold.
BUNDLE_VALUES, BUCKET_BYTES = 1 << 17, 64 << 20
#: Integers under this have exact squared distances in float64, for parts of up to 2**11 components; larger ones go the long way.
SMALL = 1 << 20
#: Sums of larger integers are added as digits of so many bits.
DIGIT = 24
#: Labels this few meet the rows by broadcast; among more, those with over a thousandth of all rows do, 1,000 at most.
BROADCAST_LABELS = 50_000
LONG = 2**63 - 1

BUNDLES = "bundle long, n int, ids binary, labels binary, values binary"
STATE = "bundle long, codes binary, keys binary, rows binary, sizes binary, changes array<struct<part: int, entry: int, n: long, sums: array<long>>>, looked long"
CODED = "vec_id long, label long, code string, error decimal(38,0)"


def integers(vectors: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x), as int64 or as Python's integers."""
    if not wide:
        return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)
    out = np.empty(vectors.shape, object)
    out[...] = [[(num * SCALE) // den for num, den in (x.as_integer_ratio() for x in row)] for row in vectors.astype(np.float64).tolist()]
    return out


def parts_of(values: np.ndarray) -> np.ndarray:
    """(rows, parts, components of a part)."""
    return values.reshape(len(values), PARTS, -1)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) of one part position to its entries; exact."""
    if parts.dtype == object:
        return np.array([[sum(((x - c) ** 2).tolist()) for c in book] for x in parts], object).reshape(len(parts), len(book))
    x, c = parts.astype(np.float64), book.astype(np.float64)
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the least distance, ties to the lower number; slack between the second least and the least, as distances)."""
    best = np.array(d.argmin(1), np.int64)
    if d.dtype == object or d.shape[1] < 2:  # never trusted over a round, or no other entry to go to
        return best, np.full(len(d), -math.inf if d.dtype == object else math.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2])
    return best, two[:, 1] - two[:, 0]


class Heaps:
    """For each part position and entry of a bundle a heap of (key, row); as arrays in a row of a table."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        self.held = [(keys[e - n : e], rows[e - n : e]) for n, e in zip(sizes.tolist(), ends.tolist())]

    @classmethod
    def empty(cls, entries: int) -> Heaps:
        return cls(np.zeros(0), np.zeros(0, np.int32), np.zeros(PARTS * entries, np.int64))

    def pop(self, at: int, drift: float) -> list[int]:
        """Rows whose key isn't over the drift. A heap whose top is, is left as it is."""
        keys, rows = self.held[at]
        if not len(keys) or keys[0] > drift:
            return []
        heap, out = list(zip(keys.tolist(), rows.tolist())), []  # a heap's array is a heap
        while heap and heap[0][0] <= drift:
            out.append(heapq.heappop(heap)[1])
        self._hold(at, heap)
        return out

    def push(self, at: int, more: list[tuple[float, int]]) -> None:
        keys, rows = self.held[at]
        heap = list(zip(keys.tolist(), rows.tolist()))
        if len(more) > len(heap):
            heap += more
            heapq.heapify(heap)
        else:
            for x in more:
                heapq.heappush(heap, x)
        self._hold(at, heap)

    def _hold(self, at: int, heap: list[tuple[float, int]]) -> None:
        keys, rows = zip(*heap) if heap else ((), ())
        self.held[at] = np.array(keys, np.float64), np.array(rows, np.int32)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows = zip(*self.held)
        return np.concatenate(keys), np.concatenate(rows), np.array([len(x) for x in keys], np.int64)


def assign(values: np.ndarray, codes: np.ndarray | None, heaps: Heaps | None, books: np.ndarray, drifts: np.ndarray) -> tuple[np.ndarray, Heaps, list, int]:
    """One assignment of a bundle: (codes, heaps, what changes in the sums, parts looked at). No heaps yet: all parts are looked at."""
    parts, entries = parts_of(values), books.shape[1]
    first = heaps is None
    heaps = Heaps.empty(entries) if first else heaps
    codes = np.full((len(values), PARTS), -1, np.int64) if first else codes.copy()
    changes, looked = [], 0
    for p in range(PARTS):
        rows = np.arange(len(values)) if first else np.sort(np.array([r for e in range(entries) for r in heaps.pop(p * entries + e, drifts[p, e])], np.int64))
        if not len(rows):
            continue
        looked += len(rows)
        best, slack = nearest(distances(parts[rows, p], books[p]))
        old = codes[rows, p]
        codes[rows, p] = best
        keys = slack + drifts[p][best]
        for e in np.unique(best).tolist():
            own = best == e
            heaps.push(p * entries + e, list(zip(keys[own].tolist(), rows[own].tolist())))
        moved = old != best
        for e in np.unique(np.concatenate([old[moved], best[moved]])).tolist():
            if e >= 0:
                came, went = rows[moved & (best == e)], rows[moved & (old == e)]
                changes.append((p, e, len(came) - len(went), parts[came, p].sum(0) - parts[went, p].sum(0)))
    return codes, heaps, changes, looked


def digits(sums: np.ndarray, count: int) -> list[int]:
    """Each sum as ``count`` digits, the last with the sign; they may be added up by themselves."""
    out = []
    for x in sums.tolist():
        for _ in range(count - 1):
            out.append(x & ((1 << DIGIT) - 1))
            x >>= DIGIT
        out.append(x)
    return out


def bundled(rows_each: int):
    """Vectors as rows of ``rows_each`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, held = task_uid(), []

        def row() -> pa.RecordBatch:
            ids, labels, vecs = zip(*held)
            tell = lambda c: pa.array(c, pa.int64())
            packed = [pa.array([_stored(tell(c))], pa.binary()) for c in (ids, labels)]
            return pa.RecordBatch.from_arrays([tell([next(uid)]), pa.array([len(ids)], pa.int32()), *packed, pa.array([b"".join(vecs)])], names=["bundle", "n", "ids", "labels", "values"])

        for batch in batches:
            for one in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vec"))):
                held.append(one)
                if len(held) >= rows_each:
                    yield row()
                    held = []
        if held:
            yield row()

    return run


def _stored(column: pa.Array) -> bytes:
    """Longs with nulls as bytes: which are there, then all of them."""
    there = np.array(column.is_valid())
    return there.astype(np.uint8).tobytes() + column.fill_null(0).to_numpy().astype("<i8").tobytes()


def _read(data: bytes, n: int) -> pa.Array:
    there = np.frombuffer(data, np.uint8, n).astype(bool)
    return pa.array(np.frombuffer(data, "<i8", n, n), mask=~there)


def look(dim: int, kind: str, wide: bool, books: np.ndarray, drifts: np.ndarray, count: int):
    """A round over bundles with their heaps (none in the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                values = integers(np.frombuffer(r["values"], kind).reshape(-1, dim), wide)
                codes = heaps = None
                if r.get("codes") is not None:
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, PARTS).astype(np.int64)
                    heaps = Heaps(np.frombuffer(r["keys"], np.float64), np.frombuffer(r["rows"], np.int32), np.frombuffer(r["sizes"], np.int64))
                codes, heaps, changes, looked = assign(values, codes, heaps, books, drifts)
                state = [codes.astype(np.uint8), *heaps.arrays()]
                told = [{"part": p, "entry": e, "n": n, "sums": digits(s, count)} for p, e, n, s in changes]
                kinds = (pa.int64(), *[pa.binary()] * 4, CHANGES, pa.int64())
                columns = [r["bundle"], *(x.tobytes() for x in state), told, looked]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds)], names=["bundle", "codes", "keys", "rows", "sizes", "changes", "looked"])

    return run


CHANGES = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def tell(dim: int, kind: str, wide: bool, books: np.ndarray):
    """Bundles with their codes -> a row a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                parts = parts_of(integers(np.frombuffer(r["values"], kind).reshape(-1, dim), wide))
                codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, PARTS)
                off = (parts - books[np.arange(PARTS)[None, :], codes.astype(np.int64)]).reshape(len(parts), -1)
                error = (off * off).sum(1).tolist()
                code = [row.tobytes().hex() for row in codes]
                columns = [_read(r["ids"], r["n"]), _read(r["labels"], r["n"]), pa.array(code, pa.string()), pa.array([_decimal(e) for e in error], pa.decimal128(38, 0))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(min(x, LONG))


def valid(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, label, value in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
                flat = value.values
                if flat is None or flat.null_count or not len(flat) or len(flat) % PARTS:
                    continue
                v = flat.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(v).all():
                    rows.append((vec_id, label, len(v), float(np.abs(v).max()), v.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["vec_id", "label", "dim", "most", "vec"])

    return run


class Bucketed:
    """Tables bucketed by bundle in the shared folder: a join of two moves no rows. ``close`` drops all that are left."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"codes_{uuid.uuid4().hex}"
        delete_on_exit(self.spark, path := f"{shared_folder(self.spark)}/{name}")
        self.names.append(name)
        df.write.bucketBy(self.buckets, "bundle").option("compression", "zstd").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """All but the first ``keep``."""
        for name in self.names[keep:]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{shared_folder(self.spark)}/{name}")
        del self.names[keep:]


def moved(books: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What each entry's drift grows by: its own move and the largest of any other, and a little for rounding."""
    off = (new - books).reshape(PARTS, books.shape[1], -1)
    if off.dtype == object:
        return np.zeros(books.shape[:2])  # their keys are never over any drift
    move = np.sqrt((off.astype(np.float64) ** 2).sum(2))
    top = np.sort(move, axis=1)
    others = np.where(move == top[:, -1:], top[:, -2:-1], top[:, -1:]) if move.shape[1] > 1 else np.zeros_like(move)
    return (move + others) * (1 + 1e-9) + 1e-6


def codebooks(bundles: DataFrame, tables: Bucketed, first: np.ndarray, dim: int, kind: str, wide: bool, count: int, rounds: int) -> tuple[np.ndarray, DataFrame, list[int]]:
    """(entries after all rounds, the bundles' codes for them, parts looked at in each assignment). first: (parts, entries, components)."""
    books, drifts = first, np.zeros(first.shape[:2])
    totals, sizes = np.zeros(first.shape, object), np.zeros(first.shape[:2], np.int64)
    state, looked = None, []
    for turn in range(rounds + 1):
        rows = bundles if state is None else bundles.join(state.drop("changes", "looked"), "bundle")
        state = tables.write(rows.mapInArrow(look(dim, kind, wide, books, drifts, count), STATE))
        looked.append(state.agg(F.sum("looked")).first()[0])
        if turn:  # the round before has been read
            old = tables.names.pop(-2)
            tables.spark.sql(f"DROP TABLE IF EXISTS {old}")
            remove(tables.spark, f"{shared_folder(tables.spark)}/{old}")
        if turn == rounds:
            break
        each = state.select(F.explode("changes").alias("c")).select("c.part", "c.entry", "c.n", F.posexplode("c.sums").alias("place", "value"))
        sums = each.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
        for r in sums.collect():  # no more than the numbers in a set of codebooks
            place, power = divmod(r["place"], count)
            totals[r["part"], r["entry"], place] += r["value"] << (DIGIT * power)
            if not r["place"]:
                sizes[r["part"], r["entry"]] += r["n"]
        new = books.copy()
        for p, e in np.argwhere(sizes > 0).tolist():
            new[p, e] = [t // int(sizes[p, e]) for t in totals[p, e].tolist()]
        drifts = drifts + moved(books, new)
        books = new
    return books, state, looked


def of_length(rows: DataFrame, dim: int, kind: str, most: float, n: int, rounds: int) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of the vectors of one length: a table of its own."""
    spark = rows.sparkSession
    wide = most * SCALE >= SMALL or dim > PARTS << 11
    count = 1 if not wide else 2 + int(math.log2(max(1.0, most)) + 13) // DIGIT
    starts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    first = parts_of(integers(np.array([np.frombuffer(r["vec"], kind) for r in starts]), wide)).swapaxes(0, 1).copy()
    each = max(1, BUNDLE_VALUES // dim)
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tables = Bucketed(spark, min(max(least, n * dim * np.dtype(kind).itemsize // BUCKET_BYTES), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    try:
        packed = rows.select("vec_id", "label", "vec").mapInArrow(bundled(each), BUNDLES)
        bundles = tables.write(packed.repartition(tables.buckets, "bundle"))
        books, state, _ = codebooks(bundles, tables, first, dim, kind, wide, count, rounds)
        digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
        coded = bundles.join(state.select("bundle", "codes"), "bundle").select("n", "ids", "labels", "values", "codes").mapInArrow(tell(dim, kind, wide, books), CODED)
        return cut(coded.withColumn("codebooks_sha256", F.lit(digest)), "coded")
    finally:
        tables.drop()


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error, the errors' sum over equal labels. Sums are made in each task first; rows of labels that hold much meet their sum by broadcast."""
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), "label-errors")
    labels, n = sums.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    large = sums if labels <= BROADCAST_LABELS else sums.where(F.col("size") > n / 1000)
    met = coded.join(F.broadcast(large), coded["label"].eqNullSafe(large["of"]), "left")
    found = met.where("size IS NOT NULL").select(*coded.columns, "label_error")
    if labels <= BROADCAST_LABELS:
        return found
    rest = met.where("size IS NULL").select(*coded.columns)
    small = sums.where(F.col("size") <= n / 1000)
    return found.unionByName(rest.join(small, rest["label"].eqNullSafe(small["of"])).select(*coded.columns, "label_error"))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row per vector that is kept."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    every = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where("embedding IS NOT NULL")
    good = cut(every.mapInArrow(valid(kind), "vec_id long, label long, dim int, most double, vec binary"), "vectors")
    lengths = good.groupBy("dim").agg(F.max("most").alias("most"), F.count("*").alias("n")).orderBy("dim").collect()  # a row a length
    made = [of_length(good.where(F.col("dim") == r["dim"]), r["dim"], kind, r["most"], r["n"], rounds) for r in lengths]
    drop(good)
    if not made:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = made[0]
    for more in made[1:]:
        coded = coded.unionByName(more)
    held = lambda c: F.least(F.col(c), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias(c)
    return with_label_error(coded).select("vec_id", "code", held("error"), held("label_error"), "codebooks_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 8 codes of 16 entries, after 6 rounds."""
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """For tables whose vectors have one length: each round as two named queries."""
    out = """WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS x, len(embedding) // 8 AS w
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, list_slice(x, p * w + 1, p * w + w) AS x FROM v, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM x QUALIFY k < 16)"""
    for i in range(ROUNDS + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 16 + k) AS least FROM x JOIN b{i} USING (p) GROUP BY vec_id, p)"""
        if i < ROUNDS:
            out += f""",
m{i} AS (SELECT p, k, list(c ORDER BY j) AS c FROM (SELECT p, least % 16 AS k, j, floor(sum(x[j]) / count(*)) AS c FROM a{i}, generate_series(1, (SELECT max(w) FROM v)) t(j) GROUP BY p, least % 16, j) GROUP BY p, k),
b{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, k))"""
    return out + f""",
e AS (SELECT vec_id, string_agg(printf('%02x', least % 16), '' ORDER BY p) AS code, sum(least // 16)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(c) AS c, generate_subscripts(c, 1) AS j FROM b{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"""


OP12_SQL = _sql()
