"""Hard negatives, vector codes and best-fit packing: against plain versions, SQL and bounds."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from test_operators import encoded, odd_texts, odd_vectors, write

from ldloom.llm import best_fit, hard_negatives, vector_codes
from ldloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    return folder, write(folder, odd_texts(), odd_vectors())


def finite(vectors):
    return [(i, v, label) for i, v, label in vectors if v is not None and None not in v and np.isfinite(v).all()]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert len(want) > 100 and sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def plain_negatives(vectors):
    """The contract's words, one anchor at a time; vectors: (id, integers, label)."""
    moved = [(i, x, (label + 1) % 10 if i % 7 == 0 else label) for i, x, label in vectors if i is not None and label is not None]
    out = []
    for a, x, label in (r for r in moved if r[0] % 50 == 0):
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, y, other in moved if i != a and len(x) == len(y))
        for s, i, _ in [r for r in scored if r[2]][:5]:
            found = [(n, j) for n, j, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a, i, k + 1, j, -s, -n) for k, (n, j) in enumerate(found)]
    return sorted(out)


def quantised(vectors, scale):
    return [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], label) for i, v, label in finite(vectors)]


@pytest.mark.parametrize("sizes", [(2048, 512, 16, 64), (7, 2, 2, 1)])
def test_op11(spark, odd, tmp_path, monkeypatch, sizes):
    for name, n in zip(("SHARD", "BLOCK", "CELL_SHARDS", "CELL_BLOCKS"), sizes):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 64))
    many = [(i, (centres[i % 6] + rng.choice([0.05, 0.5, 1.5]) * rng.standard_normal(64)).tolist(), int(i % 6 if rng.random() < 0.5 else rng.integers(12)) - 1) for i in range(-50, 350)]
    many += [(-50, many[4][1], 2), (50, many[100][1], many[100][2]), (800, [0.0] * 64, 1), (850, [3.0] * 64, None), (850, [3.0, 4.0], 3), (900, [], 1)]
    many += [(i, [1.0, 2.0, float(i % 3)], i % 2) for i in range(1000, 1060)]
    for folder, vectors in ((odd[0], odd_vectors()), (str(tmp_path), many)):
        if folder != odd[0]:
            write(folder, [], vectors)
        got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in QUERIES["op11_hard_negatives"](spark, folder).collect())
        want = plain_negatives(quantised(vectors, 256))
        if folder != odd[0]:  # an anchor id with two rows: each has its own, ranked by themselves
            assert len(want) > 50
        assert got == want


def test_scores_beyond_exact_floats(spark):
    vectors = [(50 * (i == 0) + i, [10.0**15 * (1 + i), 3.0, -1.0 / (i + 1)], i % 2) for i in range(20)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())
    assert {r[0] for r in got} <= {50} and all(r[5] <= 2**63 - 1 for r in got)


def test_brackets_leave_out_no_score_and_many_rows():
    rng = np.random.default_rng(0)
    centres, share = 60 * rng.standard_normal((20, 64)), []
    near = np.floor(centres[rng.integers(0, 20, 3000)] + 4 * rng.standard_normal((3000, 64)))
    for v in (near, np.floor(40 * rng.standard_normal((3000, 64)))):
        pivots, norms = hard_negatives.far_apart(v[:256]), (v * v).sum(1)
        m2 = norms.max()
        far = hard_negatives.to_pivots(v, m2 - norms, pivots, m2)
        order = np.lexsort((far.min(1), far.argmin(1)))
        v, far, q = v[order], far[order], v[rng.integers(0, 3000, 40)]
        score = q @ v.T
        low, high = np.quantile(score, 0.97, axis=1), np.quantile(score, 0.99, axis=1)
        there = hard_negatives.survivors((q * q).sum(1), hard_negatives.to_pivots(q, np.zeros(len(q)), pivots, m2), m2, far, low, high)
        assert there[(score >= low[:, None]) & (score <= high[:, None])].all()
        share.append(there.mean())
    assert share[0] < 0.6


def plain_codes(rows, rounds=6):
    """rows: (id, integers) in order; (codes, errors, entries) by looking at everything, in Python's integers."""
    parts = [[r[p * len(r) // 8 : (p + 1) * len(r) // 8] for p in range(8)] for _, r in rows]
    books = [[list(parts[i][p]) for i in range(min(16, len(rows)))] for p in range(8)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (apart(own[p], books[p][e]), e)) for p in range(8)] for own in parts]
        if turn == rounds:
            break
        for p in range(8):
            for e in range(len(books[p])):
                of = [own[p] for own, c in zip(parts, codes) if c[p] == e]
                if of:
                    books[p][e] = [sum(x) // len(of) for x in zip(*of)]
    errors = [sum(apart(own[p], books[p][c[p]]) for p in range(8)) for own, c in zip(parts, codes)]
    return codes, errors, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def coded(spark, folder):
    return [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in QUERIES["op12_vector_codes"](spark, folder).collect()]


def test_op12(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_codes, "BUNDLE_VALUES", 640)  # bundles of ten vectors
    rng = np.random.default_rng(9)
    ties = [(i, rng.integers(-2, 3, 16).astype(float).tolist(), None if i % 3 else i % 2) for i in range(120)]
    for folder, vectors in ((odd[0], odd_vectors()), (str(tmp_path), [*ties, (-5, [0.5] * 8, 1), (500, [float("inf")] * 8, 1), (501, [1.0] * 12, 1)])):
        if folder != odd[0]:
            write(folder, [], vectors)
        want = []
        for dim in {len(v) for _, v, _ in finite(vectors)}:
            if not dim or dim % 8:
                continue
            own = [r for r in finite(vectors) if len(r[1]) == dim]
            order = sorted(range(len(own)), key=lambda i: (own[i][0] is None, own[i][0] or 0))
            rows = [(own[i][0], [int(np.floor(float(np.float32(x)) * 4096)) for x in own[i][1]]) for i in order]
            codes, errors, digest = plain_codes(rows)
            want += [(i, bytes(c).hex(), e, own[at][2], digest) for (i, _), c, e, at in zip(rows, codes, errors, order)]
        sums = {}
        for r in want:
            sums[r[3]] = sums.get(r[3], 0) + r[2]
        assert sorted(coded(spark, folder), key=str) == sorted(((r[0], r[1], r[2], sums[r[3]], r[4]) for r in want), key=str)


def test_codes_of_very_large_components(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, (10.0 ** rng.integers(-3, 30) * rng.standard_normal(8)).tolist(), 1) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    from fractions import Fraction

    codes, errors, digest = plain_codes([(i, [int(Fraction(x) * 4096 // 1) for x in v]) for i, v, _ in vectors])
    got = {r["vec_id"]: r for r in vector_codes.compress(df).collect()}
    assert [got[i]["code"] for i in range(40)] == [bytes(c).hex() for c in codes]
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}
    assert [got[i]["error"] for i in range(40)] == [min(e, 2**63 - 1) for e in errors]


def test_many_labels_meet_their_sums(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 3)
    rows = [(i, None if i % 5 == 0 else (7 if i % 2 else 1000 + i), i) for i in range(3000)]
    df = spark.createDataFrame([(i, label, "00", i) for i, label, _ in rows], "vec_id long, label long, code string, error long").withColumn("error", vector_codes.F.col("error").cast("decimal(38,0)"))
    sums = {}
    for i, label, e in rows:
        sums[label] = sums.get(label, 0) + e
    assert {r["vec_id"]: int(r["label_error"]) for r in vector_codes.with_label_error(df).collect()} == {i: sums[label] for i, label, _ in rows}


def test_heaps_spare_most_parts():
    """In later rounds only parts whose bound was passed are looked at, and the codes are those of a look at all."""
    rng = np.random.default_rng(5)
    centres = 3000 * rng.standard_normal((16, 64))
    x = np.floor(centres[rng.integers(0, 16, 4000)] + 200 * rng.standard_normal((4000, 64))).astype(np.int64)
    parts = vector_codes.parts_of(x)
    books, drifts, codes, heaps, looked = parts[:16].swapaxes(0, 1).copy(), np.zeros((8, 16)), None, None, []
    for _ in range(7):
        codes, heaps, _, n = vector_codes.assign(x, codes, heaps, books, drifts)
        looked.append(n)
        plain = np.stack([vector_codes.distances(parts[:, p], books[p]).argmin(1) for p in range(8)], 1)
        assert (codes == plain).all()
        new = books.copy()
        for p in range(8):
            for e in range(16):
                if (own := codes[:, p] == e).any():
                    new[p, e] = parts[own, p].sum(0) // own.sum()
        drifts, books = drifts + vector_codes.moved(books, new), new
    assert looked[0] == 32_000 and sum(looked[3:]) < 0.5 * 4 * 32_000


def check_packed(got, want, capacity):
    for i, ids in want.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == best_fit.piece_starts(len(ids), capacity)
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == capacity for r in own[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]]).tolist()[:-1] and sum(n for _, n in own) <= capacity
    return len(by)


@pytest.mark.parametrize("group", [4096, 5])
def test_op13(spark, odd, monkeypatch, group):
    folder, texts = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = best_fit.pack(docs, best_fit.tokenizer_file("byte_bpe_50k.json"), group=group).collect()
    n = check_packed([r.asDict() for r in got], encoded(texts, "byte_bpe_50k.json", 0), 2048)
    assert n <= best_fit.bound_of(spark.createDataFrame(got)) + 3 * (group == 5)  # rounds over partitions of 5 pieces end early
    assert [r.asDict() for r in QUERIES["op13_best_fit"](spark, folder).collect()] if group == 4096 else True


def test_op13_is_at_its_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for group, more in ((4096, 0), (100, 6)):
        got = best_fit.pack(docs, best_fit.tokenizer_file("byte_bpe_50k.json"), group=group)
        rows = got.select("length", "sequence_id").toPandas()
        assert rows["length"].sum() > 500_000 and rows["sequence_id"].nunique() <= best_fit.bound_of(got) + more


def fewest(lengths, capacity):
    """Of a few items: every order, first fit."""
    best = len(lengths)
    for order in set(permutations(lengths)):
        rooms = []
        for n in order:
            at = next((i for i, r in enumerate(rooms) if r >= n), None)
            if at is None:
                rooms.append(capacity - n)
            else:
                rooms[at] -= n
        best = min(best, len(rooms))
    return best


def test_bounds_are_bounds_and_best_fit_is_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, 24) for _ in range(6)]
        assert best_fit.lower_bound(np.bincount(lengths, minlength=25), 24) <= fewest(lengths, 24) + 1e-9
    f = best_fit.feasible(2048)
    for _ in range(2000):
        own = np.random.default_rng(rng.randrange(10**9)).multinomial(2048, np.random.default_rng(rng.randrange(10**9)).dirichlet(np.ones(rng.randint(1, 9))))
        assert f[:, own].sum(1).max() <= 1 + 1e-9
    lengths = sorted((rng.randint(1, 100) for _ in range(800)), reverse=True)
    bins, offsets, rooms = best_fit.best_fit_decreasing(lengths, 128)
    left, used = [], []
    for n, b, o in zip(lengths, bins, offsets):
        fits = [r for r in left if r >= n]
        assert left[b] == min(fits) if b < len(left) else not fits
        left += [128] * (b == len(left))
        assert o == 128 - left[b]
        left[b] -= n
    assert left == rooms
    # two of 60 % never share a sequence, which the sum of the lengths can't tell
    assert best_fit.lower_bound(np.bincount([77] * 10, minlength=129), 128) == 10 > 770 / 128
