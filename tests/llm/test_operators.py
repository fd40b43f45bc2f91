"""Every operator against brute force on a small table full of odd rows, on an empty table, and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from ldloom.llm import embedding_dedup, minhash, mixing, packing, search, secrets, sharding, substring_dedup, token_files, tokens, toxicity
from ldloom.llm.components import components
from ldloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def odd_texts():
    base, passage, long = prose(120), prose(45), prose(30_000)
    edited = base.split()
    edited[40] = "CHANGED"
    half = " ".join(base.split()[:70]) + " " + prose(60)
    return [
        None, "", " \t\n ", "one", "one two", "One TWO", base, base.upper(), base, " ".join(edited), half, base + " tail", long, long + " end",
        f"{prose(30)} {passage} {prose(30)}", f"{prose(10)}\n{passage}\n{prose(12)}", f"{passage} {passage}", "x " * 100, "x " * 100, "é ü 漢字   \x85 ß " * 4,
        'password = "hunter2hunter2", token: abc, TOKEN: "aaaaaaaaaa"', f"AKIA{'A1' * 8} AKIASHORT {'0a' * 20} {'f' * 31}", "a <|endoftext|> b", "  lead and trail  ", "idiot " + prose(40),
    ]


def write(folder, docs, vectors=None, labels=None):
    texts = docs
    n = len(texts)
    ids = list(range(100, 100 + n))
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "text": pa.array(texts, pa.string()),
        "lang": pa.array([None if i % 7 == 0 else "en" for i in range(n)], pa.string()),
        "source": pa.array([None if i % 5 == 0 else ("hot" if i % 3 else f"s{i % 4}") for i in range(n)], pa.string()),
        "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    }
    for extra in ("id", "key", "size", "score", "spans", "tie", "target", "shard", "row", "grp", "n"):  # names the operators use themselves
        columns[extra] = pa.array([f"{extra}{i}" for i in range(n)], pa.string())
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    labels = labels or []
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([None] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), f"{folder}/labels.parquet")
    vectors = vectors or []
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "label": pa.array([v[2] for v in vectors], pa.int32())}), f"{folder}/embeddings.parquet")
    return dict(zip(ids, texts))


def odd_vectors():
    rng = np.random.default_rng(3)
    out, base = [], rng.standard_normal(64)
    for i in range(40):
        out.append((i, (base + 0.25 * rng.standard_normal(64)).tolist(), 1))
    for i in range(40, 60):
        out.append((i, rng.standard_normal(64).tolist(), i % 3))
    out += [(60, out[50][1], out[50][2]), (61, [2 * x for x in out[50][1]], out[50][2]), (62, out[0][1], 2), (63, out[0][1], None), (64, None, 1), (65, [0.0] * 64, 1)]
    out += [(66, [float("nan")] * 64, 1), (67, [1.0, None], 1), (68, [], 1), (69, [float("inf")] * 64, 1), (70, [3.0, 4.0], 1), (71, [6.0, 8.0], 1), (None, out[0][1], 1), (100, out[0][1], 1), (200, out[3][1], 0)]
    return out


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    return folder, write(folder, odd_texts(), odd_vectors(), [(124, 1), (100, 0), (None, 1), (105, None), (106, 0)])


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(folder, [])
    return folder


def rows(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_op1(spark, odd):
    folder, texts = odd
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r["doc_id"]: r for r in rows(spark, "op1_minhash", folder)}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i), i


def test_op1_large_group_of_near_copies(spark, tmp_path):
    base = prose(150).split()
    texts = []
    for i in range(900):
        w = list(base)
        for _ in range(RNG.randint(0, 9)):
            w[RNG.randrange(len(w))] = f"edit{RNG.randrange(10**9)}"
        texts.append(" ".join(w))
    texts = write(str(tmp_path), texts + [prose(60) for _ in range(50)])
    sets = {i: frozenset(minhash.shingle_sets(pa.array([t]))[0].tolist()) for i, t in texts.items()}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    assert {r["doc_id"]: r["component_id"] for r in rows(spark, "op1_minhash", str(tmp_path))} == want


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, (200, minhash.HASHES), np.uint16)
    other = sig.copy()
    for row in other:
        row[rng.choice(minhash.HASHES, 2 * minhash.CHUNKS - 1, replace=False)] ^= np.uint16(1)
    a, b = minhash.keys_of(sig), minhash.keys_of(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))


def test_parity_bitmaps_never_tell_more_than_the_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (1, 3, 63, 64, 65, 800, 20_000)]
    sets += [np.unique(np.concatenate([s[len(s) // 6 :], rng.integers(0, 1 << 64, len(s) // 6 + 1, np.uint64)])) for s in sets]
    maps = minhash.Bitmaps([minhash.parity(s).tobytes() for s in sets])
    for a in range(len(sets)):
        for b in range(len(sets)):
            if 100 * min(len(sets[a]), len(sets[b])) >= 75 * max(len(sets[a]), len(sets[b])):
                differ = int(maps.differing(np.array([a]), np.array([b]))[0])
                truth = len(np.setxor1d(sets[a], sets[b]))
                assert differ <= truth and (a != b or differ == 0) and differ >= 0.5 * min(truth, 12_000)


def test_op1_finds_pairs_just_above_the_threshold(spark, tmp_path):
    rng, texts, want = random.Random(12), [], 0
    for i in range(1500):
        words = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        gone = rng.choice((28, 29))  # 200 shingles, 5 new ones at each of so many words: similarity about 3/4
        other = list(words)
        other[100 : 100 + gone - 4] = [f"x{rng.randrange(10**9)}" for _ in range(gone - 4)]
        texts += [" ".join(words), " ".join(other)]
        want += 100 * (200 - gone) >= 75 * (200 + gone)
    texts = write(str(tmp_path), texts)
    got = {r["doc_id"]: r["component_id"] for r in rows(spark, "op1_minhash", str(tmp_path))}
    linked = sum(got[i] == got[i + 1] for i in range(100, 100 + len(texts), 2))
    assert 600 < linked == want  # 6 in a million pairs at the threshold share no key


def test_op1_family_of_many_components(spark, tmp_path):
    rng, frame, texts = random.Random(13), prose(100).split(), []
    for i in range(250):  # one frame in all, similarity between groups about 0.55, inside groups above 0.9
        own = [f"g{i}w{j}" for j in range(30)]
        for j in range(3):
            texts.append(" ".join([*frame, *own, f"e{rng.randrange(10**9)}"]))
    texts = write(str(tmp_path), texts)
    got = {r["doc_id"]: r["component_id"] for r in rows(spark, "op1_minhash", str(tmp_path))}
    assert got == {i: 100 + (i - 100) // 3 * 3 for i in texts}


def test_op1_large_family_meets_by_rare_shingles(spark, tmp_path, monkeypatch):
    """20,000 texts of a template, all in components of their own but for a few pairs: of 200 million pairs few are compared."""
    rng, frame = random.Random(14), prose(44).split()
    own = [[f"g{i}w{j}" for j in range(22)] for i in range(19_990)]
    texts = [" ".join([*frame, *w]) for w in own] + [" ".join([*frame, *own[i * 7][:20], "x", f"e{rng.randrange(10**9)}"]) for i in range(10)]
    pairs, real = [], minhash.by_rare_shingles
    monkeypatch.setattr(minhash, "by_rare_shingles", lambda *a: pairs.append(real(*a)) or pairs[-1])
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(data).collect()}
    assert got == {i: i if i < 19_990 else (i - 19_990) * 7 for i in range(20_000)}
    assert pairs[0] is not None and pairs[0].count() < 20_000


def test_prefixes_of_close_sets_share_a_shingle():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 5, minhash.COUNTERS)
    for _ in range(300):
        n, both = int(rng.integers(1, 60)), rng.permutation(1000).astype(np.uint64) * np.uint64(7919)
        gone = int(rng.integers(0, n // 3 + 1))
        a, b = np.sort(both[:n]), np.sort(np.concatenate([both[gone:n], both[500 : 500 + int(rng.integers(0, n // 3 + 1))]]))
        if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
            continue
        a, b = sorted((a, b), key=len)
        first = lambda s, k: set(s[np.lexsort((s, counts[(s % np.uint64(minhash.COUNTERS)).astype(int)]))][:k].tolist())
        assert first(a, len(a) - math.ceil(2 * 75 * len(a) / 175) + 1) & first(b, len(b) - math.ceil(75 * len(b) / 100) + 1)


def test_op2(spark, odd):
    folder, _ = odd
    vectors = odd_vectors()
    good = [(i, np.float32(v).astype(float), g) for i, v, g in vectors if i is not None and v and None not in v and g is not None and np.isfinite(v).all() and any(v)]
    links = [(a, b) for k, (a, u, g) in enumerate(good) for b, v, h in good[k + 1 :] if g == h and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.93]
    want, n = roots([v[0] for v in vectors if v[0] is not None], links), Counter(x for link in links for x in link)
    got = rows(spark, "op2_embedding_dedup", folder)
    assert len(got) == len(vectors) and len(links) > 20
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"]), r


def test_op2_thousands_of_links_in_cells_of_every_kind(spark, monkeypatch):
    rng, vectors = np.random.default_rng(9), []
    for label, centres in ((0, 400), (1, 30), (2, 1)):
        for c in rng.standard_normal((centres, 64)):
            vectors += [(c + 0.27 * rng.standard_normal(64), label) for _ in range(1200 // centres)]
    data = np.array([v for v, _ in vectors], np.float32)
    unit, label = data.astype(float), np.array([g for _, g in vectors])
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() > 20_000
    want = roots(range(len(data)), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, data[i].tolist(), int(label[i])) for i in range(len(data))], "vec_id long, embedding array<float>, label int")
    for bundle, part in ((1024, 8), (40, 2)):  # the second cuts along two axes and deals a cell's bundles out
        monkeypatch.setattr(embedding_dedup, "BUNDLE", bundle)
        monkeypatch.setattr(embedding_dedup, "PART", part)
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
        assert all((got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), want[i]) for i in range(len(data)))


def test_op2_more_axes_leave_fewer_pairs():
    rng = np.random.default_rng(11)
    unit = embedding_dedup.units(rng.standard_normal((3000, 64)))[0]
    share = []
    for axes in (1, 3, 8):
        cells = np.floor(embedding_dedup.rotated(unit, embedding_dedup.rotation(64)[:axes]) / np.sqrt(embedding_dedup.budgets(64, 0.93)[0])).astype(int)
        share.append(np.mean([(np.abs(cells - c).max(1) <= 1).mean() for c in cells]))
    assert share[0] > 0.6 and share[1] < 0.45 and share[2] < 0.1  # of pairs in cells that meet


def without_repeats(texts, k=20):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_op3(spark, odd):
    folder, texts = odd
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op3_substring_dedup", folder)}
    assert got == without_repeats(texts)


def test_op3_hot_passages_and_branches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 16)  # keys with more rows are dealt out by a salt
    hot, other, tail = prose(60), prose(50), prose(40)
    texts = [f"{prose(15)} {hot} {prose(12)}" for _ in range(120)] + [f"{hot} {tail}", f"{prose(9)} {other} {tail}", f"{other} {hot} {tail}", tail, f"{tail} {tail}", "a b " * 60]
    texts = write(str(tmp_path), texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op3_substring_dedup", str(tmp_path))}
    assert got == without_repeats(texts)


def test_op3_paths_end_at_branches(spark):
    edges = [(0, 1, 2, 0), (1, 2, 3, 5), (2, 3, 4, 9), (3, 4, 5, 20), (4, 4, 6, 30), (5, 6, 7, 35)]  # node 4 has two edges out
    df = spark.createDataFrame([(e, a, b, 5, (7, 0, pos)) for e, a, b, pos in edges], "edge long, a long, b long, size int, source struct<did:long,tie:long,pos:int>")
    got = {r["edge"]: r["path"] for r in substring_dedup.without_branch(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def encoded(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x in texts.items()}


def test_op4(spark, odd):
    folder, texts = odd
    at, want = 0, []
    for i, ids in sorted(encoded(texts, "byte_bpe_50k.json", 0).items()):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in rows(spark, "op4_token_files", folder))
    assert got == want


@pytest.mark.parametrize("counts", [[0, 0, 5], [1] * 300, [2**i for i in range(40)], [0, 7, 1, 1, 0, 3], [0, 0]])
def test_code_lengths_and_round_trip(counts):
    counts = np.array(counts, np.int64)
    lengths = token_files.code_lengths(counts, 20)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and (len(used) == 0 or used.max() <= 20) and sum(2.0 ** -int(x) for x in used) <= 1
    if not len(used):
        return
    code = token_files.Code(lengths)
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 1000)
    bits, offsets = code.encode(ids)
    assert (token_files.decode(bits, offsets, len(ids), code.decode_table(), code.most) == ids).all()
    assert len(bits) == -(-int(lengths[ids].astype(int).sum()) // 8)


def test_batch_encoder_equals_the_library():
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = tokens.BatchEncoder(packing.tokenizer_file(name), spaced, cache_entries=50)
        texts = [*odd_texts()[:12], *odd_texts()[14:], "it's 'll don't", "a\n\n\nb", "Σς İstanbul ǅ", "x1,y2;z!?..", "ab́c d́", "tab\there", "end.\nStart, next"] * 2
        for _ in range(2):
            ids, n = e.encode(texts)
            want = [x.ids for x in e.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_op5(spark, odd):
    folder, texts = odd
    got = {r["doc_id"]: r for r in rows(spark, "op5_mixing", folder)}
    sizes = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    source = dict(zip(texts, pq.read_table(f"{folder}/documents.parquet")["source"].to_pylist()))
    names = sorted({s for s in source.values() if s is not None}) + [None]
    size = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    left = float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else share
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[i], size[source[i]]) and math.isclose(r["target"], target[source[i]], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert rows(spark, "op5_mixing", folder) == rows(spark, "op5_mixing", folder)


def test_op5_near_its_targets(spark):
    got = QUERIES["op5_mixing"](spark, "/root/testdata/sf0.1").groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r[2] - r["target"]) < 0.15 * r["target"] for r in got)


def test_op6(spark, odd):
    folder, texts = odd
    got = rows(spark, "op6_sharding", folder)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    big = [r.asDict() for r in QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()]
    per = {s: sorted(r["slot"] for r in big if r["shard"] == s) for s in range(40)}
    assert all(v == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_bounded_loads_move_little():
    rng = random.Random(1)
    counts = Counter(rng.randrange(sharding.SLOTS * sharding.PARTS) for _ in range(20_000))
    where = lambda n: {(b, r): s for b, lo, hi, s, _ in sharding.walk(counts, n, 64, 0.25) for r in range(lo, hi)}
    before, after = where(40), where(41)
    assert len(before) == 20_000 and max(Counter(before.values()).values()) <= math.ceil(1.25 * 500)
    assert sum(before[x] != after[x] for x in before) < 0.12 * 20_000


def test_a_hot_key_is_sharded(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id AS other", "'x' AS shard")
    got = sharding.shard(df, "k", ["other"], shards=7).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [428] * 3 + [429] * 4 and len({(r["shard"], r["slot"]) for r in got}) == 3000


def test_op7(spark, odd):
    folder, _ = odd
    good = [(i, np.floor(np.float32(v).astype(float) * 1024)) for i, v, _ in odd_vectors() if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for q, x in good:
        if q % 100 == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q and len(x) == len(y))[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in rows(spark, "op7_topk", folder)} == want


def test_queries_meet_shards_in_few_cells_and_none_in_the_driver(spark, monkeypatch):
    for name, value in (("SHARD", 8), ("QUERIES", 4), ("CELL_BLOCKS", 3), ("CELL_SHARDS", 5), ("COLUMNS", 2)):
        monkeypatch.setattr(search, name, value)
    v = np.random.default_rng(4).integers(-3, 4, (300, 5))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.astype(float).tolist())], "vec_id long, embedding array<double>").repartition(3)
    found = search.top_k(df, "vec_id % 5 = 0")
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()}
    score = v @ v.T * search.SCALE**2
    assert got == {(q, k + 1, j, score[q, j]) for q in range(0, 300, 5) for k, j in enumerate([j for j in np.lexsort((np.arange(300), -score[q])) if j != q][:10])}


def test_maxscore_equals_all_products():
    rng = np.random.default_rng(2)
    v = np.floor(1024 * rng.standard_normal((3000, 16)))
    v[::50] *= 3
    q, ids = v[:20], np.arange(3000)
    best = search.maxscore(ids[:20], q, ids, v)
    for i in range(20):
        s = v @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        assert best.ids[i].tolist() == order and best.score[i].tolist() == s[order].tolist()
    assert search.exact(np.array([0]), np.array([[1e18, 2.0]]), np.array([0, 1]), np.array([[1.0, 1], [5.0, 3]]))[0] == (0, 1, 5 * 10**18 + 6)


def test_op8(spark, odd):
    folder, texts = odd
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in rows(spark, "op8_secrets", folder):
        t = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_owners_tell_examples_from_live_values(spark):
    copied, own = "token = 'Abc123Example99'", "token = 'Zyx987Private11'"
    added = "key Qw3rTy7uIoP9aSdF5gHj2kL"
    data = [(i, f"{copied} {prose(3)}", f"src{i}", "en") for i in range(4)] + [(9, own, "src1", "en"), (10, own, "src1", "de"), (11, added, "src2", None), (12, None, None, None)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(data, "doc_id long, text string, source string, lang string")).collect()}
    assert [s["live"] for s in got[0]] == [False] and got[0][0]["n_owners"] == 4
    assert got[9][0]["live"] and (got[9][0]["n_owners"], got[9][0]["n_repos"]) == (1, 2)
    assert [s["kind"] for s in got[11]] == [3] and got[12] is None


def test_op9(spark, odd):
    folder, texts = odd
    got = rows(spark, "op9_toxicity", folder)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def fitted(positive, unlabelled, prior):
    numbers = [[toxicity.features(t) for t in x] for x in (positive, unlabelled)]
    among = [Counter(n for row in x for n in row.tolist()) for x in numbers]
    z = {}
    for f in {*among[0], *among[1]}:
        p = (among[0][f] + among[1][f]) / (len(positive) + len(unlabelled))
        apart = among[0][f] / len(positive) - among[1][f] / len(unlabelled)
        z[f] = abs(apart / math.sqrt(max(p * (1 - p) * (1 / len(positive) + 1 / len(unlabelled)), 1e-24)))
    kept = sorted((f for f in z if z[f] > 0), key=lambda f: (-z[f], f))[: toxicity.MAX_FEATURES]
    place = {f: i for i, f in enumerate(kept)}
    rows = [[np.array([place[n] for n in row.tolist() if n in place], np.uint16) for row in x] for x in numbers]
    weights, bias = toxicity.fit(*rows, toxicity.weight_of(np.array([z[f] for f in kept])), prior)
    names = {f for t in positive + unlabelled for w in toxicity.words_of(t) if w for f in toxicity.features_of_word(w)}
    return toxicity.Model({f: weights[place[n]] for f in names if (n := zlib.crc32(f.encode())) in place}, bias)


def plain_fit(positive, unlabelled, counts, prior, steps):
    """The same learning with a dense matrix, its slope by hand from the two losses, one row at a time."""
    x = np.zeros((len(positive) + len(unlabelled), len(counts) + 1))
    for i, own in enumerate([*positive, *unlabelled]):
        x[i, own] = counts[own]
    x[:, -1] = 1
    w, m, v = np.zeros(x.shape[1]), 0, 0
    w[-1] = most = min(math.log(prior / (1 - prior)), math.log(toxicity.THRESHOLD / (2 - toxicity.THRESHOLD)))
    for t in range(1, steps + 1):
        p, u = x[: len(positive)], x[len(positive) :]
        up = lambda rows: sum((r / (1 + math.exp(-(r @ w))) for r in rows), np.zeros(len(w)))
        loss = lambda rows: sum(math.log1p(math.exp(r @ w)) for r in rows)
        negative = loss(u) / len(u) - prior * loss(p) / len(p)
        slope = up(u) / len(u) - prior * up(p) / len(p)
        slope = -slope if negative < 0 else slope + prior * (up(p) - p.sum(0)) / len(p)
        slope[:-1] += toxicity.DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[-1] = min(w[-1], most)
    return counts * w[:-1], w[-1]


@pytest.mark.parametrize("prior", [0.1, 0.7])
def test_fit_equals_a_plain_one(monkeypatch, prior):
    monkeypatch.setattr(toxicity, "STEP_ENTRIES", 40)
    rng = np.random.default_rng(6)
    rows = [np.flatnonzero(rng.random(30) < (0.5 if i < 12 else 0.2)).astype(np.uint16) for i in range(60)]
    rows[20] = rows[59] = np.empty(0, np.uint16)
    counts = rng.random(30)
    got, want = toxicity.fit(rows[:12], rows[12:], counts, prior, steps=60), plain_fit(rows[:12], rows[12:], counts, prior, 60)
    assert np.allclose(got[0], want[0], atol=1e-9) and math.isclose(got[1], want[1], abs_tol=1e-9)


def test_non_negative_learning_finds_planted_words():
    rng = random.Random(2)
    make = lambda bad: " ".join(rng.choices(VOCABULARY, k=60) + (rng.choices(["vile", "nasty", "foul"], k=3) if bad else []))
    model = fitted([make(True) for _ in range(300)], [make(rng.random() < 0.1) for _ in range(1500)], 0.1)
    bad, good = [model.margin(make(True)) for _ in range(200)], [model.margin(make(False)) for _ in range(200)]
    score = lambda m: toxicity.sigmoid(np.array(m))
    assert (score(bad) >= 0.3).mean() > 0.95 and (score(good) >= 0.3).mean() < 0.05


def test_few_positives_still_teach():
    rng = random.Random(4)
    vile = ["vile", "nasty", "foul", "scummy", "rotten"]
    make = lambda *bad: " ".join(rng.choices(VOCABULARY, k=60) + [*bad])
    positive = [make(vile[i % 5], vile[(i + 1) % 5]) for i in range(10)]  # each word in 4 of 10
    model = fitted(positive, positive + [make() for _ in range(140)], 0.14)
    assert all(model.weights[x] > 0 for x in vile)
    bad, good = [model.margin(make(*rng.sample(vile, k=2))) for _ in range(200)], [model.margin(make()) for _ in range(200)]
    score = lambda m: toxicity.sigmoid(np.array(m))
    assert (score(bad) >= 0.3).mean() > 0.95 and (score(good) >= 0.3).mean() < 0.05


def test_smallest_table_catches_insults(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    predicted = {r["doc_id"]: r["predicted"] for r in rows(spark, "op9_toxicity", SF)}
    assert sum(predicted[i] for i, t in labels.items() if t == 1) >= 7
    assert sum(predicted[i] for i, t in labels.items() if t == 0) <= 2


def test_gradient_of_the_risk_is_its_numeric_slope():
    rng = np.random.default_rng(3)
    is_p = np.arange(40) < 12
    for prior, low in ((0.1, False), (0.9, True)):
        g = rng.standard_normal(40) + (5 * is_p if low else 0)
        positive, negative, slope = toxicity.risk(g, is_p, prior)
        assert (negative < 0) == low
        for i in range(40):
            up, down = g.copy(), g.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            (p1, n1, _), (p0, n0, _) = toxicity.risk(up, is_p, prior), toxicity.risk(down, is_p, prior)
            want = -(n1 - n0) if low else p1 - p0 + n1 - n0
            assert math.isclose(slope[i], want / 2e-6, abs_tol=1e-6)


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["predicted"]) for r in rows(spark, "op9_toxicity", sf) if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught, alarms = [p for t, p in got if t], [p for t, p in got if not t]
    assert len(caught) > 50 and np.mean(caught) >= 0.9 and np.mean(alarms) <= 0.06


def test_learning_takes_one_text_of_an_id_and_repeats_itself(spark):
    rng = random.Random(8)
    data = [(i % 60, prose(20) + (" vile" if i % 60 < 20 else "")) for i in range(180)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    first = toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), labels)
    rng.shuffle(data)
    again = toxicity.train(spark.createDataFrame(data, "doc_id long, text string").repartition(7), labels)
    assert first.weights and (first.weights, first.bias) == (again.weights, again.bias)


def test_labels_held_out_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    only = spark.createDataFrame([(i, 1) for i in held], "doc_id long, toxic int")
    assert toxicity.train(docs, only).weights == {}


def test_op10(spark, odd):
    folder, texts = odd
    want, got = encoded(texts, "word_bpe_49k.json", 2), rows(spark, "op10_packing", folder)
    for i, ids in want.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]]).tolist()[:-1] and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    for s in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]]).tolist()[:-1] and sum(n for _, n in own) <= 4096


def test_first_fit_decreasing_equals_the_plain_way():
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    bins, offsets = packing.first_fit_decreasing(lengths, 128)
    rooms, want = [], {}
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        b = next((k for k, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        rooms += [128] * (b == len(rooms))
        want[i] = (b, 128 - rooms[b])
        rooms[b] -= lengths[i]
    assert {i: (bins[i], offsets[i]) for i in range(500)} == want


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    want = roots({x for link in links if link[0] != link[1] for x in link}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def near_groups(texts):
    """The smallest id each document reaches, by brute force over shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    return roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])


def shares(sizes, source):
    """Each source's target, by handing out all words by weight until none is over three times its size."""
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    size = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    left = float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else share
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    return size, target


def test_pipeline_stages(spark, odd, empty, tmp_path):
    """Each stage against a plain version, on what the stage before it kept; then run() against the last stage."""
    folder = str(tmp_path)
    write(folder, [*odd_texts(), *(prose(50) + (" vile foul nasty scummy" if i < 12 else "") for i in range(60))], labels=[(124 + i, int(i < 12)) for i in range(60)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        after = [r.asDict() for r in out.collect()]
        texts = {r["doc_id"]: r["text"] for r in before}
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            bad = {i for i, t in texts.items() if toxicity.sigmoid(np.array(model.margin(t or ""))) >= toxicity.THRESHOLD}
            assert len(bad & set(range(124, 136))) >= 10 and len(bad) <= 13
            want = [r for r in before if r["doc_id"] not in bad]
        elif name == "minhash":
            groups = near_groups(texts)
            want = [r for r in before if groups[r["doc_id"]] == r["doc_id"]]
            assert len(want) < len(before)
        elif name == "secrets":
            want = []
            for r in before:
                text, marks = r["text"], []
                for start, end, *_ in secrets.base_spans(text or ""):
                    if not marks or start >= marks[-1][1]:
                        marks.append((start, end))
                for start, end in reversed(marks):
                    text = f"{text[:start]}<secret>{text[end:]}"
                want.append(r | {"text": text, "n_chars": r["n_chars"] if text is None else len(text)})
            assert sum(r["text"] != x["text"] for r, x in zip(want, before)) >= 2
        else:
            sizes = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
            size, target = shares(sizes, {r["doc_id"]: r["source"] for r in before})
            rate = {r["doc_id"]: target[r["source"]] / size[r["source"]] if size[r["source"]] else 0 for r in before}
            drawn = {i: int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) for i in texts}
            want = [r for r in before for _ in range(int(rate[r["doc_id"]] // 1) + (drawn[r["doc_id"]] < rate[r["doc_id"]] % 1))]
        order = lambda rows: sorted(rows, key=lambda r: (r["doc_id"], str(r)))
        assert order(after) == order(want), name
        docs = spark.createDataFrame([tuple(r.values()) for r in after], docs.schema)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    got = sorted(map(key, corpus_pipeline.run(spark, folder).collect()))
    assert got == sorted(map(key, corpus_pipeline.packed(spark, docs, folder).collect()))
    whole = [ids for r in docs.collect() for ids in encoded({r["doc_id"]: r["text"]}, "word_bpe_49k.json", 2).values()]
    assert sum(x[2] for x in got) == sum(map(len, whole)) and sorted(x[3] for x in got if x[2] == x[4]) == sorted(zlib.crc32(w.tobytes()) for w in whole if len(w) <= 4096)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_vectors_and_paths_helpers():
    x = np.random.default_rng(0).integers(0, 100, 50).astype(np.uint64)
    assert substring_dedup.sliding_min(x, 13).tolist() == [int(x[i : i + 13].min()) for i in range(38)]
    assert embedding_dedup.forest(6, np.array([4, 2, 5]), np.array([2, 1, 3])).tolist() == [0, 1, 1, 3, 1, 3]
    assert mixing.CAP == 3
