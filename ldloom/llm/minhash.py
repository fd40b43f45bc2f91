"""MinHash near-dedup with a multi-index Hamming join.

A text's set of word shingles gives ``HASHES`` minima of ``BITS`` bits: its signature. Distance is the number of positions
that differ. The positions are split into ``CHUNKS`` chunks; if two signatures differ in fewer than 2 * CHUNKS positions,
some chunk has one error at most (pigeonhole), so leaving out each position of each chunk in turn enumerates the allowed
errors: a pair within the distance ``2 * CHUNKS - 1`` agrees in one key at least. Pairs at the link threshold differ in a
quarter of the positions on average; that a pair misses all chunks has a chance of 6 in a million there, and less above.

Links are confirmed on the full sets. What keeps hot groups cheap:
- texts with one set are one representative with a number of its own, so copies never meet;
- a bucket (key) first offers each member its leader only (the smallest member), and of its leaders each member is
  confirmed against the one it shares most keys with: one pair per representative at most, whatever the size of a bucket;
- buckets that still hold several components are looked into: only members outside the bucket's largest component meet
  the others, in tiles of ``TILE`` members a side. Before a pair is confirmed, two bounds that no link can break are
  asked: the sizes, and the parity bitmaps of the sets. Such a bitmap flips a bit for each shingle, so two of them
  differ in no more bits than the sets in shingles: a pair that differs in more than the threshold allows is surely no link. A
  first look confirms each outsider's closest partner of another component in each bucket: that joins nearly all that
  belongs together, at one pair a row. A last look confirms every pair of different components that both bounds
  allow, in the first bucket it shares, so no link that would join two components is left out; pairs inside a
  component are not needed;
- a family of texts that share much but not enough fills buckets with members of as many components. Buckets over ``MOST_TILES`` pairs of tiles aren't
  looked into; their members meet by rare shingles: in one order of all shingles, those rare among these members first, two sets within the threshold share one
  among the first seventh of the smaller and the first quarter of the larger (the prefix filter), so what a family has in common brings no two together.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer words than a shingle are one shingle; texts of any
length are used whole; rows that share an id are one document, linked by the links of each; a null id links with nothing and has
no component; repeated rows are all returned; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, mix64, slices, table, window_hashes, words_of_all
from .components import components

WORDS = 5
PERCENT = 75
CHUNKS, PER_CHUNK, BITS = 12, 5, 16
HASHES = CHUNKS * PER_CHUNK
#: Bits of a parity bitmap: four a shingle, a power of two between these. Beyond the most a bitmap tells less, never wrong.
LEAST_BITS, MOST_BITS = 256, 1 << 16
TILE = 2048
#: Pairs of tiles in a bucket that are compared whole.
MOST_TILES = 16
#: Counters by which shingles are ordered. Any order is right; they only tell the common ones.
COUNTERS = 1 << 18
#: Members confirmed against one leader in one group of rows.
SALT = 128

_rng = np.random.default_rng(20240117)
_A = (_rng.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)

SIGNED = "doc_id long, tie long, n_shingles long, h1 long, h2 long, sig binary"


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; A-Z count as a-z."""
    h, upto = words_of_all(texts, lower=True)
    windows = window_hashes(h, words)
    out = []
    for s, e in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if e - s >= words:
            out.append(np.unique(windows[s : e - words + 1]))
        else:
            own = h[s:e]
            out.append(window_hashes(own ^ np.uint64(len(own)), len(own)) if len(own) else own)
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1 << 13):
        np.minimum(least, ((x[None, at : at + (1 << 13)] ^ _B[:, None]) * _A[:, None]).min(1), out=least)
    return least * np.uint32(0x9E3779B1)


def signature(shingles: np.ndarray) -> np.ndarray:
    return (minima(shingles) >> np.uint32(32 - BITS)).astype(np.uint16)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Packed bits, each flipped once for every shingle that falls on it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(shingles) - 1).bit_length()))
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8))


def with_bitmap(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            bits = pa.array([parity(s).tobytes() for s in shingle_sets(part.column("text"), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, bits], names=[*part.schema.names, "bits"])

    return run


def sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = [[], [], [], []]
                for s in shingle_sets(part.column("text"), words):
                    both = np.array([np.bitwise_xor.reduce(s), mix64(s).sum(dtype=np.uint64)] if len(s) else [0, 0], np.uint64).view(np.int64)
                    for column, value in zip(rows, (len(s), int(both[0]), int(both[1]), signature(s).tobytes() if len(s) else None)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), *(pa.array(c, t) for c, t in zip(rows, kinds))], names=["doc_id", "tie", "n_shingles", "h1", "h2", "sig"])

    return run


def keys_of(sig: np.ndarray) -> np.ndarray:
    """(documents, CHUNKS * PER_CHUNK) keys: each chunk without each of its positions."""
    chunks = sig.reshape(len(sig), CHUNKS, PER_CHUNK).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, PER_CHUNK), np.uint64)
    for j in range(PER_CHUNK):
        key = np.zeros((len(sig), CHUNKS), np.uint64)
        for i in range(PER_CHUNK):
            if i != j:
                key = (key << np.uint64(BITS)) | chunks[:, :, i]
        out[:, :, j] = mix64(key + (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(PER_CHUNK) + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15))
    return out.reshape(len(sig), -1)


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            ids = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(sig).view(np.int64).reshape(-1)), pa.array(np.repeat(ids, HASHES))], names=["key", "id"])


def confirm_groups(words: int, percent: int):
    """Rows sorted by (grp, salt), the leader's first: yields (a, b) for members whose sets are close to the leader's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for part in (p for batch in batches for p in slices(batch)):
            a, b = [], []
            sets = shingle_sets(part.column("text"), words)
            for grp, salt, role, own, s in zip(*(part.column(c).to_pylist() for c in ("grp", "salt", "role", "id")), sets):
                if (grp, salt) != group:
                    group, leaders = (grp, salt), []
                if role == 0:
                    leaders.append(s)
                    continue
                for lead in leaders:
                    shared = len(np.intersect1d(lead, s, assume_unique=True))
                    if 100 * shared >= percent * (len(lead) + len(s) - shared):
                        a.append(grp)
                        b.append(own)
                        break
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are close; a's text travels once for every SALT partners, b's once a pair."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    # leaders with more than SALT partners are few beside the pairs; only they need to be known where the pairs are
    many = sizes.where("salts > 1").select(F.col("a").alias("many"), "salts")
    salt = F.coalesce(F.pmod(F.xxhash64("b"), "salts").cast("int"), F.lit(0))
    members = pairs.join(many, F.col("a") == F.col("many"), "left").select(F.col("a").alias("grp"), salt.alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    leaders = sizes.select(F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = members.unionByName(leaders).join(texts.select("id", "text"), "id").select("grp", "salt", "role", "id", "text")
    return rows.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role").mapInArrow(confirm_groups(words, percent), "a long, b long")


class Bitmaps:
    """The parity bitmaps of some rows, each at its own width and folded to half of it: sets whose sizes allow a link
    have widths that differ by a factor of two at most."""

    def __init__(self, values: list[bytes]):
        self.width = np.array([len(v) for v in values], np.int64)
        self.place = {w: np.full(len(values), -1, np.int64) for w in set(self.width.tolist())}
        self.rows: dict[int, np.ndarray] = {}
        for w, place in self.place.items():
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            full = [np.frombuffer(b"".join(values[i] for i in at), np.uint64) for at in (own, twice)]
            halves = full[1].reshape(len(twice), 2, w // 8)
            self.rows[w] = np.concatenate([full[0].reshape(len(own), w // 8), halves[:, 0] ^ halves[:, 1]])
            place[np.concatenate([own, twice])] = np.arange(len(own) + len(twice))

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the rows x and y differ, pair by pair."""
        width, out = np.minimum(self.width[x], self.width[y]), np.zeros(len(x), np.int64)
        for w in np.unique(width).tolist():
            at, rows, place = np.flatnonzero(width == w), self.rows[w], self.place[w]
            step = max(1, (1 << 22) // w)
            for c in range(0, len(at), step):
                some = at[c : c + step]
                out[some] = np.bitwise_count(rows[place[x[some]]] ^ rows[place[y[some]]]).sum(1)
        return out


def first_shared_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of signatures, the number of the first key that they share (-1: none)."""
    differ = (a != b).reshape(len(a), CHUNKS, PER_CHUNK)
    errors = differ.sum(2)
    chunk = np.argmax(errors <= 1, axis=1)
    row = np.arange(len(a))
    key = chunk * PER_CHUNK + np.where(errors[row, chunk] == 1, np.argmax(differ[row, chunk], axis=1), 0)
    return np.where(errors[row, chunk] <= 1, key, -1)


def look_into(percent: int, closest: bool):
    """Rows sorted by (bucket, i, j): pairs of a member outside the bucket's largest component (side 0) and a member of
    another component (side 1) that sizes and bitmaps allow; of each outsider only its closest, if so asked, else each
    pair in the first bucket that it shares."""

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        key = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
        ids, root, n, side, outside = (rows.column(c).to_numpy() for c in ("id", "root", "n", "side", "outside"))
        coarse = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        new = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        firsts = np.append(0, new)
        numbers = np.argmax(keys_of(coarse[firsts]).view(np.int64) == key[0][firsts][:, None], axis=1)  # which key a bucket is
        maps = Bitmaps(rows.column("bits").to_pylist())
        out = []
        for s, e, number in zip(firsts.tolist(), [*new.tolist(), len(ids)], numbers.tolist()):
            left, right = np.arange(s, e)[side[s:e] == 0], np.arange(s, e)[side[s:e] == 1]
            for at in range(0, len(left), 64):
                own = left[at : at + 64]
                ok = (root[own][:, None] != root[right][None, :]) & (100 * np.minimum(n[own][:, None], n[right][None, :]) >= percent * np.maximum(n[own][:, None], n[right][None, :]))
                if not closest:  # two outsiders meet twice
                    ok &= ~outside[right][None, :] | (ids[own][:, None] < ids[right][None, :])
                x, y = np.nonzero(ok)
                if not len(x):
                    continue
                x, y = own[x], right[y]
                differ, both = maps.differing(x, y), n[x] + n[y]
                near = differ * (100 + percent) <= both * (100 - percent)
                x, y, share = x[near], y[near], (differ / both)[near]
                if closest:
                    order = np.lexsort((ids[y], share, x))
                    first = order[np.unique(x[order], return_index=True)[1]]
                    x, y = x[first], y[first]
                else:
                    mine = first_shared_key(coarse[x], coarse[y]) == number
                    x, y = x[mine], y[mine]
                out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
        if not out:
            return None
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0)) if rows.num_rows else []
            whole = int(last[-1]) + 1 if len(last) else 0  # what follows may go on in the next batch
            if whole and (found := pairs(rows.slice(0, whole))):
                yield found
            held = rows.slice(whole)
        if held is not None and held.num_rows and (found := pairs(held)):
            yield found

    return run


def open_buckets(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their components; the buckets that hold several, with their largest and how many tiles of members and of outsiders they have)."""
    placed = members.join(roots, members["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    held = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    return placed, held.where("roots > 1").select("key", F.col("most.root").alias("main"), tiles(F.col("n")).alias("tiles"), tiles(F.col("n") - F.col("most.n")).alias("outer"))


def within_buckets(members: DataFrame, fine: DataFrame, roots: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs (a, b) still to be confirmed: in one bucket, in different components."""
    placed, open_keys = open_buckets(members, roots)
    inside = placed.join(open_keys.where(F.col("outer") * F.col("tiles") <= MOST_TILES), "key").withColumn("outside", F.col("root") != F.col("main"))
    tile = lambda of: F.pmod(F.xxhash64(F.lit(of), "id"), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    right = inside.select(F.col("key").alias("bucket"), each("outer").alias("i"), tile("tiles").alias("j"), F.lit(1).alias("side"), "outside", "id", "root")
    left = inside.where("outside").select(F.col("key").alias("bucket"), tile("outer").alias("i"), each("tiles").alias("j"), F.lit(0).alias("side"), "outside", "id", "root")
    rows = left.unionByName(right).join(fine, "id").select("bucket", "i", "j", "side", "outside", "id", "root", "n", "sig", "bits")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(look_into(percent, closest), "a long, b long").distinct()


def count_shingles(words: int):
    """Texts -> how many of their sets each counter counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for part in (p for batch in batches for p in slices(batch)):
            for s in shingle_sets(part.column("text"), words):
                total += np.bincount((s % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["counter", "n"])

    return run


def first_shingles(words: int, percent: int, counts: np.ndarray):
    """Texts -> the first shingles of each set in the order of their counters: shingle, id, n, root, whether it is among those that a larger set meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            found = []
            for i, s in enumerate(shingle_sets(part.column("text"), words)):
                n = len(s)
                asking = n + percent * n // -100 + 1  # n - ceil(n * percent / 100) + 1
                asked = n + 2 * percent * n // -(100 + percent) + 1
                order = np.lexsort((s, counts[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:asking]
                found.append((s[order].view(np.int64), np.full(len(order), i), np.arange(len(order)) < asked))
            shingle, row, short = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
            own = [part.column(c).take(pa.array(row)) for c in ("id", "n", "root")]
            yield pa.RecordBatch.from_arrays([pa.array(shingle), *own, pa.array(short)], names=["shingle", "id", "n", "root", "short"])

    return run


def by_rare_shingles(members: DataFrame, texts: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Pairs (a, b) of different components among the members of buckets that are too large to look into; None if there are no such buckets."""
    placed, open_keys = open_buckets(members, roots)
    crowd = cut(placed.join(open_keys.where(F.col("outer") * F.col("tiles") > MOST_TILES), "key").select("id", "root").distinct(), "crowd")
    if not crowd.limit(1).count():
        drop(crowd)
        return None
    own = cut(texts.join(crowd, "id").select("id", "n", "root", "text"), "crowd-texts")
    counts = np.zeros(COUNTERS, np.int64)
    for r in own.select("text").mapInArrow(count_shingles(words), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():  # COUNTERS rows at most
        counts[r["counter"]] = r["n"]
    rows = cut(own.select("id", "n", "root", "text").mapInArrow(first_shingles(words, percent, counts), "shingle long, id long, n long, root long, short boolean"), "first-shingles")
    several = rows.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").select("shingle")
    rows = cut(rows.join(several, "shingle", "left_semi"), "shared-shingles")
    small = rows.where("short").select("shingle", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("root").alias("xr"))
    large = rows.select("shingle", F.col("id").alias("y"), F.col("n").alias("yn"), F.col("root").alias("yr"))
    met = small.join(large, "shingle").where((F.struct("xn", "x") < F.struct("yn", "y")) & (100 * F.col("xn") >= percent * F.col("yn")) & (F.col("xr") != F.col("yr")))
    return cut(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    read = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    signed = cut(read.mapInArrow(sign(words), SIGNED), "signed")
    reps = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tie", "sig", "n_shingles")).alias("r"))
    # a doc_id may hold several sets: each has a number, which this file fixes
    reps = cut(reps.select("h1", "h2", "r.doc_id", "r.tie", "r.sig", F.col("r.n_shingles").alias("n")).sortWithinPartitions("h1", "h2").withColumn("id", F.monotonically_increasing_id()), "reps")
    keys = reps.select("id", "sig").mapInArrow(spread, "key long, id long")
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    members = cut(keys.join(shared, "key"), "members")
    used = reps.select("id", "doc_id", "tie", "sig", "n").join(members.select("id").distinct(), "id", "left_semi")
    once = read.join(used, ["doc_id", "tie"]).groupBy("doc_id", "tie", "id", "n").agg(F.first("sig").alias("sig"), F.first("text").alias("text"))
    texts = cut(once.select("id", "n", "sig", "text").mapInArrow(with_bitmap(words), "id long, n long, sig binary, text string, bits binary"), "texts")
    fine = texts.select("id", "n", "sig", "bits")
    by_leader = members.where("id != leader").groupBy("id", "leader").count()
    stars = by_leader.groupBy("id").agg(F.max(F.struct("count", F.negate("leader").alias("minus"))).alias("m")).select(F.negate("m.minus").alias("a"), F.col("id").alias("b"))
    star_links = cut(confirm(stars, texts, words, percent), "links")
    # what is linked so far goes on as its components' stars, so each time only new links take rounds
    as_links = lambda roots: roots.where("node != root").select(F.col("node").alias("b"), F.col("root").alias("a"))
    star_roots = components(star_links)
    near = cut(within_buckets(members, fine, star_roots, percent, closest=True), "pairs")
    more_links = cut(as_links(star_roots).unionByName(confirm(near, texts, words, percent)), "links")
    more_roots = components(more_links)
    rest = cut(within_buckets(members, fine, more_roots, percent, closest=False), "pairs")
    crowded = by_rare_shingles(members, texts, more_roots, words, percent)
    rest = rest if crowded is None else rest.unionByName(crowded)
    links = cut(as_links(more_roots).unionByName(confirm(rest, texts, words, percent)), "links")
    # documents that share an id are one: a row's set leads to its representative, an id leads to all its sets
    ids = reps.select("id", F.col("doc_id").alias("own"))
    linked = links.join(ids.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a").join(ids.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
    same = signed.where("n_shingles > 0").join(reps.select("h1", "h2", F.col("doc_id").alias("own")), ["h1", "h2"]).where("doc_id != own").select(F.col("own").alias("a"), F.col("doc_id").alias("b"))
    roots = components(linked.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")).unionByName(same))
    for t in (members, texts, star_links, more_links, near):
        drop(t)
    out = signed.select("doc_id", "n_shingles").join(roots, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked where their 5-word shingle sets have a similarity of 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))
