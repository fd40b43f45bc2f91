"""Substring dedup by De Bruijn compaction over sampled nodes.

Each window of ``K`` words is an edge of the graph, from the node of its first K-1 words to that of its last K-1. Nodes are sampled, as
minimizer-space graphs do: a node is kept where it starts with an anchor, a word pair whose hash ends in zero bits, so
equal passages keep the same nodes; the edges between two kept nodes are one longer edge, hashed as a whole, with its source coordinate.

1. Repeated edges. Edges are summed by hash; the least coordinate is the source. Those that occur twice or more are the graph.
2. Compaction. In- and out-degrees are summed per node; where a node has one edge in and one out, the two are linked, and
   the linked edges, paths without a branch, become one by Spark joins (components of the links).
3. Spans. A document's later edges that follow one another on one path, at their source too, are one long span. The words at
   its own coordinates are compared with those at its source's, by a digest of 128 bits of the words themselves; a span that differs is given up.
4. What a sampled edge is too long for: the ends of repeated passages. Windows that lie on no removed span are edges of their own where
   they may repeat: a window's minimizer (the least hash among its ``SEED``-word seeds) is the same wherever it
   occurs, so one whose minimizer occurs once is unique. They are summed, joined to spans and verified like the others. The
   earliest occurrence of any window lies on an edge that stays, so looking at these alone loses none.

A text's words that lie on a removed span are dropped. Sums and minima are combined in each task before they are shuffled. Rows that
meet their key's sum are dealt out by key and, for a key with more than ``HOT`` rows, by a salt, so a passage in a third of
the rows is joined in many tasks. Texts are shuffled once, into a table bucketed by document, and stay there; no document's list is longer than its text.

Defined cases: a null or blank text has no words; a text under K words loses none; texts of any length are used whole; rows with the same id and
text are one document (the same words go from each); rows with the same id and different texts are ordered by a hash of the text; a null id is
ordered last; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, delete_on_exit, drop, mix64, remove, shared_folder, slices, table, window_hashes, words_of_all
from .components import components

K = 20
SEED = 8
ANCHOR_MASK = 15
_OTHER = np.uint64(0x2545F4914F6CDD1D)

#: Rows of a key that meet its sum in one task.
HOT = 4096
#: So many hot keys, some bytes each, are sent to all tasks; more are joined like any table.
BROADCAST_KEYS = 50_000
#: Bytes of text that a bucket of documents is meant to hold; more where Spark allows no more buckets.
BUCKET_BYTES = 32 << 20

EDGES = "h long, g int, a long, b long, did long, tie long, pos int, size int"
EDGE_NAMES = ["h", "g", "a", "b", "did", "tie", "pos", "size"]
SEEDS = "m long, did long, tie long"
TOLD = "did long, tie long, start int, size int, sdid long, stie long, sstart int, digest binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from windows of powers of two."""
    n, size, least = len(x) - width + 1, 1, x
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[width - size : width - size + n])


class Words:
    """The words of a batch's texts in a row. ``edge``: where an edge starts; ``doc``: the row of each word."""

    def __init__(self, part: pa.RecordBatch, k: int):
        self.part, self.k = part, k
        self.h, self.upto = words_of_all(part.column("text"))
        sizes = np.diff(self.upto)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.edge = np.arange(len(self.h)) + k <= self.upto[1:][self.doc]

    def open_edges(self) -> np.ndarray:
        """Edges that lie on no removed path."""
        step = np.zeros(len(self.h) + 1, np.int32)
        starts, sizes = self.part.column("starts"), self.part.column("lengths")
        lengths = np.array([0 if n is None else n for n in pc.list_value_length(starts).to_pylist()], np.int64)
        first = np.repeat(self.upto[:-1], lengths) + starts.flatten().to_numpy()
        np.add.at(step, first, 1)
        np.add.at(step, first + sizes.flatten().to_numpy(), -1)
        return self.edge & (np.cumsum(step[:-1]) == 0)

    def rows(self, at: np.ndarray) -> list[np.ndarray]:
        """did and tie of the words at these places."""
        return [self.part.column(c).to_numpy()[self.doc[at]] for c in ("did", "tie")]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each seed, least of the seeds of each edge); shorter than the words, places agree."""
        seeds = window_hashes(self.h, SEED)
        width = self.k - SEED + 1
        return seeds, sliding_min(seeds, width) if len(seeds) >= width else seeds[:0]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of h[s:e] for each span, from one running sum of a polynomial in an odd base (mod 2**64)."""
    up, down = powers(base, len(h)), powers(pow(base, -1, 1 << 64), len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * down[starts] + mix64((ends - starts).astype(np.uint64)))


def emit_sampled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            w = Words(part, k)
            cut_here = np.zeros(len(w.h), bool)
            pairs = window_hashes(w.h, 2)
            cut_here[: len(pairs)] = (pairs & np.uint64(ANCHOR_MASK)) == 0
            cut_here[w.upto[:-1][w.upto[:-1] < len(w.h)]] = True
            starts = np.flatnonzero(cut_here & w.edge)
            if not len(starts):
                continue
            last = w.upto[1:][w.doc[starts]] - k + 1  # one after the text's last edge
            after = np.minimum(np.append(starts[1:], len(w.h)), last)
            ends = after + k - 1
            h = span_hashes(mix64(w.h), starts, ends, 0x9E3779B97F4A7C15).view(np.int64)
            g = (span_hashes(mix64(w.h ^ _OTHER), starts, ends, 0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            pos = starts - w.upto[:-1][w.doc[starts]]
            nodes = window_hashes(w.h, k - 1).view(np.int64)
            columns = [h, g, nodes[starts], nodes[after], *w.rows(starts), pos.astype(np.int32), (after - starts).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=EDGE_NAMES)

    return run


def emit_seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            w = Words(part, k)
            seeds, least = w.seeds()
            n = len(least)
            open_ = w.open_edges()[:n]
            chosen = np.zeros(len(seeds), bool)
            for off in range(k - SEED + 1 if n else 0):
                chosen[off : off + n] |= open_ & (seeds[off : off + n] == least)
            at = np.flatnonzero(chosen)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seeds[at].view(np.int64), *w.rows(at))], names=["m", "did", "tie"])

    return run


def emit_windows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            w = Words(part, k)
            least = w.seeds()[1]
            n = len(least)
            repeated = part.column("ms")
            of = np.repeat(np.arange(part.num_rows), pc.list_value_length(repeated).to_numpy())
            salt = mix64(np.arange(part.num_rows, dtype=np.uint64) + np.uint64(1))
            wanted = np.unique(mix64(repeated.flatten().to_numpy().view(np.uint64) ^ salt[of]))
            own = mix64(least ^ salt[w.doc[:n]])
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            found = np.flatnonzero((wanted[at] == own) & w.open_edges()[:n])
            if not len(found):
                continue
            h = window_hashes(w.h, k)[found].view(np.int64)
            g = (window_hashes(mix64(w.h ^ _OTHER), k)[found] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            pos = (found - w.upto[:-1][w.doc[found]]).astype(np.int32)
            nodes = window_hashes(w.h, k - 1).view(np.int64)
            columns = [h, g, nodes[found], nodes[found + 1], *w.rows(found), pos, np.ones(len(found), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=EDGE_NAMES)

    return run


def tell_words(k: int):
    """Texts with lists of spans -> the spans, each with a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            rows = []
            for did, tie, text, spans in zip(*(part.column(c).to_pylist() for c in ("did", "tie", "text", "spans"))):
                words = (text or "").encode().split()
                for x in spans:
                    told = hashlib.blake2b(b" ".join(words[x["start"] : x["start"] + x["size"] + k - 1]), digest_size=16).digest()
                    rows.append((did, tie, x["start"], x["size"], x["sdid"], x["stie"], x["sstart"], told))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["did", "tie", "start", "size", "sdid", "stie", "sstart", "digest"])

    return run


def removed_words(n: int, k: int, starts, sizes) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.asarray(starts) + np.asarray(sizes) + k - 1, -1)
    return np.cumsum(step[:n]) > 0


def keep_rest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text, starts, sizes in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "starts", "lengths"))):
                    words = kept = (text or "").encode().split()
                    if starts:
                        gone = removed_words(len(words), k, starts, sizes)
                        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def meet(rows: DataFrame, sums: DataFrame, keys: list[str], most: int = HOT) -> DataFrame:
    """rows joined with the one row per key in ``sums``, a written table with n, the key's number of rows. Keys with more
    than ``most`` rows are few beside all rows; theirs are dealt out by a salt, and the sum is repeated for each."""
    salts = F.ceil(F.col("n") / most).cast("int")
    many = sums.where(F.col("n") > most).select(*(F.col(c).alias(f"hot_{c}") for c in keys), salts.alias("salts"))
    found = many.count()
    if not found:
        return rows.join(sums.drop("n"), keys)
    if found <= BROADCAST_KEYS:
        many = F.broadcast(many)
    on = [F.col(c) == F.col(f"hot_{c}") for c in keys]
    dealt = rows.join(many, on, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("did", "tie"), "salts").cast("int"), F.lit(0))).drop("salts", *(f"hot_{c}" for c in keys))
    return dealt.join(sums.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n"), [*keys, "salt"]).drop("salt")


def without_branch(edges: DataFrame) -> DataFrame:
    """edges with ``path``, the same for edges that nodes with one edge in and one out link to one another.

    Most linked edges follow one another at their sources too: a pass over each source's edges joins these to fragments,
    so the links left for the joins across the corpus are those where a path goes on in another document."""
    leaving = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_out"), F.min("edge").alias("edge"))
    coming = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n_in"), F.min("edge").alias("before"))
    links = leaving.join(coming, "node").where("n_out = 1 AND n_in = 1 AND before != edge").select("edge", "before")
    inside = Window.partitionBy("source.did", "source.tie").orderBy("source.pos")
    follows = (F.lag("edge").over(inside) == F.col("before")) & (F.lag(F.col("source.pos") + F.col("size")).over(inside) == F.col("source.pos"))
    marked = edges.join(links, "edge", "left").withColumn("first", F.when(~F.coalesce(follows, F.lit(False)), F.col("edge")))
    pieces = cut(marked.withColumn("fragment", F.last("first", ignorenulls=True).over(inside)).select(*edges.columns, "before", "first", "fragment"), "fragments")
    ends = pieces.select(F.col("edge").alias("before"), F.col("fragment").alias("fragment_before"))
    across = pieces.where("before IS NOT NULL AND first IS NOT NULL").select("before", "fragment").join(ends, "before")
    paths = components(across, "fragment_before", "fragment")
    out = cut(pieces.join(paths, F.col("fragment") == F.col("node"), "left").select(*edges.columns, F.coalesce("root", "fragment").alias("path")), "paths")
    drop(pieces)
    return out


def later_spans(rows: DataFrame) -> DataFrame:
    """did, tie, start, size, sdid, stie, sstart: occurrences of repeated edges that aren't the source, those that follow
    one another on one path, in the document as in the source, as one span."""
    place = F.struct("did", "tie", "pos")
    sums = rows.groupBy("h", "g").agg(F.min(place).alias("source"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("a", "b", "size"))).where("n > 1")
    edges = cut(sums.withColumn("edge", F.monotonically_increasing_id()), "repeated-edges")
    known = without_branch(edges)
    later = meet(rows.select("h", "g", "did", "tie", "pos", "size"), known.select("h", "g", "n", "source", "path"), ["h", "g"]).where(place != F.col("source"))
    later = later.select("did", "tie", "pos", "size", "path", F.col("source.did").alias("sdid"), F.col("source.tie").alias("stie"), F.col("source.pos").alias("spos"))
    inside = Window.partitionBy("did", "tie").orderBy("pos")
    before = lambda c: F.lag(c).over(inside)
    follows = (before("path") == F.col("path")) & (before(F.col("pos") + F.col("size")) == F.col("pos")) & (before("sdid") == F.col("sdid")) & (before("stie") == F.col("stie")) & (before(F.col("spos") + F.col("size")) == F.col("spos"))
    marked = later.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("nth", F.sum("new").over(inside))
    one = marked.groupBy("did", "tie", "nth").agg(F.min("pos").alias("start"), F.sum("size").cast("int").alias("size"), F.min("sdid").alias("sdid"), F.min("stie").alias("stie"), F.min("spos").alias("sstart"))
    spans = cut(one.drop("nth"), "spans")
    for t in (edges, known):
        drop(t)
    return spans


def verified(spans: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Per document starts and lengths of the spans whose words are those at their source."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("sdid", "long"), ("stie", "long"), ("sstart", "int"))]
    sources = spans.select(F.col("sdid").alias("did"), F.col("stie").alias("tie"), F.col("sstart").alias("start"), "size").distinct().select("*", *nothing)
    asked = spans.select("did", "tie", "start", "size", "sdid", "stie", "sstart").unionByName(sources)
    lists = asked.groupBy("did", "tie").agg(F.collect_list(F.struct("start", "size", "sdid", "stie", "sstart")).alias("spans"))
    # rows that repeat a document tell the same twice: one of them is asked
    once = texts.groupBy("did", "tie").agg(F.first("text").alias("text")).join(lists, ["did", "tie"])
    told = cut(once.select("did", "tie", "text", "spans").mapInArrow(tell_words(k), TOLD), "told")
    key = ["sdid", "stie", "sstart", "size"]
    heard = told.where("sdid IS NOT NULL").select(*key, "digest").distinct()
    truth = told.where("sdid IS NULL").select(F.col("did").alias("sdid"), F.col("tie").alias("stie"), F.col("start").alias("sstart"), "size", F.col("digest").alias("truth"))
    wrong = heard.join(truth, key).where("digest != truth").select(*key, "digest")  # none, but for a collision of 96 bits
    good = told.where("sdid IS NOT NULL").join(wrong, [*key, "digest"], "left_anti")
    out = cut(good.groupBy("did", "tie").agg(F.collect_list(F.struct("start", "size")).alias("x")).select("did", "tie", F.col("x.start").alias("starts"), F.col("x.size").alias("lengths")), "verified")
    drop(told)
    return out


def by_document(read: DataFrame) -> tuple[DataFrame, str]:
    """(the rows in a table bucketed by did and tie, its name): joins on these leave the texts where they are, since there are
    at least as many buckets as shuffle partitions; with fewer, Spark would deal the texts out anew for each join."""
    spark = read.sparkSession
    volume = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    buckets = min(max(least, -(-volume // BUCKET_BYTES)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"texts_{uuid.uuid4().hex}"
    dealt = read.repartition(buckets, "did", "tie")
    delete_on_exit(spark, path := f"{shared_folder(spark)}/{name}")
    dealt.write.bucketBy(buckets, "did", "tie").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), name


def without_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of docs."""
    last = F.lit(2**63 - 1)
    own = F.col("doc_id").cast("long")
    read = docs.select(own.alias("doc_id"), F.coalesce(own, last).alias("did"), F.xxhash64("text").alias("tie"), "text")
    texts, name = by_document(read)
    try:
        return _without_repeats(texts, k)
    finally:  # the result is a table of its own
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        remove(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/{name}")


def _without_repeats(texts: DataFrame, k: int) -> DataFrame:
    edges = cut(texts.mapInArrow(emit_sampled(k), EDGES), "edges")
    spans = later_spans(edges)
    gone = verified(spans, texts, k)
    for t in (edges, spans):
        drop(t)
    seeds = cut(texts.join(gone, ["did", "tie"], "left").mapInArrow(emit_seeds(k), SEEDS), "seeds")
    repeated = cut(seeds.groupBy("m").agg(F.count("*").alias("n")).where("n > 1"), "minimizers")
    wanted = cut(meet(seeds, repeated, ["m"]).groupBy("did", "tie").agg(F.collect_set("m").alias("ms")), "repeated-seeds")
    for t in (seeds, repeated):
        drop(t)
    windows = cut(texts.join(wanted.join(gone, ["did", "tie"], "left"), ["did", "tie"]).mapInArrow(emit_windows(k), EDGES), "windows")
    drop(wanted)
    short = later_spans(windows)
    more = verified(short, texts, k)
    for t in (windows, short):
        drop(t)
    both = gone.unionByName(more).groupBy("did", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"))
    out = cut(texts.join(both, ["did", "tie"], "left").select("doc_id", "text", "starts", "lengths").mapInArrow(keep_rest(k), KEPT), "kept")
    for t in (gone, more):
        drop(t)
    return out


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that start earlier in the corpus."""
    return without_repeats(table(spark, sf_dir, "documents"))
