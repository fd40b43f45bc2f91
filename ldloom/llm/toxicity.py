"""Toxicity: non-negative positive-unlabelled learning of a linear numpy classifier.

Positives are rows confirmed toxic; the unlabelled rows are documents as they come. The risk of a scorer g under the
class prior p is p*E_P[l(g)] + max(0, E_U[l(-g)] - p*E_P[l(-g)]) with the logistic loss l; where the second part turns
negative, the step goes against it (the non-negative correction). The prior is the share of toxic rows among all rows
whose labels may be learned. Features are a text's distinct lower-cased words without outer punctuation and their first 3
to 6 characters, numbered by their crc32, ranked by z, the standard errors by which their rates among positives and unlabelled differ; the best
``MAX_FEATURES`` are kept. A feature counts by z**SHARP / (z**SHARP + c**SHARP) with c = ``HALF_Z``, or the best z if
that is less: of a large vocabulary's chance differences few count much, and however few the positives are, those
features that tell them apart best count in half at least. Few positives can be learned by heart, and the correction
then raises the bias; so the risk is minimised under a bound on it, the log odds of the prior or of half the threshold: each step ends
inside the bound, and a text without evidence isn't called toxic.

The fit reads a bounded sample of rows: ``POSITIVES`` and ``UNLABELLED`` by the smallest hashes of their ids, none of them left out for its length. Texts become
feature numbers where they lie; Spark sums how many rows of either class have each feature, and only the best ``MAX_FEATURES`` by z go on. One task learns from these, two
bytes for each that a row has, so it holds 400 MB at most whatever the texts' lengths, and returns the weights, which go by name to the tasks
that score every whole text in one pass, with no shuffle. ``MAX_FEATURES`` binds where a sample has more features with a difference; those left out
have the least z.

Defined cases: a null or empty text scores by the bias alone; repeated rows score alike; texts of any length are scored
whole; without a confirmed positive, or a feature that tells positives apart, every score is 0; a null id is hashed as an empty string; of several texts with
one id the one with the least hash is learned from; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import at_work, cut, drop, remembers, slices, table

POSITIVES = 2500
UNLABELLED = 7500
MAX_FEATURES = 20_000
#: Feature occurrences that a step of the fit handles at once.
STEP_ENTRIES = 1 << 20
HALF_Z, SHARP = 6.0, 8
PREFIXES = (3, 4, 5, 6)
STEPS = 200
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.3
OUTER = ".,;:!?\"'()[]{}<>*#%|-_"
SCORED = "doc_id long, score double"


def words_of(text: str) -> set[str]:
    return {w.strip(OUTER) for w in set(text.lower().split())}


def features_of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


class WordFeatures(dict):
    """The numbers of a word's features; remembers up to ``most`` words."""

    most = 300_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = tuple(zlib.crc32(f.encode()) for f in features_of_word(word))
        return found


_features = WordFeatures()
remembers("features", _features.clear)


def features(text: str) -> np.ndarray:
    """The distinct numbers of a text's features, sorted."""
    return np.array(sorted({f for w in words_of(text) if w for f in _features[w]}), np.uint32)


class Model:
    """weights by feature, bias; score = sigmoid(bias + weights of the distinct features)."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple] = {}

    def margin(self, text: str) -> float:
        found: set[str] = set()
        known, weights = self.words, self.weights
        for w in words_of(text):
            own = known.get(w)
            if own is None:
                if len(known) > 300_000:
                    known.clear()
                own = known[w] = tuple(f for f in features_of_word(w) if f in weights) if w else ()
            found.update(own)
        return self.bias + sum(map(weights.__getitem__, sorted(found)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk(g: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, slope of the part that counts) of the risk of the margins g.

    The slope is that of both parts, or, where the negative part is below 0, that of the negative part turned round."""
    n_p, n_u = max(1, is_p.sum()), max(1, (~is_p).sum())
    s, as_negative = sigmoid(g), np.logaddexp(0, g)  # loss of calling a row negative
    negative = as_negative[~is_p].sum() / n_u - prior * as_negative[is_p].sum() / n_p
    slope = np.where(is_p, -prior * s / n_p, s / n_u)
    slope = -slope if negative < 0 else slope + np.where(is_p, -prior * (1 - s) / n_p, 0.0)
    return prior * np.logaddexp(0, -g[is_p]).sum() / n_p, negative, slope


class Rows:
    """Which of the kept features each row has, as 16-bit numbers in a row; sums over them are made a few rows at a time."""

    def __init__(self, rows: list[np.ndarray]):
        sizes = np.array([len(r) for r in rows], np.int64)
        self.ends = np.cumsum(sizes)
        self.flat = np.concatenate([np.empty(0, np.uint16), *rows]).astype(np.uint16, copy=False)
        edges, at = [0], 0
        for i, end in enumerate(self.ends.tolist()):
            if end - at >= STEP_ENTRIES:
                edges.append(i + 1)
                at = end
        self.parts = list(zip(edges, [*edges[1:], len(rows)]))

    def _part(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        start = self.ends[first - 1] if first else 0
        return self.flat[start : self.ends[last - 1]] if last > first else self.flat[:0], np.diff(self.ends[first:last], prepend=start)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Each row's sum of its features' weights."""
        out = np.zeros(len(self.ends))
        for first, last in self.parts:
            own, sizes = self._part(first, last)
            out[first:last] = np.bincount(np.repeat(np.arange(last - first), sizes), weights[own], last - first)
        return out

    def spread(self, values: np.ndarray, features: int) -> np.ndarray:
        """Each feature's sum of its rows' values."""
        out = np.zeros(features)
        for first, last in self.parts:
            own, sizes = self._part(first, last)
            out += np.bincount(own, np.repeat(values[first:last], sizes), features)
        return out


def weight_of(z: np.ndarray, half_z: float = HALF_Z) -> np.ndarray:
    """How much features count, by their z."""
    return 1 / (1 + (min(half_z, z.max()) / z) ** SHARP)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], counts: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias) after full-batch Adam on the non-negative risk. counts: how much each feature counts; rows: places in counts."""
    rows, kept = Rows(positive + unlabelled), len(counts)
    is_p = np.arange(len(rows.ends)) < len(positive)
    w, m, v = np.zeros(kept + 1), np.zeros(kept + 1), np.zeros(kept + 1)
    most = min(np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0, np.log(THRESHOLD / (2 - THRESHOLD)))
    w[-1] = most
    for t in range(1, steps + 1):
        slope = risk(rows.sums(counts * w[:-1]) + w[-1], is_p, prior)[2]
        grad = np.append(counts * rows.spread(slope, kept), slope.sum())
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[-1] = min(w[-1], most)
    return counts * w[:-1], float(w[-1])


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at_work("features")
    for batch in batches:
        for part in slices(batch):
            found = pa.array([features(t or "").tobytes() for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("p", "turn", "doc_id")), found], names=["p", "turn", "doc_id", "features"])


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of feature numbers -> feature, rows of either class that have it, summed within a batch."""
    for batch in batches:
        is_p = batch.column("p").to_numpy()
        rows = [np.frombuffer(x, np.uint32) for x in batch.column("features").to_pylist()]
        names, at = np.unique(np.concatenate([np.empty(0, np.uint32), *rows]), return_inverse=True)
        among_p = np.bincount(at[np.repeat(is_p, [len(r) for r in rows]) == 1], minlength=len(names))
        columns = (names.astype(np.int64), among_p, np.bincount(at, minlength=len(names)) - among_p)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["feature", "n_p", "n_u"])


def as_places(names: np.ndarray):
    """Rows of feature numbers -> rows of places among the kept features."""
    order = np.argsort(names)
    ordered = names[order]

    def places(value: bytes) -> bytes:
        own = np.frombuffer(value, np.uint32)
        at = np.minimum(np.searchsorted(ordered, own), len(names) - 1)
        return order[at[ordered[at] == own]].astype(np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([places(x) for x in batch.column("features").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("p", "turn", "doc_id")), found], names=["p", "turn", "doc_id", "places"])

    return run


def learn(names: np.ndarray, z: np.ndarray, prior: float):
    """Rows in the order of their turn -> (feature, weight); feature -1 is the bias. names: the kept features, z theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("learning")
        rows: tuple[list, list] = ([], [])
        for batch in batches:
            for p, value in zip(batch.column("p").to_pylist(), batch.column("places").to_pylist()):
                rows[p].append(np.frombuffer(value, np.uint16))
        weights, bias = fit(rows[1], rows[0], weight_of(z), prior)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *names.tolist()], pa.int64()), pa.array([bias, *weights.tolist()], pa.float64())], names=["feature", "weight"])

    return run


def named(numbers: set[int]):
    """Texts -> the features that have these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for part in (p for batch in batches for p in slices(batch)):
            for text in part.column("text").to_pylist():
                found |= {f for w in words_of(text) if w for f, n in zip(features_of_word(w), _features[w]) if n in numbers}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["name"])

    return run


def best_features(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, z) of the features whose rates among positives and unlabelled differ most, ``most`` of them. Counts are summed in Spark."""
    n_p, n_u = rows.agg(F.count_if(F.col("p") == 1), F.count_if(F.col("p") == 0)).first()
    if not n_p or not n_u:
        return np.empty(0, np.uint32), np.empty(0)
    each = rows.select("p", "features").mapInArrow(class_counts, "feature long, n_p long, n_u long").groupBy("feature").agg(F.sum("n_p").alias("a"), F.sum("n_u").alias("b"))
    rate = (F.col("a") + F.col("b")) / F.lit(float(n_p + n_u))
    error = F.sqrt(F.greatest(rate * (1 - rate) * F.lit(1 / n_p + 1 / n_u), F.lit(1e-24)))
    z = F.abs((F.col("a") / F.lit(float(n_p)) - F.col("b") / F.lit(float(n_u))) / error)
    found = each.withColumn("z", z).where("z > 0").orderBy(F.col("z").desc(), "feature").limit(most).select("feature", "z").collect()
    return np.array([r[0] for r in found], np.uint32), np.array([r[1] for r in found])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """From rows that aren't held out: confirmed toxic texts, and texts of unknown class."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull())
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return Model({}, -np.inf)
    turn = F.xxhash64(F.lit("toxicity"), "doc_id")
    first = lambda ids, most: ids.where("doc_id IS NOT NULL").select("doc_id", turn.alias("turn")).distinct().orderBy("turn", "doc_id").limit(most)
    wanted = first(known.where("toxic = 1"), positives).withColumn("p", F.lit(1)).unionByName(first(docs.where(~held_out()), unlabelled).withColumn("p", F.lit(0)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")  # positives + unlabelled ids at most
    one = cut(texts.groupBy("p", "turn", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    rows = cut(one.mapInArrow(as_features, "p int, turn long, doc_id long, features binary"), "features")
    best = best_features(rows, MAX_FEATURES)
    if not len(best[0]):
        drop(one)
        drop(rows)
        return Model({}, -np.inf)
    ordered = rows.mapInArrow(as_places(best[0]), "p int, turn long, doc_id long, places binary").repartition(1).sortWithinPartitions("turn", "doc_id")  # positives + unlabelled rows at most
    got = dict(map(tuple, ordered.mapInArrow(learn(*best, toxic / n), "feature long, weight double").collect()))  # MAX_FEATURES + 1 rows at most
    bias = got.pop(-1)
    drop(rows)
    names = [r[0] for r in one.select("text").mapInArrow(named(set(got)), "name string").distinct().collect()]
    drop(one)
    return Model({f: got[zlib.crc32(f.encode())] for f in names}, bias)


def score_texts(weights: dict[str, float], bias: float, keep_text: bool = True, name: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("scores")
        model = Model(weights, bias)
        for batch in batches:
            for part in slices(batch):
                margins = np.array([model.margin(t or "") for t in part.column("text").to_pylist()])
                rest = [c for c in part.schema.names if keep_text or c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(sigmoid(margins) * (bias > -np.inf))], names=[*rest, name])

    return run


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs and a column of scores; ``name`` is no column of docs."""
    return docs.mapInArrow(score_texts(model.weights, model.bias, name=name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score_texts(model.weights, model.bias, keep_text=False), SCORED)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; learned without the labels of rows that are held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
