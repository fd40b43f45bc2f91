"""Token ids on disk: canonical length-limited Huffman code from global counts, blocks with bit-offset checkpoints.

Texts are dealt by range of the document id and encoded to ids in that order; the ids go to a shared table of blocks
(whole documents, about ``BLOCK_IDS`` ids), the last block of a range with the range's counts. These are summed per id, so
what reaches the driver is bounded by the vocabulary, and so is the code table sent back. The files hold, per block, the bit stream, a bit offset every
``STEP`` ids, and the documents' ids and lengths. A block needs nothing but the code lengths: decoding starts at all
checkpoints of a block at once and looks up ``MAX_BITS`` bits at a time in one table.

The files are Parquet with the bit streams as binary values, since that is what every store Spark can reach will hold.

Defined cases: a null or empty text is the end id alone; repeated rows are all kept, rows with one document id in the order of a hash of
their text; a null id sorts first; an empty table gives no block; a document of any length is one block at most with others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at_work, cut, drop, slices, table
from .packing import tokenizer_file

BLOCK_IDS = 1 << 19
STEP = 256
MAX_BITS = 20
#: Bytes of text a range of document ids is meant to hold.
RANGE_BYTES = 32 << 20
BLOCKS = "part int, first long, doc_ids array<bigint>, sizes array<bigint>, ids binary, counts binary"
FILES = "part int, first long, doc_ids array<bigint>, sizes array<bigint>, bits binary, offsets array<bigint>"
DECODED = "part int, at long, doc_id long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64 if counts.sum() >= 1 << 57 else np.int64)
    merged, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(most - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        is_leaf.append(rank < len(leaves))
        merged = both[rank]
    lengths, take = np.zeros(len(leaves), np.int64), 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


class Code:
    """The canonical code of some lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.most = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        self.order = order[self.lengths[order] > 0]
        width = 1 << (self.most - self.lengths[self.order])
        self.width = width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = (np.cumsum(width) - width) >> (self.most - self.lengths[self.order])

    def decode_table(self) -> np.ndarray:
        out = np.zeros(1 << self.most, np.uint32)
        entries = (self.order.astype(np.uint32) << np.uint32(5)) | self.lengths[self.order].astype(np.uint32)
        filled = np.repeat(entries, self.width)
        out[: len(filled)] = filled
        return out

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """(bit stream, bit offset of every step-th id)."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        shifted = self.codes[ids] << (64 - sizes - (starts & 31)).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))  # codes are non-empty, so words are met in order
        words = np.zeros((total >> 5) + 2, np.uint64)
        if len(ids):
            words[word[first]] = np.add.reduceat(shifted >> np.uint64(32), first)
            low = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
            words[word[first] + 1] += low
        return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::step]


def decode(bits: bytes, offsets: np.ndarray, n: int, lookup: np.ndarray, most: int, step: int = STEP) -> np.ndarray:
    """The n ids of a block: every checkpoint is a lane, all lanes advance together."""
    pad = np.frombuffer(bits + b"\0" * (step * most // 8 + 8), np.uint8).astype(np.uint32)
    window = (pad[:-3] << np.uint32(24)) | (pad[1:-2] << np.uint32(16)) | (pad[2:-1] << np.uint32(8)) | pad[3:]
    at, out = offsets.astype(np.int64).copy(), np.empty((len(offsets), step), np.uint32)
    for i in range(min(step, n)):
        found = lookup[(window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - most)]
        out[:, i] = found >> np.uint32(5)
        at += found & np.uint32(31)
    return out.reshape(-1)[:n]


def blocks(path: str, spaced: bool, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, part = encoder(path, spaced).encode, TaskContext.get().partitionId()
        docs, sizes, held, total, first = [], [], [], 0, 0
        counts = np.zeros(most, np.int64)

        def block(last: bool = False) -> pa.RecordBatch:
            ids = np.concatenate(held).astype("<u2" if narrow else "<u4").tobytes()
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            values = (part, first, docs, sizes, ids, counts.tobytes() if last else None)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["part", "first", "doc_ids", "sizes", "ids", "counts"])

        narrow = most <= 1 << 16
        for batch in batches:
            for piece in slices(batch, most=4 << 20):
                ids, lengths = encode(piece.column("text"))
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, np.uint32(end_id))
                docs += piece.column("doc_id").to_pylist()
                sizes += (lengths + 1).tolist()
                held.append(ids)
                counts += np.bincount(ids, minlength=most)
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield block()
                    first += total
                    docs, sizes, held, total = [], [], [], 0
        if docs or first:
            held = held or [np.empty(0, np.uint32)]
            yield block(last=True)

    return run


def as_ids(value: bytes, narrow: bool) -> np.ndarray:
    return np.frombuffer(value, "<u2" if narrow else "<u4")


def sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for value in batch.column("counts").drop_null():
            total = total + np.frombuffer(value.as_py(), np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used] if len(used) else [], pa.int64())], names=["id", "n"])


def write_bits(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("bits")
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = as_ids(row.column("ids")[0].as_py(), len(lengths) <= 1 << 16)
                bits, offsets = code.encode(ids.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("part", "first", "doc_ids", "sizes")), pa.array([bits], pa.binary()), pa.array([offsets], pa.list_(pa.int64()))], names=["part", "first", "doc_ids", "sizes", "bits", "offsets"])

    return run


def read_bits(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        lookup = code.decode_table()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                sizes = row["sizes"].values.to_numpy()
                offsets = row["offsets"].values.to_numpy()
                ids = decode(row["bits"].as_py(), offsets, int(sizes.sum()), lookup, code.most).astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e].tobytes()) for s, e in zip(sizes.tolist(), ends.tolist())]
                at = ends - sizes + row["first"].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"].as_py()] * len(sizes), pa.int32()), pa.array(at, pa.int64()), row["doc_ids"].values, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "at", "doc_id", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, spaced: bool = True, vocabulary: int = 50_257) -> tuple[DataFrame, bytes]:
    """(files, code lengths): all documents' ids in ascending order of doc_id."""
    read = docs.select(F.col("doc_id").cast("long"), "text")
    volume = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-volume // RANGE_BYTES))
    tie = F.xxhash64("text")
    dealt = read.repartitionByRange(int(ranges), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ids = cut(dealt.mapInArrow(blocks(path, spaced, end_id, vocabulary), BLOCKS), "ids")
    counts = np.zeros(vocabulary, np.int64)
    for r in ids.select("counts").where("counts IS NOT NULL").mapInArrow(sum_counts, "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[r[0]] = r[1]
    lengths = code_lengths(counts).tobytes()
    files = cut(ids.mapInArrow(write_bits(lengths), FILES), "token-files", "uncompressed")
    drop(ids)
    return files, lengths


def read_token_files(files: DataFrame, lengths: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone. A range's first position is the sum over the ranges before it."""
    per = files.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base = per.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))
    return files.mapInArrow(read_bits(lengths), DECODED).join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of the byte-level vocabulary, each closed by id 0."""
    return read_token_files(*write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))
