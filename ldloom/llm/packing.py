"""Packing: first-fit decreasing with a tournament tree over bin room, run independently in randomised groups.

Texts become ids once, in their partition; only lengths and checksums of the pieces leave it (a document's ids are cut
every ``capacity`` ids, so a piece fits a sequence). Pieces are written to a shared table with a number of their own, dealt
by a hash of that number into groups of about ``GROUP`` pieces (so neither a document nor a group of copies makes a group
large), and each group is packed alone. Groups are many, so the number of groups grows with the data and the work of each
does not; the padding lost at the end of a group is about one sequence in a thousand.

Defined cases: a null or empty text is its end id alone; texts of any length are cut, never shortened; repeated rows
and null ids are packed like any others; an empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, task_uid

CAPACITY = 4096
GROUP = 4096
END_ID = 2
PIECES = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Rooms:
    """A tournament tree: the leftmost bin with room for n is found in log2(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first(self, n: int) -> int:
        at, best, leaves = 1, self.best, self.leaves
        while at < leaves:
            at *= 2
            if best[at] < n:
                at += 1
        return at - leaves

    def take(self, b: int, n: int) -> int:
        """Room of bin b before n is taken from it."""
        at, best = b + self.leaves, self.best
        room = best[at]
        best[at] = room - n
        at //= 2
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at //= 2
        return room


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item; items longest first, ties in the given order."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    rooms = Rooms(max(1, len(lengths)), capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = rooms.first(lengths[i])
        bins[i], offsets[i] = b, capacity - rooms.take(b, lengths[i])
    return bins, offsets


def cut_pieces(path: str, capacity: int, end_id: int, spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, uid = encoder(path, spaced).encode, task_uid()
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ids, lengths = encode(part.column("text"))
                rows, at = [], 0
                for doc_id, n in zip(part.column("doc_id").to_pylist(), lengths.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for s in range(0, n + 1, capacity):
                        piece = own[s : s + capacity]
                        rows.append((next(uid), doc_id, s, len(piece), zlib.crc32(piece.tobytes()), n + 1))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].tolist(), capacity)
        group["sequence_id"] = (np.int64(group["grp"].iloc[0]) << np.int64(32)) + np.array(bins, np.int64)
        group["offset"] = np.array(offsets, np.int64)
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, spaced: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset. ``path``: a tokenizers file that every executor has."""
    pieces = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_pieces(path, capacity, end_id, spaced), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit("pack"), F.col("uid")), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack_group(capacity), PACKED)


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are on this machine and its executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids of the word vocabulary."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


