"""Best-fit packing with bound-certified repacking.

Texts become ids once, in their partition; only lengths and checksums of the pieces leave it. A text over the capacity is cut
into whole sequences, the first piece being what is left over; those of full length are sequences already. The other
pieces are dealt by a hash into partitions of about ``GROUP`` pieces, each packed by best-fit decreasing. Dual feasible functions
of the lengths give a lower bound on the number of sequences of any packing of the partition:

- it stays unrounded, since rooms in two partitions may add up to a sequence; a partition at its bound is certified and final;
- a partition with a gap keeps its full sequences and gives those with the most room, ``SHARE`` of the gap's tokens, into an exchange;
- the pieces in the exchange are dealt anew, from all partitions into some hundred times fewer, and packed again. A round
  that saves no sequence is undone and is the last, as is one with a single partition.

So the sequences that aren't full, one or a few of each partition, meet again, round by round, in ever fewer partitions, and each round handles a small
share of the one before. The distinct lengths are no more than the capacity, so the bound of the whole table comes from one small sum (``bound_of``).

Defined cases: a null or empty text is its end id alone; texts of any length are cut, never shortened; repeated rows and null ids are
packed like any others; an empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, slices, table, task_uid
from .packing import tokenizer_file

CAPACITY = 2048
END_ID = 0
#: Pieces of a partition.
GROUP = 4096
#: Of a partition's gap, in tokens, what the sequences it gives away hold as room.
SHARE = 0.75
#: Thresholds tried for each family of dual feasible functions.
THRESHOLDS = 256

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long, given boolean"


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n ids start: the first is what whole sequences leave over."""
    return [0] if n <= capacity else [*([0] if n % capacity else []), *range(n % capacity, n, capacity)]


def cut_pieces(path: str, capacity: int, end_id: int, spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, uid = encoder(path, spaced).encode, task_uid()
        for part in (p for batch in batches for p in slices(batch)):
            ids, lengths = encode(part.column("text"))
            rows, at = [], 0
            for doc_id, n in zip(part.column("doc_id").to_pylist(), lengths.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                starts = piece_starts(n + 1, capacity)
                for i, (s, e) in enumerate(zip(starts, [*starts[1:], n + 1])):
                    rows.append((next(uid), doc_id, i, s, e - s, zlib.crc32(own[s:e].tobytes())))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset, room left in each bin). Items come longest first; each goes where it leaves the least room.

    Bins wait in a list for each size of room, and a bit says whether a list holds any, so the least room that is enough is one step away."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, rooms, bits = [], [], [], 0
    for n in lengths:
        if enough := bits >> n:
            room = n + (enough & -enough).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                bits ^= 1 << room
        else:
            b, room = len(rooms), capacity
            rooms.append(room)
        bins.append(b)
        offsets.append(capacity - room)
        rooms[b] = room = room - n
        waiting[room].append(b)
        bits |= 1 << room
    return bins, offsets, rooms


@cache
def feasible(capacity: int) -> np.ndarray:
    """Dual feasible functions at the lengths 0 to capacity, one a row: lengths that fit in a sequence have values that sum to 1 at most.

    A length's share of the capacity; the same with lengths under a threshold as 0 and their complements as 1; rounded to k-ths; lengths up to half
    as equal parts of one, those over half by what they leave free, in thresholds."""
    x = np.arange(capacity + 1, dtype=np.int64)
    steps = np.unique(np.linspace(1, max(1, capacity // 2), THRESHOLDS).astype(np.int64))
    found = [x / capacity]
    for t in steps.tolist():
        found.append(np.where(x > capacity - t, 1.0, np.where(x < t, 0.0, x / capacity)))
        if 2 * t < capacity:
            small = np.where(x < t, 0.0, 1.0 / (capacity // t))
            found.append(np.where(2 * x > capacity, 1 - ((capacity - x) // t) / (capacity // t), small))
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        found.append(np.where(whole, x / capacity, (k + 1) * x // capacity / k))
    return np.array(found)


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """What any packing needs at least, unrounded. counts: how many items have the length 0, 1, ..., capacity."""
    return float((feasible(capacity) @ counts).max(initial=0.0))


def given_bins(rooms: list[int], bound: float, capacity: int) -> np.ndarray:
    """Which bins go into the exchange: those with the most room, until their rooms make up for the gap's share."""
    gap = len(rooms) - bound
    out = np.zeros(len(rooms), bool)
    if gap > 1e-6:
        room = np.array(rooms)
        order = np.argsort(-room, kind="stable")
        upto = np.cumsum(room[order])
        out[order[: int(np.searchsorted(upto, SHARE * gap * capacity)) + 1]] = True
    return out


def pack_group(capacity: int, turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        bins, offsets, rooms = best_fit_decreasing(group["length"].tolist(), capacity)
        bound = lower_bound(np.bincount(group["length"], minlength=capacity + 1), capacity)
        numbers = (np.int64(turn + 1) << np.int64(56)) + (np.int64(group["grp"].iloc[0]) << np.int64(20))
        group["sequence_id"] = numbers + np.array(bins, np.int64)
        group["offset"] = np.array(offsets, np.int64)
        group["given"] = given_bins(rooms, bound, capacity)[bins]
        return group.drop(columns="grp")

    return run


def sequences(placed: DataFrame) -> int:
    """A sequence has one piece at its start."""
    return placed.where("offset = 0").count()


def bound_of(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The least number of sequences that any packing of all pieces takes, by the same functions; a row a length reaches the driver."""
    counts = np.zeros(capacity + 1)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return math.ceil(lower_bound(counts, capacity) - 1e-6)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, spaced: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence and offset. ``path``: a tokenizers file that every executor has."""
    pieces = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_pieces(path, capacity, end_id, spaced), PIECES), "pieces")
    full = pieces.where(F.col("length") == capacity).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("given"))
    done, pool, turn, before = [full], pieces.where(F.col("length") < capacity), 0, None
    while n := pool.count():
        groups = -(-n // group)
        dealt = pool.select(*pieces.columns, F.pmod(F.xxhash64(F.lit("exchange"), F.lit(turn), F.col("uid")), F.lit(groups)).alias("grp"))
        placed = cut(dealt.groupBy("grp").applyInPandas(pack_group(capacity, turn), PLACED), "placed")
        if before is not None and sequences(placed) >= before:
            drop(placed)
            done.append(pool)
            break
        if groups == 1:
            done.append(placed)
            break
        done.append(placed.where("NOT given"))
        pool, turn = placed.where("given"), turn + 1
        before = sequences(pool)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids of the byte vocabulary."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
