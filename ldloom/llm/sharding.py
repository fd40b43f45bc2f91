"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of slots; virtual nodes sit on slots, a key hashes to one. A row goes to the first shard
clockwise that still has room. Rows are counted by bin (slot and part of a slot), so the walk along the ring is done once
over these counts, whose number depends on the ring and never on the data; what it yields (which ranks of a bin go to
which shard) is joined back as a broadcast table of that bounded size. A slot has ``PARTS`` parts, one with more than its share of the rows up to ``FINE``, so
that no bin holds much over a 4,096th of them unless a slot holds over a quarter. Reading the rows twice and ranking them inside
their bin are all that grows with the data.

Loads are row counts. With ``slack=0`` the capacities add up to the number of rows, so every shard is exactly full:
counts differ by one at most. With slack > 0 a shard holds at most ceil((1 + slack) * rows / shards), and fewer rows move
when a shard is added.

Defined cases: a null key is a key like any other; a null tie column too. Rows that share a key share a slot and are
split over its parts by their tie columns, so a hot key is ranked in several tasks; rows equal in key and tie columns are
interchangeable. An empty table gives no rows. Input columns are kept, whatever their names; ``shard`` and ``slot`` replace columns so named.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, fresh, table

SLOTS = 1 << 13
PARTS = 8
#: Parts that rows are counted by, and the most that a slot has.
FINE = 1 << 10
#: A bin is meant to hold at most this share of the rows.
BIN_SHARE = 4096
VIRTUAL_NODES = 64
SHARDS = 40


def ring(shards: int, virtual_nodes: int, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node in ring order. A node's place depends on its shard's number and its own only."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(b"%d:%d" % (s, v), digest_size=8).digest(), "big") % slots
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def walk(counts: dict[int, int], shards: int, virtual_nodes: int, slack: float, slots: int = SLOTS, parts: int = PARTS) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each bin go: (bin, first rank, end rank, shard, slot of the first)."""
    total = sum(counts.values())
    if slack > 0:
        room = [math.ceil((1 + slack) * total / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    nodes = ring(shards, virtual_nodes, slots)
    after = list(range(1, len(nodes))) + [0]  # the next node clockwise that may have room
    load, out, node = [0] * shards, [], 0
    for b in sorted(counts):
        while node < len(nodes) and nodes[node][0] < b // parts:
            node += 1
        left, done, at, passed = counts[b], 0, node % len(nodes), []
        while left:
            s = nodes[at][1]
            take = min(left, room[s] - load[s])
            if take:
                out.append((b, done, done + take, s, load[s]))
                load[s] += take
                done += take
                left -= take
            if load[s] >= room[s]:
                passed.append(at)
                at = after[at]
        for p in passed:  # full shards stay full: later walks jump over them
            after[p] = at if p != at else after[p]
    return out


def shard(df: DataFrame, key: str, tie: list[str], shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """df with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    spark: SparkSession = df.sparkSession
    slot = F.pmod(F.xxhash64(F.lit("ring"), F.col(key)), F.lit(SLOTS)).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(key), *tie), F.lit(FINE)).cast("int")
    fine = cut(df.groupBy(slot.alias("s"), part.alias("p")).count(), "bins")
    wanted = F.col("n") * BIN_SHARE / F.sum("n").over(Window.partitionBy())
    of_slot = fine.groupBy("s").agg(F.sum("count").alias("n")).select("s", F.least(F.lit(FINE), F.greatest(F.lit(PARTS), F.pow(F.lit(2), F.ceil(F.log2(wanted))))).cast("int").alias("parts"))  # SLOTS rows at most
    hot = of_slot.where(F.col("parts") > PARTS)
    parts = {r["s"]: r["parts"] for r in hot.collect()}  # BIN_SHARE / PARTS rows at most
    known = F.broadcast(spark.createDataFrame([(s, n) for s, n in parts.items()], "_hot int, _parts int"))
    binned = fine.join(known, fine["s"] == F.col("_hot"), "left").groupBy((F.col("s") * FINE + F.col("p") % F.coalesce("_parts", F.lit(PARTS))).alias("b")).agg(F.sum("count").alias("n"))
    counts = {r["b"]: r["n"] for r in binned.collect()}  # SLOTS * PARTS rows, and some thousand of hot slots
    drop(fine)
    plan = walk(counts, shards, virtual_nodes, slack, parts=FINE)
    kept = df.drop("shard", "slot")
    b, rank, own, start, end, base, hot_slot, n_parts = (fresh(kept, x) for x in ("bin", "rank", "own_bin", "start", "end", "base", "hot_slot", "n_parts"))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    plan_df = F.broadcast(spark.createDataFrame(pa.table([pa.array([r[i] for r in plan], t) for i, t in enumerate(kinds)], names=[own, start, end, "shard", base])))
    order = Window.partitionBy(b).orderBy(F.xxhash64(F.lit("rank"), F.col(key), *tie), F.col(key), *tie)
    placed = kept.join(known.select(F.col("_hot").alias(hot_slot), F.col("_parts").alias(n_parts)), slot == F.col(hot_slot), "left")
    ranked = placed.withColumn(b, slot * FINE + part % F.coalesce(n_parts, F.lit(PARTS))).drop(hot_slot, n_parts).withColumn(rank, F.row_number().over(order).cast("long") - 1)
    joined = ranked.join(plan_df, (F.col(b) == F.col(own)) & (F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(end)))
    return joined.select(*kept.columns, "shard", (F.col(base) + F.col(rank) - F.col(start)).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards; law ``rows``: the counts of any two shards differ by one at most. Null text: no bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("tie")
    )
    out = shard(docs, "doc_id", ["tie"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
