"""Merging block-gzip files by their blocks: inner blocks are copied as they are, only those that hold the end of a header, and each file's last one, are
opened. Each file's header goes but the first's, and so do the empty blocks that end a file. A task looks for the blocks of a file and writes the one that is made anew; the driver
learns which ranges to join (``joined``). The text is that of a merge by lines for files without empty or # lines among their data."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import splits
from .joined import Piece, join
from .store import frame, remove, scratch
from .vcf_write import BGZF_END, bgzf

PLAN = "nth long, seam string, size long, runs array<struct<start:long,end:long>>, blocks long, ended boolean"


@dataclass
class Plan:
    """What of a file is copied: text for a block made anew, then ranges of whole blocks."""

    seam: bytes
    runs: list[tuple[int, int]] = field(default_factory=list)
    blocks: int = 0
    #: Whether the text ends with a line end; None if there is none.
    ended: bool | None = None


def packed_blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the blocks from one on, as they are; empty ones, which end a file, are left out."""
    file.seek(at)
    data = b""
    while True:
        n = splits.block_size(data)
        while (not n or len(data) < n) and (more := file.read(1 << 20)):
            data += more
            n = splits.block_size(data)
        if not data:
            return
        if not n or len(data) < n:
            raise OSError(f"a block is cut off or damaged at byte {at}")
        if struct.unpack_from("<I", data, n - 4)[0]:
            yield at, data[:n]
        at, data = at + n, data[n:]


def after_header(file, size: int) -> tuple[bytes, bytes, int]:
    """(header, text after it in its last block, where the next block starts)."""
    text = b""
    for at, part in splits.blocks(file, 0, size):
        text += part
        to = 0
        while text[to : to + 1] == b"#" and (end := text.find(b"\n", to) + 1):
            to = end
        if to < len(text) and text[to : to + 1] != b"#":
            return text[:to], text[to:], _next(file, at)
    return text, b"", size


def _next(file, at: int) -> int:
    file.seek(at)
    return at + splits.block_size(file.read(splits.BLOCK_BYTES))


def plan_of(uri: str, with_header: bool) -> Plan:
    with splits.opened(uri) as file:
        head, rest, at = after_header(file, file.size())
        plan = Plan((head if with_header else b"") + rest)
        last = b""
        for place, last in packed_blocks(file, at):
            if plan.runs and plan.runs[-1][1] == place:
                plan.runs[-1] = plan.runs[-1][0], place + len(last)
            else:
                plan.runs.append((place, place + len(last)))
            plan.blocks += 1
        if text := splits.unpacked(last) if last else plan.seam:
            plan.ended = text.endswith(b"\n")
    return plan


def planner(folder: str, level: int):
    """nth, uri -> the plan, its seam in a file of the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = splits.system_of(folder)
        system.create_dir(where, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                plan, name = plan_of(r["uri"], r["nth"] == 0), f"seam-{uuid.uuid4().hex}"
                seam = bgzf(plan.seam, level)
                if seam:
                    with system.open_output_stream(f"{where}/{name}") as out:
                        out.write(seam)
                row = {"nth": r["nth"], "seam": f"{folder}/{name}", "size": len(seam), "runs": [{"start": s, "end": e} for s, e in plan.runs], "blocks": plan.blocks, "ended": plan.ended}
                yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    return run


FILES = pa.schema([("nth", pa.int64()), ("uri", pa.string())])
SCHEMA = pa.schema([("nth", pa.int64()), ("seam", pa.string()), ("size", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("blocks", pa.int64()), ("ended", pa.bool_())])


def merge_blocks(spark: SparkSession, uris: list[str], path: str, level: int = 6) -> int:
    """Writes the files one after another to ``path``; how many blocks were copied as they are."""
    folder = scratch(spark, "seams")
    line_end = Piece(data=bgzf(b"\n", level))
    try:
        files = frame(spark, list(enumerate(uris)), FILES).repartition(min(10_000, len(uris)), F.col("nth"))
        plans = sorted(files.mapInArrow(planner(splits.qualified(spark, folder), level), PLAN).collect(), key=lambda p: p["nth"])  # a row a file
        pieces, ended = [], True
        for uri, p in zip(uris, plans):
            if p["ended"] is None:
                continue
            pieces += [] if ended else [line_end]  # the file before ended without a line end
            pieces += [Piece(p["seam"], 0, p["size"])] * (p["size"] > 0) + [Piece(uri, r["start"], r["end"]) for r in p["runs"]]
            ended = p["ended"]
        join(spark, [*pieces, *([] if ended else [line_end]), Piece(data=BGZF_END)], path)
        return sum(p["blocks"] for p in plans)
    finally:
        remove(spark, folder)
