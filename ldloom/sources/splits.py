"""Byte ranges of files as lines: block gzip (a sequence of small gzip members that say their size) is cut anywhere.

A range that starts inside a block goes on to the next block's header, which must be followed by another or the file's end. A line belongs to the
range in which its first block starts, as in Spark's text reader: each range but the first drops what comes before its first line end and reads on, past its own
end, to the end of its last line. Files are opened by Arrow's file systems (local, S3, GCS, HDFS); where these can't reach a path, callers
leave it to Spark's text reader, which reads a compressed file in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SPLIT_BYTES = 16 << 20
#: Text given out at once.
CHUNK_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08\x04"
#: A block has at most so many bytes.
BLOCK_BYTES = 1 << 16
#: Bytes of a compressed file read at once.
READ_BYTES = 4 * BLOCK_BYTES


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Arrow reads it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def system_of(uri: str):
    """(file system, path in it), or None if Arrow has none for it."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def opened(uri: str):
    """The file for reading at any place, or None if Arrow can't open it."""
    if (there := system_of(uri)) is None:
        return None
    try:
        return there[0].open_input_file(there[1])
    except OSError:
        return None


def block_size(data: bytes, at: int = 0) -> int:
    """The size that a block's header tells; 0 if no such header is here."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return 0
    extra, i = struct.unpack_from("<H", data, at + 10)[0], at + 12
    while i + 6 <= min(at + 12 + extra, len(data)):
        size = struct.unpack_from("<H", data, i + 2)[0]
        if data[i : i + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + size
    return 0


def first_block(file, start: int, size: int) -> int:
    """Where the first block at or after ``start`` starts; the file's size if none does."""
    if start == 0:
        return 0
    file.seek(start)
    data = file.read(3 * BLOCK_BYTES)
    at = data.find(MAGIC)
    while at >= 0:
        n = block_size(data, at)
        if n and (start + at + n == size or data[at + n : at + n + 4] == MAGIC):
            return start + at
        at = data.find(MAGIC, at + 1)
    return size


def blocks(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of each block from one on."""
    file.seek(at)
    data = b""
    while True:
        n = block_size(data)
        while (not n or len(data) < n) and (more := file.read(READ_BYTES)):
            data += more
            n = block_size(data)
        if not data:
            return
        if not n or len(data) < n:
            raise OSError(f"a block of the file is cut off or damaged at byte {at}")
        yield at, unpacked(data[:n], at)
        at, data = at + n, data[n:]


def unpacked(block: bytes, at: int = 0) -> bytes:
    header = 12 + struct.unpack_from("<H", block, 10)[0]
    text = zlib.decompress(block[header:-8], -15)
    if struct.unpack_from("<II", block, len(block) - 8) != (zlib.crc32(text), len(text)):
        raise OSError(f"a block of the file is damaged at byte {at}")
    return text


def whole_lines(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a range, some at once, each with its line end (the file's last line may have none)."""
    file = opened(uri)
    if file is None:
        raise OSError(f"can't open {uri}")
    with file:
        size = file.size()
        at = first_block(file, start, size)
        if at >= end:
            return
        held, total, begun = [], 0, start == 0
        for place, text in blocks(file, at, size):
            if place >= end:  # the rest of the last line
                to = text.find(b"\n") + 1
                held.append(text[: to or len(text)])
                if to or not begun:
                    break
                continue
            if not begun:
                to = text.find(b"\n") + 1
                if not to:
                    continue
                text, begun = text[to:], True
            held.append(text)
            total += len(text)
            if total >= CHUNK_BYTES:
                data = b"".join(held)
                to = data.rfind(b"\n") + 1
                if to:
                    yield data[:to]
                held, total = [data[to:]], len(data) - to
        if begun and (data := b"".join(held)):
            yield data


def plain_lines(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The same of a file that isn't compressed; a single gzip stream is one range, read as a whole."""
    file = opened(uri)
    if file is None:
        raise OSError(f"can't open {uri}")
    gzip = file.read(2) == MAGIC[:2]
    file.seek(0)
    with pa.CompressedInputStream(file, "gzip") if gzip else file as text:
        if not gzip:
            text.seek(start)
        at, held, begun = start, b"", start == 0
        while data := text.read(CHUNK_BYTES):
            over = not gzip and at + len(data) > end
            if over:  # a line that starts at the end is this range's too, since the next drops it
                rest = max(0, end - at)
                data, after = data[:rest], data[rest:]
            at += len(data)
            if not begun and (to := data.find(b"\n") + 1):
                data, begun = data[to:], True
            if begun:
                held += data
            if over:
                while begun and after:
                    to = after.find(b"\n") + 1
                    held += after[: to or len(after)]
                    after = b"" if to else text.read(CHUNK_BYTES)
                break
            if begun and (to := held.rfind(b"\n") + 1):
                yield held[:to]
                held = held[to:]
        if begun and held:
            yield held


def line_array(data: bytes) -> pa.Array:
    """Lines as strings, without their ends."""
    if b"\r\n" in data:
        data = data.replace(b"\r\n", b"\n")
    if not data.endswith(b"\n"):
        data += b"\n"
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data.replace(b"\n", b"")))


def kind_of(uri: str) -> str:
    """block, gzip or plain; empty if Arrow can't open it."""
    file = opened(uri)
    if file is None:
        return ""
    with file:
        head = file.read(BLOCK_BYTES)
    return "block" if block_size(head) else "gzip" if head[:2] == MAGIC[:2] else "plain"


def lines_of(kind: str, uri: str, start: int, end: int) -> Iterator[bytes]:
    return whole_lines(uri, start, end) if kind == "block" else plain_lines(uri, start, end)


def ranges(uri: str, size: int, most: int = SPLIT_BYTES) -> list[tuple[str, int, int]]:
    return [(uri, at, min(size, at + most)) for at in range(0, size, most)]
