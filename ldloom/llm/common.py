"""What the operators of this subpackage share: shared tables, word hashes and small numpy tools."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: While a table is written: what its plan has shuffled is not read again, and Python gets texts in batches that two
#: workers can hold beside their caches.
WRITE_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Texts handled at once by a Python worker: bounds its memory, not the work.
SLICE_BYTES = 4 << 20
#: Bytes of a word hashed eight at a time together with other words.
LONG_WORD = 512
#: Masks of the first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Where none is set: a folder of our own on one machine (tests);
    on a cluster that would be a different folder on each machine, so it raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder := tempfile.mkdtemp(prefix="ldloom-"))
    return folder


#: Paths of the tables that cut() wrote and nothing deleted yet, oldest first.
_written: list[str] = []


def cut(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither redo its lineage nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITE_SETTINGS}
    for k, v in WRITE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    delete_on_exit(spark, path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ldloom_path = path
    return out


def written() -> int:
    """How many tables stand now: a mark for sweep()."""
    return len(_written)


def sweep(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete all tables written since a mark but this one: what operators left for a result that is itself a table now."""
    for path in _written[mark:]:
        if path != keep._ldloom_path:
            remove(spark, path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._ldloom_path)


def remove(spark: SparkSession, path: str) -> None:
    if path in _written:
        _written.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.array([0 if n is None else n for n in _lengths(batch.column(column))], np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hashes_of_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each word data[start : start + size] (bytes), eight bytes of all words at a time.

    A step is a bijection of what it takes in, so words of one size that differ in their last eight bytes alone never meet. Words
    over ``LONG_WORD`` bytes are hashed one by one."""
    out = mix64(sizes.astype(np.uint64) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    long = sizes > LONG_WORD
    at, done = np.flatnonzero((sizes > 0) & ~long), 0
    while len(at):
        left = np.minimum(sizes[at] - done, 8)
        piece = eight[starts[at] + done] & _FIRST[left]
        out[at] = mix64((out[at] ^ piece) * np.uint64(0xD6E8FEB86659FD93))
        done += 8
        at = at[sizes[at] > done]
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    return out


def words_of_all(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's begin and end; A-Z count as a-z if ``lower``. Arrow's ASCII
    white space is the same six characters as the words' separators ``[\\x20\\x09-\\x0D]``."""
    import pyarrow.compute as pc

    at_work("words")
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    upto = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(upto[0], upto[-1] - upto[0])
    wide = np.int64 if pa.types.is_large_string(words.type) else np.int32
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, wide)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    full = np.diff(bounds) > 0  # white space at an end of a text splits off an empty word
    hashes = hashes_of_words(data, (bounds[:-1] - bounds[0])[full], np.diff(bounds)[full])
    return hashes, np.concatenate([[0], np.cumsum(full)])[upto - upto[0]]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each window of k words, in order: windows of powers of two are joined two by two."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, out = mix64(words), 1, 0, None
    while True:
        if k & size:
            part = power[done : done + n]
            out = part.copy() if out is None else mix64(out * np.uint64(0xD6E8FEB86659FD93) + part)
            done += size
        if size * 2 > k:
            return out
        power = mix64(power[:-size] * np.uint64(0xA0761D6478BD642F) + power[size:])
        size *= 2


_memories: dict[str, Callable[[], None]] = {}
_in_use: list[str] = [""]


def remembers(kind: str, forget: Callable[[], None]) -> None:
    """Say how to empty what this worker keeps between tasks for one kind of work."""
    _memories[kind] = forget


def at_work(kind: str) -> None:
    """A worker serves many stages: when the kind of work changes, what others kept is given back."""
    if _in_use[0] == kind:
        return
    for other, forget in _memories.items():
        if other != kind:
            forget()
    _in_use[0] = kind
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def task_uid() -> Iterator[int]:
    """Numbers that no two tasks of a stage share and that a retried task repeats: partition id, then row."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    while True:
        yield at
        at += 1


