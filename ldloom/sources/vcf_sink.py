"""``df.write.format("vcf_files")``: a VCF file for every value of a column, written by the tasks alone.

A task writes its files under names of its own in a folder beside them and tells their names in its commit message; when all have ended, the driver renames
them, so no byte of data passes through it, and a file is there as a whole or not at all. A task that fails removes what it wrote; a job that fails, and what
lost executors left, goes with the folder. Rows come sorted by (key, row_idx) and each key in one partition; a key in two is an error, and nothing is renamed.

``write_files`` does the same in a plain job, so that rows can be made by the workers that write them.

Options: path, key, names (with {} for the key), profile, traits, source, compress, level, job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import splits
from .vcf_write import BGZF_END, BLOCK, PROFILES, bgzf, header, line_texts, parts


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class Text:
    """One file: text in, plain or as blocks of gzip."""

    def __init__(self, stream, packed: bool, level: int):
        self.stream, self.packed, self.level, self.held = stream, packed, level, b""

    def write(self, data: bytes, whole: bool = False) -> None:
        """``whole``: what follows begins a block of its own."""
        if not self.packed:
            self.stream.write(data)
            return
        self.held += data
        end = len(self.held) if whole else len(self.held) // BLOCK * BLOCK
        if end:
            self.stream.write(bgzf(self.held[:end], self.level))
            self.held = self.held[end:]

    def close(self) -> None:
        self.write(b"", whole=True)
        if self.packed:
            self.stream.write(BGZF_END)
        self.stream.close()


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.uri, self.key, self.names, self.job = options["path"], options["key"], options["names"], options["job"]
        self.head = header(int(options["traits"]), options["profile"], options["source"])
        self.status, self.packed, self.level = PROFILES[options["profile"]][1], options["compress"] == "true", int(options["level"])

    def place(self):
        """(file system, folder of the files, folder of the parts)."""
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.uri)
        return system, folder, f"{folder}/_parts-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, rough = self.place()
        system.create_dir(rough, recursive=True)
        files: list[tuple[int, str]] = []
        out = None
        try:
            for batch in (p for b in iterator for p in parts(b)):
                keys, texts = batch.column(self.key).to_pylist(), line_texts(batch, self.status)
                starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                for s, e in zip(starts, [*starts[1:], len(keys)]):
                    if not files or files[-1][0] != keys[s]:
                        if out:
                            out.close()
                        files.append((keys[s], f"{keys[s]}-{uuid.uuid4().hex}"))
                        out = Text(system.open_output_stream(f"{rough}/{files[-1][1]}"), self.packed, self.level)
                        out.write(self.head.encode(), whole=True)
                    out.write("".join(f"{x}\n" for x in texts[s:e]).encode())
            if out:
                out.close()
        except BaseException:
            if out:
                out.stream.close()
            for _, name in files:
                system.delete_file(f"{rough}/{name}")
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, parts = self.place()
        files = sorted(f for m in messages if m for f in m.files)
        twice = [a[0] for a, b in zip(files, files[1:]) if a[0] == b[0]]
        if twice:
            self.abort(messages)
            raise ValueError(f"{self.key} {twice[0]} lies in two partitions")
        told = []
        for key, name in files:
            told.append(self.names.replace("{}", str(key)))
            system.move(f"{parts}/{name}", f"{folder}/{told[-1]}")
        system.create_dir(parts, recursive=True)
        system.delete_dir(parts)
        with system.open_output_stream(f"{folder}/_written-{self.job}") as out:
            out.write(json.dumps(told).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, _, parts = self.place()
        system.create_dir(parts, recursive=True)
        system.delete_dir(parts)


class VcfFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options))


def write_files(df: DataFrame, uri: str, key: str, names: str, n_traits: int, profile: str, compress: bool, source: str, level: int, make: tuple | None = None) -> list[str]:
    """The names of the files in order of their keys. ``uri``: a folder that Arrow's file systems reach. ``make``: what makes dosages of df's batches."""
    from pyarrow import fs

    job = uuid.uuid4().hex
    options = {"path": uri, "key": key, "names": names, "traits": n_traits, "profile": profile, "source": source, "compress": str(compress).lower(), "level": level, "job": job}
    options = {k: str(v) for k, v in options.items()}
    writer = FilesWriter(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = writer.write(make[0](batches) if make else batches).files
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in files], pa.int64()), pa.array([n for _, n in files], pa.string())], names=["key", "name"])

    rows = df if make else df.select(key, "chrom", "pos", "id", "ref", "alt", "dosages")
    try:
        files = [tuple(r) for r in rows.mapInArrow(run, "key long, name string").collect()]  # a row a file
    except BaseException:
        writer.abort([])
        raise
    writer.commit([Written(files)])
    system, folder = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(f"{folder}/_written-{job}") as told:
        made = json.loads(told.read())
    system.delete_file(f"{folder}/_written-{job}")
    return made


def reached(uri: str) -> bool:
    """Whether Arrow has a file system for it."""
    return splits.system_of(uri) is not None
