"""VCF data lines to columns, in Arrow batches: numpy finds tabs, colons and commas in a batch's bytes and reads all cells at once.

A line is looked at once, and what comes out is a table: no filter on it can reach back and have the line split again, so the time is linear
in the bytes, whatever is asked of the result. Only the cells of the chosen samples are read; frequencies are made here too. Numbers
of up to nine plain digits are read in numpy, rarer forms one by one through a dictionary of those met.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

FIXED = 9
#: Bytes of lines handled at once: numpy's columns for them take some 50 times as much, in each worker.
SLICE_BYTES = 1 << 18
TAB, COLON, COMMA, DOT, ZERO = b"\t:,.0"
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(nan|inf|infinity)", re.IGNORECASE | re.ASCII)
_AF = re.compile(rb"(?:^|;)AF=([^;,]*)")
_DIGITS = re.compile(rb"[0-9]+")


class VcfError(ValueError):
    """The input isn't a VCF file this reader can use."""


def number(text: str) -> float | None:
    return float(text) if _NUMBER.fullmatch(text := text.strip()) else None


def round6(x: np.ndarray) -> np.ndarray:
    """Six decimals, half away from zero."""
    scaled = np.abs(x * 1e6)
    whole = np.floor(scaled)
    return np.copysign(whole + (scaled - whole >= 0.5), x) / 1e6 + 0.0


def bytes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[np.minimum(at, len(data) - 1)]


def floats(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(float32 values, which are numbers) of the texts data[start:end]."""
    size = end - start
    value, after, digits = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    dot, plain = np.zeros(len(start), bool), (size > 0) & (size <= 10)
    for j in range(int(size[plain].max(initial=0))):
        own = plain & (size > j)
        byte = bytes_at(data, start + j)
        digit = own & (byte >= ZERO) & (byte <= ZERO + 9)
        point = own & (byte == DOT) & ~dot
        value = np.where(digit, value * 10 + byte - ZERO, value)
        after += digit & dot
        digits += digit
        dot |= point
        plain &= ~own | digit | point
    plain &= (digits > 0) & (digits <= 9)
    out = (value / 10.0 ** np.where(plain, after, 0)).astype(np.float32)
    good = plain.copy()
    known: dict[bytes, float | None] = {b".": None, b"": None}
    for i in np.flatnonzero(~plain).tolist():
        text = data[start[i] : end[i]].tobytes()
        if text not in known:
            known[text] = number(text.decode("utf-8", "replace"))
        if (x := known[text]) is not None:
            with np.errstate(over="ignore"):
                out[i], good[i] = x, True
    return out, good


def alternate_alleles(text: str) -> int | None:
    """How many alleles of a genotype (0/1, 1|1, ...) aren't the reference; None if one is missing."""
    alleles = re.split("[/|]", text)
    return sum(int(a) > 0 for a in alleles) if all(a.isascii() and a.isdigit() for a in alleles) else None


def genotypes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for genotypes: alleles that aren't the reference are counted."""
    first, mark, second = (bytes_at(data, start + j) for j in range(3))
    digit = lambda b: (b >= ZERO) & (b <= ZERO + 9)
    plain = (end - start == 3) & digit(first) & digit(second) & ((mark == ord("/")) | (mark == ord("|")))
    out, good = ((first > ZERO).astype(np.float32) + (second > ZERO)), plain.copy()
    known: dict[bytes, int | None] = {}
    for i in np.flatnonzero(~plain).tolist():
        text = data[start[i] : end[i]].tobytes()
        if text not in known:
            known[text] = alternate_alleles(text.decode("utf-8", "replace"))
        if (n := known[text]) is not None:
            out[i], good[i] = n, True
    return out, good


class Marks:
    """Where a byte stands in the data, and the first such place at or after another."""

    def __init__(self, data: np.ndarray, byte: int):
        there = data == byte
        self.at = np.append(np.flatnonzero(there), len(data))
        self.before = np.zeros(len(data) + 1, np.int32)  # a batch of text has less than 2**31 bytes
        np.cumsum(there, dtype=np.int32, out=self.before[1:])

    def nth(self, place: np.ndarray, n: int = 0) -> np.ndarray:
        return self.at[np.minimum(self.before[np.minimum(place, len(self.before) - 1)] + n, len(self.at) - 1)]


def subfields(colons: Marks, commas: Marks, start: np.ndarray, end: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the first value of the nth part of each cell; empty where a cell has fewer parts."""
    if nth:
        start = np.minimum(colons.nth(start, nth - 1) + 1, end)
    end = np.minimum(end, colons.nth(start))
    return start, np.minimum(end, commas.nth(start))


class Lines:
    """The lines of a batch: ``data``, where each starts and ends, where its tabs are."""

    def __init__(self, values: pa.Array):
        values = values.cast(pa.binary()).fill_null(b"")
        _, offsets, data = values.buffers()
        bounds = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        self.data = np.frombuffer(data or b"\0", np.uint8)[bounds[0] : max(bounds[-1], bounds[0] + 1)]
        bounds = bounds - bounds[0]
        self.start, self.end = bounds[:-1], bounds[1:]
        self.tabs = Marks(self.data, TAB)
        self.first = self.tabs.before[self.start]
        self.fields = self.tabs.before[self.end] - self.first + 1

    def head(self, i: int) -> list[bytes]:
        """The fixed fields of a line."""
        n = int(self.first[i]) + FIXED - 1
        to = self.end[i] if self.fields[i] <= FIXED else self.tabs.at[n]
        return self.data[self.start[i] : to].tobytes().split(b"\t")

    def cells(self, rows: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of these samples' cells in these lines, which have them."""
        nth = self.first[rows][:, None] + FIXED - 1 + samples[None, :]
        end = np.minimum(self.tabs.at[np.minimum(nth + 1, len(self.tabs.at) - 1)], self.end[rows][:, None])
        return self.tabs.at[nth] + 1, end


def info_af(info: bytes) -> float | None:
    """First AF value as a float of 32 bits; None without AF, NaN for a missing value."""
    found = _AF.search(info)
    if not found or not found[1]:
        return None
    return float("nan") if found[1] == b"." else number(found[1].decode("utf-8", "replace"))


def whole_lines(lines: Lines, samples: int | None, mode: str) -> np.ndarray:
    """Lines with the right number of fields and a position; FAILFAST raises on another."""
    good = lines.fields == FIXED + samples if samples is not None else lines.fields >= FIXED
    for i in np.flatnonzero(good).tolist():
        at = lines.tabs.at[lines.first[i]] + 1
        good[i] = _DIGITS.fullmatch(lines.data[at : lines.tabs.at[lines.first[i] + 1]].tobytes()) is not None
    if mode == "FAILFAST" and not good.all():
        bad = int(np.flatnonzero(~good)[0])
        raise VcfError(f"malformed line: {lines.data[lines.start[bad] : lines.end[bad]].tobytes()[:80].decode('utf-8', 'replace')}")
    return good


def frequencies(info: np.ndarray, ds: list[np.ndarray | None]) -> np.ndarray:
    """INFO's frequency (NaN: missing value; masked ones are None before) or that of the dosages, None without both."""
    out = np.empty(len(ds), object)
    for i, own in enumerate(ds):
        if info[i] is not None:
            out[i] = info[i]
        elif own is not None and len(counted := own[own >= 0]):
            out[i] = float(round6(np.cumsum(counted)[-1:] / (2.0 * len(counted)))[0])
    return out


def decoder(names: list[str], value: str, samples: int | None, chosen: list[int] | None, af: bool, ds: bool, field: str, impute: bool, mode: str, emit_af: bool, emit_ds: bool):
    """Batches of lines -> batches of columns. ``chosen``: the samples read, by number; ``impute``: missing dosages are 0, as doubles."""
    read, kind = (genotypes if field == "GT" else floats), (pa.float64() if impute else pa.float32())

    def columns(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column(value))
        if mode:
            good = whole_lines(lines, samples, mode)
            if not good.all():
                batch = batch.filter(pa.array(good))
                lines = Lines(batch.column(value))
        n = batch.num_rows
        heads = [(h + [None] * (FIXED - len(h)))[:FIXED] for h in map(lines.head, range(n))]
        text = lambda xs: pa.array(xs, pa.binary()).cast(pa.string())
        pos = [int(h[1]) if h[1] and _DIGITS.fullmatch(h[1]) and int(h[1]) < 1 << 31 else None for h in heads]
        known = [None if not af or h[7] is None else info_af(h[7]) for h in heads]
        rounded = [None if x is None else x if x != x else float(round6(np.array([np.float32(x)], np.float64))[0]) for x in known]
        place = np.array([h[8].split(b":").index(field.encode()) if ds and h[8] is not None and field.encode() in h[8].split(b":") else -1 for h in heads], np.int64)
        if not emit_ds:  # only what has no frequency of its own is read
            place = np.where([x is not None for x in rounded], -1, place)
        has = np.array([ds and h[8] is not None and field.encode() in h[8].split(b":") for h in heads], bool)
        there = np.maximum(lines.fields - FIXED, 0)
        width = np.minimum(there, samples) if samples is not None else there
        values: list[np.ndarray | None] = [None] * n
        masks: list[np.ndarray | None] = [None] * n
        colons = commas = None
        for size, nth in sorted({(w, p) for w, p in zip(width.tolist(), place.tolist()) if p >= 0}):
            rows = np.flatnonzero((width == size) & (place == nth))
            wanted = np.arange(size) if chosen is None else np.array(chosen, np.int64)
            held = wanted[wanted < size]
            colons, commas = colons or Marks(lines.data, COLON), commas or Marks(lines.data, COMMA)
            start, end = (x.ravel() for x in lines.cells(rows, held))
            x, ok = read(lines.data, *subfields(colons, commas, start, end, nth))
            full, mask = np.zeros((len(rows), len(wanted)), np.float64 if impute else np.float32), np.zeros((len(rows), len(wanted)), bool)
            full[:, wanted < size] = np.where(ok, x, 0).reshape(len(rows), -1)
            mask[:, wanted < size] = ok.reshape(len(rows), -1)
            for i, a, b in zip(rows.tolist(), full, mask):
                values[i], masks[i] = a, b
        others = [batch.column(c) for c in names]
        out = [*others, text([h[0] for h in heads]), pa.array(pos, pa.int32()), text([b"." if h[2] is None else h[2] for h in heads]), text([h[3] for h in heads]), text([None if h[4] is None else h[4].split(b",")[0] for h in heads]), pa.array(rounded, pa.float64())]
        if emit_af:
            imputed = values if impute else [None if v is None else np.where(m, v, 0).astype(np.float64) for v, m in zip(values, masks)]
            out += [pa.array(frequencies(rounded, imputed), pa.float64()), pa.array(has)]
        if emit_ds:
            lengths = np.array([0 if v is None else len(v) for v in values], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32(), mask=np.append([v is None for v in values], False))
            flat = np.concatenate([v for v in values if v is not None] or [np.zeros(0)])
            bare = None if impute else ~np.concatenate([m for m in masks if m is not None] or [np.zeros(0, bool)])
            out.append(pa.ListArray.from_arrays(offsets, pa.array(flat, kind, mask=bare)))
        made = [*names, "chrom", "pos", "id", "ref", "alt", "info_af", *(["af", "has_ds"] if emit_af else []), *(["ds"] if emit_ds else [])]
        return pa.RecordBatch.from_arrays(out, names=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(value)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
                yield columns(batch.slice(at, to - at))
                at = to

    return run


def decode(lines: DataFrame, samples: int | None = None, chosen: list[int] | None = None, *, af: bool = True, ds: bool = True, field: str = "DS", impute: bool = False, mode: str = "", value: str = "value", emit_af: bool = False, emit_ds: bool = True, reader: Callable | None = None) -> DataFrame:
    """The other columns of ``lines``, then chrom, pos, id, ref, alt, info_af, if asked af and has_ds, and ds.

    ``samples``: how many a line has (None: as many as are there); ``chosen``: which are read, in order, repeats included. ``af``, ``ds``: whether INFO's AF and
    the dosage field may be used. ``impute``: missing dosages are 0, and doubles. ``mode``: FAILFAST raises on a line with a bad position or a wrong number
    of fields, DROPMALFORMED leaves it out, none takes what is there. Without ``emit_ds`` cells are read only where a frequency must be made from them.
    ``reader``: batches of ``lines`` to batches of row_idx and value, in the worker that decodes them."""
    others = [StructField("row_idx", LongType())] if reader else [f for f in lines.schema.fields if f.name != value]
    text = [StructField(c, IntegerType() if c == "pos" else StringType()) for c in ("chrom", "pos", "id", "ref", "alt")]
    from pyspark.sql.types import BooleanType

    more = [StructField("info_af", DoubleType()), *([StructField("af", DoubleType()), StructField("has_ds", BooleanType())] if emit_af else [])]
    more += [StructField("ds", ArrayType(DoubleType() if impute else FloatType()))] if emit_ds else []
    run = decoder([f.name for f in others], value, samples, chosen, af, ds, field, impute, mode, emit_af, emit_ds)
    return lines.mapInArrow((lambda batches: run(reader(batches))) if reader else run, StructType([*others, *text, *more]))
