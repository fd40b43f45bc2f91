"""Reading VCF: the decoder, byte ranges of block gzip, late decoding, the data source and its pruning, counters."""

import gzip
import json
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ldloom.operators import variants as V
from ldloom.plans.standard import passing, standardized, with_z
from ldloom.sources import decode, splits, vcf, vcf_source, vcf_write

HEADER = '##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=A,Type=Float,Description="f">\n##FORMAT=<ID=DS,Number=1,Type=Float,Description="d">\n'


def text_of(rows: int, samples: int, seed: int = 1, chroms: int = 3, af: bool = True) -> str:
    rng = random.Random(seed)
    out = [(HEADER if af else HEADER.replace("INFO=<ID=AF", "INFO=<ID=XX")) + "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + [f"S{i}" for i in range(samples)])]
    for i in range(rows):
        info = rng.choice([f"AF={rng.random():.4f}", f"DP=2;AF={rng.random():.3f},0.1", ".", "AF=.", "XAF=0.5", "AF=0.02"])
        form, cell = rng.choice([("GT:DS", lambda: f"0/1:{rng.choice(['.', f'{2 * rng.random():.3f}', f'{2 * rng.random():.7g}', '1e-1', '2'])}"), ("DS", lambda: f"{rng.random():.4f},0.5"), ("GT:GP:DS", lambda: f"0|1:1,0,0:{rng.random():.2f}"), ("GT", lambda: "0/1")])
        name = rng.choice([f"rs{i}", f"rs{i}", f"rs{i - 1}", "."])
        out.append("\t".join([f"chr{1 + i * chroms // rows}", str(100 + i % (rows // chroms + 1)), name, "A", rng.choice(["G", "G,T"]), ".", "PASS", info, form, *(cell() for _ in range(samples))]))
    return "\n".join(out) + "\n"


def plain_rows(text: str, chosen: list[int] | None = None) -> list[tuple]:
    """The same by Python's own splitting: pos, id, alt, af (NaN as text), dosages or None."""
    out, declared = [], "INFO=<ID=AF" in text
    for line in text.splitlines():
        if line.startswith("#"):
            continue
        f = line.split("\t")
        info = dict(x.split("=") for x in f[7].split(";") if "=" in x).get("AF", "").split(",")[0] if declared else ""
        ds = None
        if "DS" in f[8].split(":"):
            at = f[8].split(":").index("DS")
            cells = [(c.split(":")[at] if len(c.split(":")) > at else ".").split(",")[0] for c in f[9:]]
            ds = [0.0 if c == "." else float(np.float32(c)) for c in (cells if chosen is None else [cells[i] for i in chosen])]
        if info == ".":
            af = "nan"
        elif info:
            af = np.floor(float(np.float32(info)) * 1e6 + 0.5) / 1e6
        else:
            af = np.floor(sum(ds) / (2 * len(ds)) * 1e6 + 0.5) / 1e6 if ds else None
        out.append((int(f[1]), f[2], f[4].split(",")[0], af, ds))
    return out


def as_rows(df) -> list[tuple]:
    return [(r["pos"], r["id"], r["alt"], "nan" if r["af"] is not None and np.isnan(r["af"]) else r["af"], r["ds"]) for r in df.orderBy("row_idx").collect()]


def assert_same(got: list[tuple], want: list[tuple]) -> None:
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[4] == w[4] and (g[3] == w[3] or abs(g[3] - w[3]) < 1.1e-6), (g, w)


def blocks(text: str, size: int, first: bytes = b"") -> bytes:
    """Block gzip with blocks of so many bytes of text; ``first``: more subfields before the one that tells the size."""
    out = []
    for at in range(0, len(text), size):
        raw = text[at : at + size].encode()
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(raw) + packer.flush()
        extra = first + b"BC\x02\0"
        whole = 12 + len(extra) + 2 + len(body) + 8
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra) + 2) + extra + struct.pack("<H", whole - 1) + body + struct.pack("<II", zlib.crc32(raw), len(raw)))
    return b"".join(out) + vcf_write.BGZF_END


@pytest.mark.parametrize("af", [True, False])
@pytest.mark.parametrize("chosen", ["", "S3, S1,nope,S3"])
def test_decoder_equals_plain_splitting(spark, tmp_path, chosen, af):
    text = text_of(300, 6, af=af)
    (tmp_path / "a.vcf").write_text(text)
    want = plain_rows(text, [3, 1, 3] if chosen else None)
    assert_same(as_rows(vcf.read_vcf(spark, str(tmp_path / "a.vcf"), chosen)[0]), want)


def test_odd_numbers_and_ragged_lines():
    texts = ["0.123", ".", "", "1", "2.0000", "-0.5", "1e-3", "0.1234567891234", "1.2.3", "abc", ".5", "5.", "1_0", "..", "+1", "123456789", "1234567890", "1e40"]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t) for t in texts])
    value, good = decode.floats(data, ends - [len(t) for t in texts], ends)
    want = [None if decode.number(t) is None else np.float32(decode.number(t)) for t in texts]
    assert [v if g else None for v, g in zip(value, good)] == want and np.isinf(value[-1])
    assert np.isnan(decode.number("nan")) and decode.number("1_0") is None
    lines = ["1\t5\trs\tA\tG\t.\t.\tAF=0.5\tDS\t0.5\t.", "1\t6\trs\tA\tG\t.\t.\t.\tDS\t0.5", "short", "", None, "1\tx\t.\tA\tG\t.\t.\tAF=x\tGT:DS\t0/1\t1:2"]
    batch = pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
    (out,) = decode.decoder([], "value", 2, None, True, True, "DS", False, "", False, True)(iter([batch]))
    assert out.column("ds").to_pylist() == [[0.5, None], [0.5], None, None, None, [None, 2]]
    assert out.column("pos").to_pylist() == [5, 6, None, None, None, None] and out.column("info_af").to_pylist() == [0.5, None, None, None, None, None]


def test_time_is_linear_in_the_samples():
    """A line's cells are read once: twice the samples take at most two and a half times the time, on batches that take long enough to tell."""
    took = []
    for n in (500, 1000, 2000):
        line = "\t".join(["1", "5", "rs", "A", "G", ".", ".", "AF=0.3", "GT:DS", *(f"0/1:{j % 2000 / 1000:.3f}" for j in range(n))])
        batch = pa.RecordBatch.from_arrays([pa.array([line] * 800)], names=["value"])
        best = 1e9
        for _ in range(3):
            began = time.process_time()
            for _ in decode.decoder([], "value", n, None, True, True, "DS", True, "FAILFAST", True, True)(iter([batch])):
                pass
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[2] < 2.5 * took[1] and took[1] < 2.5 * took[0] + 0.05, took


@pytest.mark.parametrize("size, split", [(700, 500), (64, 300), (5000, 900), (3000, 1 << 20), (1, 40)])
def test_ranges_of_blocks_give_every_line_once(tmp_path, size, split):
    text = text_of(40, 4) if size > 1 else text_of(5, 2)
    long = "x" * (3 * size) if size > 1 else "y"
    text += f"{long}\n\n{long}\nend without a line end"
    for name, first in (("a", b""), ("b", b"XY\x03\0abc")):
        path = tmp_path / f"{name}.gz"
        path.write_bytes(blocks(text, size, first))
        assert gzip.decompress(path.read_bytes()).decode() == text
        found = [data for r in splits.ranges(f"file://{path}", path.stat().st_size, split) for data in splits.whole_lines(*r)]
        assert b"".join(found).decode() == text
    (tmp_path / "p").write_text(text)
    found = [data for r in splits.ranges(f"file://{tmp_path}/p", len(text), split) for data in splits.plain_lines(*r)]
    assert b"".join(found).decode() == text


def test_damaged_blocks_raise(tmp_path):
    whole = blocks(text_of(50, 4), 1000)
    for i, bad in enumerate((whole[: len(whole) // 2], whole[:400] + b"\0" + whole[401:])):
        (tmp_path / f"{i}.gz").write_bytes(bad)
        with pytest.raises((OSError, zlib.error)):
            list(splits.whole_lines(f"file://{tmp_path}/{i}.gz", 0, len(bad)))


def test_a_block_gzip_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """A hundred blocks: more than one task reads them, and rows and numbers are those of the plain file."""
    monkeypatch.setattr(splits, "SPLIT_BYTES", 4000)
    text = text_of(400, 12)
    (tmp_path / "a.vcf").write_text(text)
    packed = blocks(text, len(text) // 99)
    (tmp_path / "a.vcf.gz").write_bytes(packed)
    (tmp_path / "one.vcf.gz").write_bytes(gzip.compress(text.encode()))
    lines = vcf.numbered_lines(spark, str(tmp_path / "a.vcf.gz"))
    assert lines.rdd.getNumPartitions() >= len(packed) // 4000
    tasks = {r[0] for r in lines.select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) > 4
    want = sorted(map(tuple, vcf.numbered_lines(spark, str(tmp_path / "a.vcf")).collect()))
    assert sorted(map(tuple, lines.collect())) == want == sorted(map(tuple, vcf.numbered_lines(spark, str(tmp_path / "one.vcf.gz")).collect()))
    both = vcf.numbered_lines(spark, [str(tmp_path / "one.vcf.gz"), str(tmp_path / "a.vcf.gz")]).orderBy("row_idx").collect()
    assert [r["value"] for r in both] == [v for _, v in want] * 2
    assert_same(as_rows(vcf.read_vcf(spark, str(tmp_path / "a.vcf.gz"))[0]), plain_rows(text))


@pytest.mark.parametrize("mode", ["standard", "chunked"])
@pytest.mark.parametrize("af", [True, False])
def test_only_passing_rows_are_decoded(spark, tmp_path, mode, af):
    """The same rows as filters after a whole decode; the second pass reads no other line's cells; counters are those of a scan of their own."""
    (tmp_path / "a.vcf").write_text(text_of(500, 5, seed=4, af=af))
    path = str(tmp_path / "a.vcf")
    every = V.derive_af(vcf.read_vcf(spark, path)[0])
    want = sorted(map(tuple, standardized(every.drop("has_ds"), 0.1, mode).select("row_idx", "pos", "id", "z").collect()))
    kept, names, counts = passing(spark, path, "", 0.1, mode)
    assert sorted(map(tuple, with_z(kept).select("row_idx", "pos", "id", "z").collect())) == want and names[0] == "S0"
    stats = V.pipeline_stats(every, 0.1, mode).first()
    assert counts == stats.asDict() and counts["filtered"] == len(want) < 450 and counts["duplicates"] > 10
    file = vcf.VcfFile(spark, path)
    heads = file.heads()
    bits = spark.createDataFrame(V.bitmap(V.single_ids(heads, 0.1, mode)).collect(), "bucket long, bits binary, single long, whole long")
    assert V.rows_in(file.lines, bits).count() == counts["filtered"]
    assert sorted(r["row_idx"] for r in V.rows_in(file.lines, bits).collect()) == [r[0] for r in want]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_counters_where_nothing_is_left(spark, tmp_path, threshold):
    """Plans that end empty still tell what they counted."""
    head = "".join(x + "\n" for x in text_of(3, 4).splitlines() if x[0] == "#")
    line = lambda i, name, af: "\t".join(["1", str(i), name, "A", "G", ".", ".", f"AF={af}", "DS", "0.1", "0", "0", "0"]) + "\n"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for text, want in (("", (0, 0, 0)), ("".join(line(i, f"r{i}", 0.001) for i in range(5)), (5, 0, 0)), ("".join(line(i, "r", 0.3) for i in range(5)), (5, 0, 5))):
            (tmp_path / "a.vcf").write_text(head + text)
            for mode in ("standard", "chunked"):
                kept, _, counts = passing(spark, str(tmp_path / "a.vcf"), "", 0.1, mode)
                assert tuple(counts.values()) == want and kept.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bitmaps_tell_rows_apart(spark):
    rows = sorted({(i * i * 7919) % 200_003 for i in range(3000)} | {0, 7, 8, 32_767, 32_768, 65_535})
    some = spark.createDataFrame([(r, r % 5 != 1) for r in [*rows, 100_001]], "row_idx long, has_ds boolean")
    bits = spark.createDataFrame(V.bitmap(some).collect(), "bucket long, bits binary, single long, whole long")
    rows = [r for r in rows if r % 5 != 1]
    assert [r[0] for r in V.rows_in(spark.range(200_010).select(F.col("id").alias("row_idx")), bits).orderBy("row_idx").collect()] == rows


def test_source_prunes_ranges(spark, tmp_path):
    vcf_source.register(spark)
    text = text_of(600, 8)
    (tmp_path / "a.vcf.gz").write_bytes(blocks(text, 2000))
    (tmp_path / "a.vcf").write_text(text)
    (tmp_path / "one.vcf.gz").write_bytes(gzip.compress(text.encode()))
    for name in ("a.vcf.gz", "a.vcf", "one.vcf.gz"):
        path = str(tmp_path / name)
        index = vcf_source.build_index(spark, path, split_bytes=3000)
        read = spark.read.format("vcf").option("index", index).option("samples", "S2,S0")
        df = read.load(path)
        assert_same(as_rows(df), plain_rows(text, [2, 0]))
        assert [r[0] for r in df.select("row_idx").orderBy("row_idx").collect()] == list(range(600))
        some = df.where("chrom = 'chr2' AND pos >= 110 AND pos < 140")
        want = [r for r in df.collect() if r["chrom"] == "chr2" and 110 <= r["pos"] < 140]
        got = some.collect()
        assert len(want) == 30 and sorted(r["row_idx"] for r in got) == sorted(r["row_idx"] for r in want)
        if name != "one.vcf.gz":
            assert some.rdd.getNumPartitions() < df.rdd.getNumPartitions() / 4
        assert df.where("chrom = 'chrX'").count() == 0 and df.where("chrom IN ('chr1', 'chr3')").count() == 400
        bare = spark.read.format("vcf").option("splitBytes", "3000").load(path)
        assert_same(as_rows(bare), plain_rows(text))
    (tmp_path / "a.vcf").write_text(text + text.splitlines()[-1] + "\n")
    with pytest.raises(Exception, match="another file"):
        spark.read.format("vcf").option("index", str(tmp_path / "a.vcf.zones")).load(str(tmp_path / "a.vcf")).count()


def test_source_reports_bad_lines(spark, tmp_path):
    vcf_source.register(spark)
    (tmp_path / "bad.vcf").write_text(text_of(20, 3) + "1\tx\tbad\n")
    path = str(tmp_path / "bad.vcf")
    with pytest.raises(Exception, match="malformed"):
        spark.read.format("vcf").load(path).count()
    assert spark.read.format("vcf").option("mode", "DROPMALFORMED").load(path).count() == 20


def test_a_batch_is_decoded_in_small_slices():
    """What numpy holds at once is bounded, however large Arrow's batches are."""
    import tracemalloc

    line = "\t".join(["chr1", "7", "v", "A", "G", ".", "PASS", ".", "GT:DS", *["0/1:0.125"] * 64])
    lines = pa.array([line] * 8000)  # 5 MB
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8000)), lines], names=["row_idx", "value"])
    run = decode.decoder(["row_idx"], "value", 64, list(range(64)), True, True, "DS", True, "FAILFAST", True, True)
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8000 and peak < 80 << 20


def test_an_index_takes_no_task_for_each_range(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(text_of(300, 4))
    spark.sparkContext.setJobGroup("zones", "")
    index = vcf_source.build_index(spark, str(path), split_bytes=500)
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("zones") for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    spark.sparkContext._jsc.clearJobGroup()
    assert len(json.loads(open(index).read())["ranges"]) > 30 and max(tasks) <= 4
