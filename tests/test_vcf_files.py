"""Writing VCF: chunk files by the tasks alone, all or none; merging block gzip by its blocks."""

import gzip
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_vcf_reading import blocks, text_of

from ldloom.config import MergeConfig, PreprocessConfig, SimulateConfig, StandardConfig
from ldloom.operators import variants as V
from ldloom.plans import chunked
from ldloom.plans.standard import run_standard
from ldloom.sources import joined, splits, vcf, vcf_merge, vcf_write


def variants(spark, n: int, chunks: int):
    rows = spark.range(n).select(F.col("id").alias("row_idx"), F.lit("1").alias("chrom"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("rs"), "id").alias("id"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.array(F.col("id") / n, F.lit(0.5)).alias("dosages"))
    return rows.withColumn("chunk", (F.col("row_idx") % chunks).cast("int")).repartition(3, "chunk").sortWithinPartitions("chunk", "row_idx")


@pytest.mark.parametrize("compress", [False, True])
def test_tasks_write_the_files(spark, tmp_path, monkeypatch, compress):
    """No stream is opened by the driver, and none of its bytes are data."""
    monkeypatch.setattr(joined, "ByteStream", None)
    names = "part_{}.vcf" + ".gz" * compress
    (tmp_path / names.replace("{}", "3")).write_text("of an earlier run")
    made = vcf_write.write_files(variants(spark, 5000, 7), str(tmp_path), "chunk", names, 2, compress=compress)
    assert made == [f"{tmp_path}/{names.replace('{}', str(c))}" for c in range(7)] and sorted(os.listdir(tmp_path)) == sorted(n.rsplit("/", 1)[1] for n in made)
    for c, path in enumerate(made):
        text = (gzip.open(path, "rt") if compress else open(path)).read().splitlines()
        assert [x.split("\t")[1] for x in text[4:]] == [str(i) for i in range(c, 5000, 7)] and text[3].split("\t")[9:] == ["1", "2"]
        assert not compress or splits.kind_of(f"file://{path}") == "block"


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = variants(spark, 3000, 5).withColumn("dosages", F.when(F.col("row_idx") == 2998, F.raise_error("broken").cast("array<double>")).otherwise(F.col("dosages")))
    with pytest.raises(Exception, match="broken"):
        vcf_write.write_files(bad, str(tmp_path), "chunk", "c{}.vcf.gz", 2, compress=True)
    assert os.listdir(tmp_path) == []
    twice = variants(spark, 300, 5).repartition(4)
    with pytest.raises(Exception, match="two partitions"):
        vcf_write.write_files(twice, str(tmp_path), "chunk", "c{}.vcf", 2)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("size", [300, 5000, 1_000_000])
def test_merged_by_blocks_equals_merged_by_lines(spark, tmp_path, size):
    texts = [text_of(n, 5, seed=n) for n in (60, 45, 1)] + [text_of(50, 5, seed=9)[:-1], "".join(x + "\n" for x in text_of(9, 5).splitlines() if x[0] == "#"), text_of(8, 5)]
    for i, t in enumerate(texts):
        (tmp_path / f"chunk_{i}.vcf.gz").write_bytes(blocks(t, size))
    uris = [f"file://{tmp_path}/chunk_{i}.vcf.gz" for i in range(len(texts))]
    head = "".join(x + "\n" for x in texts[0].splitlines() if x[0] == "#")
    want = head + "".join(x + "\n" for t in texts for x in t.splitlines() if x[0] != "#")
    copied = vcf_merge.merge_blocks(spark, uris, f"{tmp_path}/by-blocks.gz")
    data = (tmp_path / "by-blocks.gz").read_bytes()
    assert gzip.decompress(data).decode() == want
    inner = sum(len(t) // size for t in texts)
    assert copied >= inner - 3 * len(texts) and (size > 300 or copied > 40)
    assert chunked.merge(spark, MergeConfig(str(tmp_path), f"{tmp_path}/all.vcf.gz")) == len(texts)
    assert open(f"{tmp_path}/all.vcf.gz", "rb").read() == data
    (tmp_path / "chunk_0.vcf.gz").write_bytes(gzip.compress(texts[0].encode()))  # one file that isn't made of blocks: by lines
    chunked.merge(spark, MergeConfig(str(tmp_path), f"{tmp_path}/lines.vcf.gz"))
    assert gzip.open(f"{tmp_path}/lines.vcf.gz", "rt").read() == want


def test_inner_blocks_are_not_opened(tmp_path, monkeypatch):
    opened, real = [], splits.unpacked
    monkeypatch.setattr(splits, "unpacked", lambda block, at=0: opened.append(at) or real(block, at))
    for i in range(3):
        (tmp_path / f"{i}.gz").write_bytes(blocks(text_of(200, 5, seed=i), 1000))
        plan = vcf_merge.plan_of(f"file://{tmp_path}/{i}.gz", i == 0)
        assert plan.blocks > 10 and plan.ended and len(plan.runs) == 1 and plan.seam.startswith(b"#") == (i == 0)
    assert len(opened) <= 3 * 3


@pytest.mark.parametrize("packed", [False, True])
def test_one_file_passes_no_byte_through_the_driver(spark, tmp_path, monkeypatch, packed):
    """Tasks write parts and copy them to their places, in ranges smaller than a part; an older file and its checksum go."""
    path = str(tmp_path / "deep/one.vcf")
    vcf_write.write_vcf(variants(spark, 10, 1), path, 2)
    rows = variants(spark, 20_000, 7)
    monkeypatch.setattr(joined, "RANGE_BYTES", 10_000)
    monkeypatch.setattr(joined, "ByteStream", None)
    real, driver = joined.copy_range, os.getpid()
    monkeypatch.setattr(joined, "copy_range", lambda *a: real(*a) if os.getpid() != driver else pytest.fail("the driver copies"))
    vcf_write.write_vcf(rows, path, 2, compress=packed)
    text = (gzip.open(path, "rt") if packed else open(path)).read().splitlines()
    assert text[:4] == vcf_write.header(2).splitlines() and [x.split("\t")[1] for x in text[4:]] == [str(i) for i in range(20_000)]
    assert os.listdir(tmp_path / "deep") == ["one.vcf"] and splits.kind_of(f"file://{path}") == ("block" if packed else "plain")
    vcf_write.write_vcf(rows.where("row_idx < 0"), path, 2, compress=packed)
    assert (gzip.open(path, "rt") if packed else open(path)).read() == vcf_write.header(2)


def test_a_failed_task_leaves_the_older_file(spark, tmp_path):
    (tmp_path / "one.vcf").write_text("older")
    bad = variants(spark, 3000, 5).withColumn("dosages", F.when(F.col("row_idx") == 2998, F.raise_error("broken").cast("array<double>")).otherwise(F.col("dosages")))
    with pytest.raises(Exception, match="broken"):
        vcf_write.write_vcf(bad, f"{tmp_path}/one.vcf", 2)
    assert os.listdir(tmp_path) == ["one.vcf"] and (tmp_path / "one.vcf").read_text() == "older"


def test_pieces_by_the_driver_where_tasks_do_not_see_the_file_and_where_none_are_joined(spark, tmp_path, monkeypatch):
    parts = []
    for i in range(4):
        (tmp_path / f"p{i}").write_bytes(bytes([65 + i]) * (1000 * i))
        parts.append(joined.Piece(f"file://{tmp_path}/p{i}", i, 1000 * i) if i else joined.Piece(data=b"head\n"))
    want = b"head\n" + b"".join(bytes([65 + i]) * (999 * i) for i in range(1, 4))
    joined.append(spark, parts, f"{tmp_path}/appended")
    assert (tmp_path / "appended").read_bytes() == want
    monkeypatch.setattr(joined, "copier", lambda target: lambda batches: batches)  # no task sees it
    monkeypatch.setattr(joined, "RANGE_BYTES", 700)
    joined.join(spark, parts, f"{tmp_path}/joined")
    assert (tmp_path / "joined").read_bytes() == want
    assert not joined.concatenated(spark, [f"{tmp_path}/p1", f"{tmp_path}/p2"], f"{tmp_path}/p")  # the local file system joins none
    with pytest.raises(OSError, match="ends at byte"):
        joined.append(spark, [joined.Piece(f"file://{tmp_path}/p1", 0, 2000)], f"{tmp_path}/short")


def test_lines_are_packed_in_the_worker_that_writes_them(spark, tmp_path, monkeypatch):
    """A task has one Python worker: what is packed doesn't go back to Spark before it is written."""
    rows = spark.range(5000).selectExpr("id AS row_idx", "concat('line', id) AS line").repartitionByRange(3, "row_idx").sortWithinPartitions("row_idx")
    used, own = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **k: used.append(1) or own(self, *a, **k))
    path = str(tmp_path / "a.gz")
    vcf_write.write_lines(rows, path, "head\n", True)
    assert gzip.open(path, "rt").read().splitlines() == ["head", *(f"line{i}" for i in range(5000))]
    ranges = used.pop()  # the copier of ranges, a job of its own
    assert used == [1] and ranges


def test_a_task_of_the_flow_has_one_python_worker(spark, tmp_path, monkeypatch):
    """Lines are read by the workers that decode them and made by those that write them, and the driver's rows go by Arrow: executors hold a worker a core."""
    (tmp_path / "a.vcf.gz").write_bytes(blocks(text_of(300, 6), 2000))
    frame, session = type(spark.range(1)), type(spark)
    plans, made, own, create = [], [], frame.mapInArrow, session.createDataFrame
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or own(self, *a, **k))
    monkeypatch.setattr(session, "createDataFrame", lambda self, data, *a, **k: made.append(data) or create(self, data, *a, **k))
    chunked.preprocess(spark, PreprocessConfig(str(tmp_path / "a.vcf.gz"), str(tmp_path / "prep"), maf=0.1, n_traits=3, chunk_size=40, seed=1))
    names = chunked.simulate(spark, SimulateConfig(str(tmp_path / "prep"), str(tmp_path / "chunks"), compress=True))
    assert chunked.merge(spark, MergeConfig(str(tmp_path / "chunks"), str(tmp_path / "all.vcf.gz"))) == len(names) > 1
    run_standard(spark, StandardConfig(str(tmp_path / "a.vcf.gz"), str(tmp_path / "out.vcf"), maf=0.1, n_traits=3, seed=1))
    assert len(plans) > 8 and not [p for p in plans if "MapInArrow" in p]
    assert made and all(isinstance(m, pa.Table) for m in made)
    lines = gzip.open(tmp_path / "all.vcf.gz", "rt").read().splitlines()[4:]
    assert len(lines) > 50 and all(len(x.split("\t")) == 12 for x in lines)


def test_ranges_with_a_bitmap_read_its_rows_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "SPLIT_BYTES", 3000)
    (tmp_path / "a.vcf.gz").write_bytes(blocks(text_of(600, 8), 2000))
    file = vcf.VcfFile(spark, str(tmp_path / "a.vcf.gz"))
    every = {r["row_idx"]: str(r) for r in file.variants().collect()}
    assert sorted(every) == list(range(4, 604)) and file.tasks > 5 and file.lines.rdd.getNumPartitions() == file.tasks
    some = [r for r in every if r % 7 == 0 or 200 < r < 300]
    bits = spark.createDataFrame(V.bitmap(spark.createDataFrame([(r, True) for r in some], "row_idx long, has_ds boolean")).collect(), "bucket long, bits binary, single long, whole long")
    assert {r["row_idx"]: str(r) for r in file.variants(bits).collect()} == {r: every[r] for r in some}
    rows = np.arange(V.BITS * 2 - 20, V.BITS * 2 + 20)
    assert vcf.in_bits({1: b"\xff" * 4096, 2: b"\x05" + b"\0" * 4095}, rows).tolist() == [True] * 20 + [True, False, True] + [False] * 17


def test_texts_are_made_in_small_parts():
    """However large Arrow's batches are, and however long their rows."""
    wide = pa.RecordBatch.from_arrays([pa.array([[0.5] * 50_000] * 20)], names=["dosages"])
    narrow = pa.RecordBatch.from_arrays([pa.array(range(5000))], names=["id"])
    assert [p.num_rows for p in vcf_write.parts(wide)] == [2] * 10 and [p.num_rows for p in vcf_write.parts(narrow)] == [1000] * 5
