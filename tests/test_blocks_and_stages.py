"""The blocked product, numbers addressed by block, and stage files of the tool this follows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ldloom import cli
from ldloom.config import SimulateConfig
from ldloom.operators import traits as T
from ldloom.operators.blocked import blocked_product
from ldloom.operators.simulate import gemm
from ldloom.plans import chunked
from ldloom.sources import stage_files
from ldloom.sources.store import stored


def test_any_block_is_the_slice_of_its_row(monkeypatch):
    monkeypatch.setattr(T, "SAMPLES", 100)
    for trait in (0, 7):
        row = T.trait_row(5, trait, 950)
        assert len(row) == 950 and len(set(row.tolist())) == 950
        for block in (9, 0, 4):
            n = T.block_sizes(950)[block]
            assert (T.trait_block(5, trait, block, n) == row[block * 100 : block * 100 + n]).all()
    rows = T.trait_tile(3, 0, 40, 2000)
    assert abs(rows.mean()) < 0.02 and abs(rows.std() - 1) < 0.02 and np.abs(np.corrcoef(rows) - np.eye(40)).max() < 0.15


@pytest.mark.parametrize("scale", [True, False])
def test_blocked_equals_whole(spark, monkeypatch, scale):
    """Rows over several blocks, ranges of samples that don't divide them, constant rows and rows with NaN."""
    rng = np.random.default_rng(4)
    z = rng.standard_normal((70, 130))
    z[5], z[6, 3] = 0, np.nan
    df = stored(spark.createDataFrame([(i * 3, f"rs{i}", row.tolist()) for i, row in enumerate(z)], "row_idx long, id string, z array<double>"), "z")
    w = rng.standard_normal((37, 130))
    blocks = spark.createDataFrame([(t, b, w[t, b * 40 : b * 40 + 40].tolist()) for t in range(37) for b in range(4)], "trait int, block int, w array<double>").repartition(5)
    got = {r["row_idx"]: r for r in blocked_product(df, blocks, 130, scale=scale, rows=9, traits=8, width=40, cell=2).collect()}
    want = {r["row_idx"]: r for r in gemm(df, w, scale=scale).collect()}
    assert got.keys() == want.keys() and all(got[i]["id"] == want[i]["id"] for i in got)
    assert np.allclose([got[i]["dosages"] for i in sorted(got)], [want[i]["dosages"] for i in sorted(got)], atol=1e-12, equal_nan=True)


def written_stages(folder, n_samples=6, counts=(3, 2), sizes=(4, 1, 3)):
    """Files as the tool writes them."""
    rng = np.random.default_rng(8)
    (folder / "traits").mkdir(parents=True)
    (folder / "chunks").mkdir()
    w, z, names = rng.standard_normal((sum(counts), n_samples)), rng.standard_normal((sum(sizes), n_samples)), []
    at = 0
    for t, c in enumerate(counts):
        w[at : at + c].astype("<f8").tofile(folder / f"traits/W_tile_{t}.bin")
        at += c
    (folder / "traits/metadata.txt").write_text(f"n_traits={sum(counts)}\nn_samples={n_samples}\nn_tiles={len(counts)}\ntile_trait_counts={','.join(map(str, counts))}\n")
    at = 0
    for c, n in enumerate(sizes):
        z[at : at + n].astype("<f8").tofile(folder / f"chunks/chunk_{c}.bin")
        own = [("1", 100 + i, f"rs={i}" if i == at else f"rs{i}", "A", "G") for i in range(at, at + n)]
        names += own
        (folder / f"chunks/chunk_{c}.meta").write_text(f"chunk_id={c}\nn_variants={n}\nn_samples={n_samples}\n" + "".join("\t".join(map(str, r)) + "\n" for r in own))
        at += n
    return w, z, names


def test_stage_files_come_in_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage_files, "RANGE_BYTES", 100)  # two records a range
    monkeypatch.setattr(stage_files, "SAMPLES", 4)
    w, z, names = written_stages(tmp_path / "in")
    m = stage_files.import_stages(spark, str(tmp_path / "in"), str(tmp_path / "prep"))
    assert (m["n_traits"], m["n_samples"], m["n_tiles"], m["n_variants"], m["n_chunks"]) == (5, 6, 2, 8, 3)
    rows = chunked.read_chunks(spark, str(tmp_path / "prep")).orderBy("row_idx").collect()
    assert [r["z"] for r in rows] == z.tolist() and [(r["chrom"], r["pos"], r["id"], r["ref"], r["alt"]) for r in rows] == names
    assert [(r["chunk_id"], r["row_in_chunk"]) for r in rows] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (2, 1), (2, 2)]
    tiles = chunked.read_traits(spark, str(tmp_path / "prep")).orderBy("trait").collect()
    assert [r["w"] for r in tiles] == w.tolist() and [r["tile_id"] for r in tiles] == [0, 0, 0, 1, 1]


def test_imported_stages_are_simulated(spark, tmp_path):
    w, z, names = written_stages(tmp_path / "in")
    stage_files.import_stages(spark, str(tmp_path / "in"), str(tmp_path / "prep"))
    files = chunked.simulate(spark, SimulateConfig(str(tmp_path / "prep"), str(tmp_path / "out")))
    y = z @ w.T / 6
    want = 2 * (y - y.min(1, keepdims=True)) / (y.max(1, keepdims=True) - y.min(1, keepdims=True))
    lines = [x.split("\t") for f in files for x in open(f).read().splitlines() if x[0] != "#"]
    assert [x[2] for x in lines] == [n[2] for n in names] and np.abs(np.array([x[9:] for x in lines], float) - want).max() < 5.1e-5


@pytest.mark.parametrize("name, change", [("traits/W_tile_1.bin", -8), ("chunks/chunk_2.bin", -3), ("chunks/chunk_0.bin", 8), ("chunks/chunk_1.meta", 1), ("traits/metadata.txt", 1)])
def test_files_of_another_size_raise(spark, tmp_path, name, change):
    written_stages(tmp_path / "in")
    path = tmp_path / "in" / name
    if name.endswith("bin"):
        data = path.read_bytes()
        path.write_bytes(data[:change] if change < 0 else data + b"\0" * change)
    else:
        path.write_text(path.read_text().replace("n_variants=1", "n_variants=2").replace("n_tiles=2", "n_tiles=3"))
    with pytest.raises(stage_files.StageError):
        stage_files.import_stages(spark, str(tmp_path / "in"), str(tmp_path / "prep"))


def test_large_matrices_are_multiplied_in_blocks(spark, tmp_path, monkeypatch):
    """simulate gives the same files whichever way the product is made."""
    written_stages(tmp_path / "in")
    stage_files.import_stages(spark, str(tmp_path / "in"), str(tmp_path / "prep"))
    texts = []
    for most in (1 << 20, 1):
        monkeypatch.setattr(chunked, "MATRIX_BYTES", most)
        files = chunked.simulate(spark, SimulateConfig(str(tmp_path / "prep"), str(tmp_path / f"out{most}"), compress=False))
        texts.append([open(f).read() for f in files])
    assert texts[0] == texts[1] and len(texts[0]) == 3


def test_exported_stages_are_the_files_that_came_in(spark, tmp_path):
    """Byte for byte; an id with '=' in a chunk's first line too. Through the command line."""
    written_stages(tmp_path / "in")
    assert cli.main(["import", "-in", str(tmp_path / "in"), "-out", str(tmp_path / "prep")], spark) == 0
    assert cli.main(["export", "-in", str(tmp_path / "prep"), "-out", str(tmp_path / "out")], spark) == 0
    files = lambda at: {str(p.relative_to(at)): p.read_bytes() for p in at.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert files(tmp_path / "out") == files(tmp_path / "in")


def test_rows_of_another_length_are_not_exported(spark, tmp_path):
    written_stages(tmp_path / "in")
    stage_files.import_stages(spark, str(tmp_path / "in"), str(tmp_path / "prep"))
    short = spark.read.parquet(str(tmp_path / "prep/chunks")).withColumn("z", F.when(F.col("row_idx") == 5, F.slice("z", 1, 3)).otherwise(F.col("z")))
    short.write.partitionBy("chunk_id").parquet(str(tmp_path / "short/chunks"))
    (tmp_path / "prep/traits").rename(tmp_path / "short/traits")
    (tmp_path / "prep/manifest").rename(tmp_path / "short/manifest")
    with pytest.raises(stage_files.StageError, match="chunk_2"):
        stage_files.export_stages(spark, str(tmp_path / "short"), str(tmp_path / "out"))
