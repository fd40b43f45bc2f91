"""The golden file's fate in both modes, the written files, and the flow's invariants."""

import gzip

import numpy as np
import pytest

from ldloom import cli
from ldloom.config import MergeConfig, PreprocessConfig, SimulateConfig, StandardConfig, traits_per_tile
from ldloom.functions import dosage as D
from ldloom.operators import variants as V
from ldloom.operators.simulate import gemm, scaled_rows
from ldloom.operators.traits import trait_row
from ldloom.plans.chunked import chunk_files, merge, preprocess, read_chunks, read_traits, simulate
from ldloom.plans.standard import run_standard, standardized
from ldloom.sources import decode, vcf, vcf_write

ROWS = [
    ("rs1", "G", "AF=0.30", "0,1,1,0"), ("rs2", "G", "AF=0.05", "0,0,1,0"), ("rs3", "G", "AF=0.1", "0,0,1,0"), ("rs4", "G", "AF=0.9", "2,2,1,2"),
    ("rs5", "G", ".", "0,.,2,1"), ("dup1", "G", "AF=0.2", "0,1,0,1"), ("dup1", "C", "AF=0.3", "1,1,0,0"), ("dup2", "G", "AF=0.2", "0,1,0,1"),
    ("dup2", "G", "AF=0.01", "0,0,0,0"), (".", "G", "AF=0.2", "0,1,0,1"), (".", "G", "AF=0.4", "1,1,0,1"), ("rs12", "G", "AF=0.2", None),
    ("rs13", "G", "AF=0.25", "0,1,1,0"), ("rs13", "G", "AF=0.25", None), ("rs15", "G", "AF=.", "0,1,1,0"), ("rs16", "G,T", "AF=0.3,0.05", "0,1,0,1"),
    ("rs17", "G", "AF=0.5", "1,1,1,1"), ("rs18", "G", "AF=0.3", "0,1,1,0"), ("rs18", "G", "AF=.", "0,1,1,0"),
]
HEADER = '##fileformat=VCFv4.2\n##INFO=<ID=AF,Number=A,Type=Float,Description="f">\n##FORMAT=<ID=DS,Number=1,Type=Float,Description="d">\n'


def golden_text() -> str:
    out = [HEADER + "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT S1 S2 S3 S4".split())]
    for i, (name, alt, info, ds) in enumerate(ROWS):
        cells = ["0/1"] * 4 if ds is None else [f"0/1:{x}" for x in ds.split(",")]
        out.append("\t".join(["1", str(100 + i), name, "A", alt, ".", "PASS", info, "GT" if ds is None else "GT:DS", *cells]))
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def golden(tmp_path_factory):
    path = tmp_path_factory.mktemp("vcf") / "golden.vcf"
    path.write_text(golden_text())
    return str(path)


def rare_only(folder):
    (folder / "rare.vcf").write_text("".join(x + "\n" for x in golden_text().splitlines() if x.startswith("#") or "rs2\t" in x))
    return str(folder / "rare.vcf")


def kept_rows(df):
    return sorted(r["pos"] - 99 for r in df.select("pos").collect())


def test_golden_fates(spark, golden):
    df, names = vcf.read_vcf(spark, golden)
    assert names == ["S1", "S2", "S3", "S4"]
    d = V.derive_af(df)
    assert kept_rows(V.drop_nonunique_ids(d, 0.1)) == [1, 3, 4, 5, 8, 13, 15, 16, 17]
    assert kept_rows(V.drop_nonunique_ids(d, 0.1, "chunked")) == [1, 3, 4, 5, 8, 16, 17, 18, 19]
    assert V.pipeline_stats(d, 0.1).first()[0:3] == (19, 9, 6)
    assert V.pipeline_stats(d, 0.1, "chunked").first()[0:3] == (19, 9, 7)
    af = {r["pos"] - 99: (r["af"], r["alt"]) for r in d.collect()}
    assert af[5][0] == 0.375 and af[3][0] == 0.1 and af[4][0] == 0.9 and af[16] == (0.3, "G") and np.isnan(af[15][0])


def test_golden_chain(spark, golden):
    df, _ = vcf.read_vcf(spark, golden)
    z = standardized(df, 0.1)
    first = z.where("id = 'rs1'").first()["z"]
    assert first == [-1, 1, 1, -1]
    w = np.array([[1.0, 0, 0, 0], [0, 1, 0, 0], [1, 1, 1, 1]])
    made = {r["id"]: r["dosages"] for r in gemm(z, w).collect()}
    assert made["rs1"] == [0, 2, 1] and made["rs17"] == [1, 1, 1]
    assert {tuple(r["dosages"]) for r in gemm(z, w[:1]).collect()} == {(1.0,)}


def test_sample_order_and_subset(spark, golden):
    df, names = vcf.read_vcf(spark, golden, "S3, S1,nope,S3")
    assert names == ["S3", "S1", "S3"]
    rows = {r["pos"] - 99: r for r in V.derive_af(df).collect()}
    assert rows[1]["ds"] == [1, 0, 1] and rows[5]["ds"] == [2, 0, 2] and rows[5]["af"] == 0.666667
    with pytest.raises(vcf.VcfError):
        vcf.read_vcf(spark, golden, "nobody")


def test_genotypes_on_request(spark, golden):
    rows = vcf.read_vcf(spark, golden, dosage_field="GT")[0].collect()
    assert len(rows) == 19 and all(r["ds"] == [1, 1, 1, 1] for r in rows)
    assert [decode.alternate_alleles(g) for g in ("0|0", "1/2", "./1", "1", "10|0", "x")] == [0, 2, None, 1, 1, None]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "bad.vcf").write_text(golden_text() + "1\tx\tbad\n")
    path = str(tmp_path / "bad.vcf")
    assert vcf.read_vcf(spark, path, mode="DROPMALFORMED")[0].count() == 19
    with pytest.raises(Exception, match="malformed"):
        vcf.read_vcf(spark, path)[0].collect()
    (tmp_path / "none.vcf").write_text("##x\n")
    with pytest.raises(vcf.VcfError):
        vcf.read_vcf(spark, str(tmp_path / "none.vcf"))


@pytest.mark.parametrize("name", ["out.vcf", "out.vcf.gz"])
def test_standard_run_writes_in_order(spark, golden, tmp_path, name):
    out = str(tmp_path / name)
    assert run_standard(spark, StandardConfig(golden, out, maf=0.1, n_traits=5, seed=11)) == 9
    text = (gzip.open(out, "rt") if name.endswith("gz") else open(out)).read().splitlines()
    assert text[0] == "##fileformat=VCFv4.1" and text[3].split("\t")[9:] == ["T1", "T2", "T3", "T4", "T5"]
    rows = [x.split("\t") for x in text[4:]]
    assert [r[2] for r in rows] == ["rs1", "rs3", "rs4", "rs5", "dup2", "rs13", "rs15", "rs16", "rs17"]
    for r in rows:
        v = [float(x) for x in r[9:]]
        assert r[6] == "PASS" and (v == [1.0] * 5 if r[2] == "rs17" else (min(v), max(v)) == (0, 2))
    again = str(tmp_path / f"again-{name}")
    run_standard(spark, StandardConfig(golden, again, maf=0.1, n_traits=5, seed=11))
    assert open(out, "rb").read() == open(again, "rb").read()


def test_chunked_run_equals_itself_for_any_chunk_size(spark, golden, tmp_path):
    merged = []
    for size in (2, 100):
        at = tmp_path / str(size)
        m = preprocess(spark, PreprocessConfig(golden, f"{at}/prep", maf=0.1, n_traits=4, chunk_size=size, traits_per_tile=3, seed=5))
        assert (m["n_variants"], m["n_chunks"], m["n_tiles"]) == (9, -(-9 // size), 2)
        assert cli.main(["simulate", "-prep", f"{at}/prep", "-out", f"{at}/chunks", "-compress"], spark) == 0
        assert cli.main(["merge", "-in", f"{at}/chunks", "-out", f"{at}/all.vcf", "-no-compress"], spark) == 0
        merged.append((at / "all.vcf").read_text())
    assert merged[0] == merged[1] and merged[0].count("\n") == 4 + 9
    stored = {r["trait"]: r["w"] for r in read_traits(spark, f"{tmp_path}/2/prep").collect()}
    assert all(stored[t] == trait_row(5, t, 4).tolist() for t in range(4))
    assert {r[0] for r in read_chunks(spark, f"{tmp_path}/2/prep", 1, 2).select("chunk_id").distinct().collect()} == {1, 2}
    assert cli.main(["simulate", "-prep", f"{tmp_path}/2/prep", "-out", f"{tmp_path}/part", "-start-chunk", "1", "-end-chunk", "1"], spark) == 0
    assert [p.rsplit("/", 1)[1] for p in chunk_files(spark, f"{tmp_path}/part")] == ["chunk_1.vcf"]
    packed = gzip.open(f"{tmp_path}/2/chunks/chunk_1.vcf.gz", "rt").read()
    assert packed == (tmp_path / "part/chunk_1.vcf").read_text() and packed.count("\n") == 4 + 2


def test_many_chunks_take_no_more_jobs(spark, golden, tmp_path):
    jobs = []
    for size in (1, 3):
        at = f"{tmp_path}/{size}"
        preprocess(spark, PreprocessConfig(golden, f"{at}/prep", maf=0.1, n_traits=2, chunk_size=size, seed=1))
        spark.sparkContext.setJobGroup(f"chunks of {size}", "")
        assert len(simulate(spark, SimulateConfig(f"{at}/prep", f"{at}/out"))) == 9 // size
        assert merge(spark, MergeConfig(f"{at}/out", f"{at}/all.vcf.gz")) == 9 // size
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chunks of {size}")))
        spark.sparkContext.setJobGroup("rest", "")
    assert jobs[0] <= jobs[1] + 2
    assert gzip.open(f"{tmp_path}/1/all.vcf.gz").read() == gzip.open(f"{tmp_path}/3/all.vcf.gz").read()


def test_parts_in_the_order_of_their_names_are_the_file(spark, golden, tmp_path):
    made = standardized(vcf.read_vcf(spark, golden)[0], 0.1).withColumnRenamed("z", "dosages")
    vcf_write.write_vcf(made, str(tmp_path / "one.vcf"), 4)
    vcf_write.write_parts(made, str(tmp_path / "parts"), 4)
    joined = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert joined == (tmp_path / "one.vcf").read_text() and joined.count("\n") == 4 + 9
    assert vcf.read_vcf(spark, str(tmp_path / "parts"))[0].count() == 9


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from ldloom.sources.store import shared_folder

    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_ranks_and_chunks_of_scattered_rows(spark):
    rows = sorted({(i * i * 37) % 5003 for i in range(400)})
    df = spark.createDataFrame([(r, [1.0]) for r in rows], "row_idx long, z array<double>").repartition(7)
    for size in (1, 7, 1000):
        got = {r["row_idx"]: (r["chunk_id"], r["row_in_chunk"]) for r in V.assign_chunks(df, size).collect()}
        assert got == {r: divmod(i, size) for i, r in enumerate(rows)}
    assert V.assign_chunks(df.where("row_idx < 0"), 5).count() == 0


def test_no_variant_left_is_an_error_in_both_modes(spark, tmp_path):
    with pytest.raises(ValueError, match="no variant"):
        preprocess(spark, PreprocessConfig(rare_only(tmp_path), str(tmp_path / "p"), maf=0.2))
    with pytest.raises(ValueError, match="no variant"):
        run_standard(spark, StandardConfig(rare_only(tmp_path), str(tmp_path / "y.vcf"), maf=0.2))


def test_chunk_files_orders(spark, tmp_path):
    for n in ("chunk_10.vcf", "chunk_2.vcf", "chunk_2.vcf.gz.tbi", "notes.txt"):
        (tmp_path / n).write_text("")
    names = lambda order: [p.rsplit("/", 1)[1] for p in chunk_files(spark, str(tmp_path), order)]
    assert names("numeric") == ["chunk_2.vcf", "chunk_10.vcf"] and names("lexicographic") == ["chunk_10.vcf", "chunk_2.vcf"]


def test_errors_are_reported(spark, golden, tmp_path, capsys):
    assert cli.main(["run", "-vcf", golden, "-out", str(tmp_path / "x.vcf"), "-maf", "0.7"], spark) == 1
    assert "Error:" in capsys.readouterr().err
    assert cli.main(["run", "-vcf", str(tmp_path / "missing.vcf"), "-out", str(tmp_path / "x.vcf")], spark) == 1
    assert cli.main(["merge", "-in", str(tmp_path / "missing"), "-out", str(tmp_path / "x.vcf")], spark) == 1
    assert capsys.readouterr().err.count("Error:") == 2
    with pytest.raises(ValueError):
        SimulateConfig("a", "b") and PreprocessConfig("a", "b", n_traits=0)


def test_projection_keeps_correlation():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((2, 200))
    rows = np.stack([base[0], 0.8 * base[0] + 0.6 * base[1]])
    z = (rows - rows.mean(1, keepdims=True)) / rows.std(1, keepdims=True)
    r = float(z[0] @ z[1] / 200)
    error = []
    for t in (100, 10_000):
        y = scaled_rows(z @ rng.standard_normal((t, 200)).T / 200)
        assert y.min() == 0 and y.max() == 2
        error.append(abs(np.corrcoef(y)[0, 1] - r))
    assert error[1] < 0.05 and error[1] < error[0] + 0.02


def test_block_gzip_and_tiles():
    data = bytes(range(256)) * 1000
    packed = vcf_write.bgzf(data) + vcf_write.BGZF_END
    assert gzip.decompress(packed) == data
    assert traits_per_tile(10, 4) == 10 and traits_per_tile(10_000, 134_217) == 1000 and traits_per_tile(10, 4, 3) == 3
    assert vcf.split_text("a,,b,", ",") == ["a", "", "b"]


def test_degenerate_arrays(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [float("nan"), 1.0]), (2, []), (3, None)], "row_idx int, d array<double>")
    rows = {r["row_idx"]: r for r in df.select("row_idx", D.standardize(df["d"]).alias("z"), D.scale_to_dosage(df["d"]).alias("s")).collect()}
    assert rows[0]["z"] == [0, 0] and rows[0]["s"] == [1, 1] and rows[2]["z"] == [] and rows[2]["s"] == [] and rows[3]["z"] is None
    assert np.isnan(rows[1]["z"]).all() and np.isnan(rows[1]["s"]).all()
