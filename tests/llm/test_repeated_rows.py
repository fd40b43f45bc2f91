"""Rows without an id, rows that share an id, and equal rows: each operator's result for them."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from ldloom.llm import minhash
from ldloom.llm.queries import QUERIES

RNG = random.Random(8)
A, B = (" ".join(RNG.choices("ab cd ef gh ij kl mn op qr st".split(), k=80)) for _ in range(2))
ROWS = [(None, A), (None, None), (5, A), (5, A), (5, B), (6, A), (7, B), (8, None)]
LABELS = [(5, 1), (None, 1), (6, None)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("repeated"))
    n = len(ROWS)
    columns = {"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": [r[1] for r in ROWS], "lang": pa.array([None] * n, pa.string()), "source": pa.array([None, "a"] * (n // 2)), "n_chars": pa.array([None] * n, pa.int64())}
    pq.write_table(pa.table(columns), f"{at}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in LABELS], pa.int64()), "quality": pa.array([1] * 3, pa.int32()), "toxic": pa.array([x[1] for x in LABELS], pa.int32())}), f"{at}/labels.parquet")
    return at


def found(spark, folder, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()), key=str)


def test_documents_linked_by_any_of_their_rows(spark, folder):
    got = found(spark, folder, "op1_minhash", "doc_id", "component_id", "kept")
    assert got == sorted([(None, None, True)] * 2 + [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (8, 8, True)], key=str)


def test_each_text_of_a_shared_id_links(spark):
    prose = [[f"w{RNG.randrange(500)}" for _ in range(120)] for _ in range(6)]
    rows = [(i + 1, " ".join(p)) for i, p in enumerate(prose)] + [(50, " ".join([*p, "end"])) for p in prose] + [(60, "of its own")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 1) for i in (*range(1, 7), 50)} | {(60, 60)}


def test_equal_rows_are_one_document_for_repeats(spark, folder):
    got = found(spark, folder, "op3_substring_dedup", "doc_id", "n_words", "n_removed")
    assert got == sorted([(5, 80, 0)] * 3 + [(6, 80, 80), (7, 80, 80), (8, 0, 0), (None, 80, 80), (None, 0, 0)], key=str)


def test_every_row_is_encoded_in_turn(spark, folder):
    got = found(spark, folder, "op4_token_files", "start", "n_tokens", "doc_id")
    ordered = sorted(got)
    assert len(got) == 8 and [x[0] for x in ordered] == [sum(y[1] for y in ordered[:i]) for i in range(8)]
    assert [x[2] for x in ordered] == [None, None, 5, 5, 5, 6, 7, 8]


@pytest.mark.parametrize("name", ["op5_mixing", "op6_sharding", "op8_secrets", "op9_toxicity", "op10_packing", "op13_best_fit"])
def test_every_row_has_its_result(spark, folder, name):
    assert [x[0] for x in found(spark, folder, name, "doc_id")] == sorted([r[0] for r in ROWS], key=str)


def test_repeated_rows_stay_once(spark, folder):
    docs = spark.createDataFrame([*ROWS, (None, A), (None, B)], "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, folder).collect()]
    assert sorted(got, key=str) == sorted([(None, A), (None, B), (None, None), (5, A), (5, B), (8, None)], key=str)


def test_the_pipeline_takes_them(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() >= 0
