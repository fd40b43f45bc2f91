"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing, each stage an operator over what the last kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldloom.llm import minhash, mixing, packing, secrets, toxicity
from ldloom.llm.common import cut, fresh, slices, sweep, table, written

#: What stands in a text for a secret: one that looks live, one that is copied widely.
LIVE, EXAMPLE = "<secret>", "<example-secret>"


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay as they are, null and empty texts and repeated rows too: each row is scored by itself. Without a
    confirmed toxic row all stay; an empty table stays empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    return toxicity.with_score(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Rows that repeat both id and text stay once, also where the id is null (their other columns are those of any one
    of them). Different texts of the id that stays all stay, and a text without an id goes only for an equal one without an id.
    """
    found = minhash.near_duplicates(docs)
    gone = found.where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # repeats are commonly few, so only their rows are dealt out whole
    tie, own, same = fresh(docs, "tie"), fresh(docs, "own_id"), fresh(docs, "own_tie")
    left = left.withColumn(tie, F.xxhash64("text"))
    again = left.groupBy("doc_id", tie).count().where("count > 1").select(F.col("doc_id").alias(own), F.col(tie).alias(same))
    on = left["doc_id"].eqNullSafe(F.col(own)) & (left[tie] == F.col(same))
    return left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates(["doc_id", tie])).select(*docs.columns)


def redact(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            texts = []
            for text, spans in zip(part.column("text").to_pylist(), part.column(name).to_pylist()):
                at, out = 0, []
                for span in spans or []:
                    if span["start"] >= at:
                        out += [text[at : span["start"]], LIVE if span["live"] else EXAMPLE]
                    at = max(at, span["end"])
                texts.append(text if not spans else "".join([*out, text[at:]]))
            names = [c for c in part.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names], names=names)

    return run


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret found gives way to a mark that says whether it looked live, and n_chars, if there is such a column, is counted anew. Null
    texts stay null; repeated rows lose the same spans; an empty table stays empty."""
    own, tie, spans = fresh(docs, "own_id"), fresh(docs, "tie"), fresh(docs, "spans")
    found = secrets.find_secrets(docs).where("spans IS NOT NULL").dropDuplicates(["doc_id", "tie"])
    found = found.select(F.col("doc_id").alias(own), F.col("tie").alias(tie), F.col("spans").alias(spans))
    same = docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(tie))
    marked = docs.join(found, same, "left").select(*docs.columns, spans).mapInArrow(redact(spans), docs.schema)
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return marked.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, its columns unchanged. A null source is a source; null texts have no words and are
    drawn like any others; rows that repeat an id are taken equally often; an empty table stays empty."""
    row = F.struct(*docs.columns).alias("row")
    return mixing.repeated(mixing.mix(docs.select("doc_id", "text", "source", row))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, copies included, in sequences of 4096 ids; a null or empty text is its end id alone; an empty table gives no rows."""
    return packing.pack(docs, packing.tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_civil),
    ("minhash", keep_one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]
#: Learning, signatures and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on its way goes when its result stands, and that when the next one's does."""
    docs, start = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
