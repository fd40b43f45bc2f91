"""Secret scans: spans by pattern in every whole text, then how widely each candidate is owned over the corpus.

One pass over the texts finds the base spans and, beside them, long mixed tokens that look random (the candidates the
method adds). It writes only spans and 64-bit hashes of their values. The hashes are aggregated by distinct repository
and owner: a value that several owners hold is a copied example, a value with one owner looks live. The verdicts return
to the documents by a join of these small tables; a value copied into a third of the rows is one summed key in the
aggregation, and the join is a plain equi-join whose large partitions Spark may split.

In ``documents`` the owner is the source, the repository the source and language.

Defined cases: null text is empty and has no span; a null owner is an owner of its own; repeated rows are judged one by one and count as
one repository; texts of any length are scanned whole; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_work, cut, slices, table, task_uid

# The three base patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "token")
#: Added candidates: runs this long with a digit, both cases, and this many bits per character.
TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}")
TOKEN_BITS = 3.5
#: A value held by so many distinct owners is a copied example.
EXAMPLE_OWNERS = 3

SCANNED = "uid long, doc_id long, tie long, repo string, owner string, cands array<struct<start:int,end:int,kind:int,h:long>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base spans. A span is the whole match; an assignment's value is its group 2."""
    out = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    out = []
    for m in TOKEN.finditer(text):
        v = m[0]
        if v.isalpha() or v.lower() == v or v.upper() == v or not any(map(str.isdigit, v)) or bits_per_character(v) < TOKEN_BITS:
            continue
        if not any(m.start() < e and s < m.end() for s, e, _, _ in taken):
            out.append((m.start(), m.end(), 3, v))
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("h", pa.int64())]))
    at_work("spans")
    uid = task_uid()
    for batch in batches:
        for part in slices(batch):
            cands = []
            for text in part.column("text").to_pylist():
                found = base_spans(text) if text else []
                found += token_spans(text, found) if text else []
                cands.append([{"start": s, "end": e, "kind": k, "h": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)} for s, e, k, v in found])
            uids = pa.array([next(uid) for _ in cands], pa.int64())
            yield pa.RecordBatch.from_arrays([uids, *(part.column(c) for c in ("doc_id", "tie", "repo", "owner")), pa.array(cands, kind)], names=["uid", "doc_id", "tie", "repo", "owner", "cands"])


def ownership(cands: DataFrame) -> DataFrame:
    """h -> rows, distinct repositories and owners. First the distinct holders (summed in each task), then their counts."""
    held = cands.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    owners = held.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return owners.groupBy("h").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, repo=None, owner=None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: uid, doc_id, tie (a hash of its text), spans array<struct<start,end,kind,n_owners,n_repos,live>> by start, then kind.

    Added candidates are spans only while they look live; base spans always stay."""
    repo = F.to_json(F.struct("source", "lang")) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    read = docs.select(F.col("doc_id").cast("long"), repo.alias("repo"), owner.alias("owner"), F.xxhash64("text").alias("tie"), "text")
    seen = cut(read.mapInArrow(scan, SCANNED), "secrets")
    cands = seen.select("uid", "repo", "owner", F.explode("cands").alias("c")).select("uid", "repo", "owner", "c.*")
    judged = cands.join(ownership(cands), "h").withColumn("live", F.col("n_owners") < example_owners).where("kind < 3 OR live")
    per = judged.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos", "live"))).alias("spans"))
    return seen.select("uid", "doc_id", "tie").join(per, "uid", "left")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, and what the corpus says of them: n_example, n_live."""
    found = find_secrets(table(spark, sf_dir, "documents"))

    def told(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))

    spans = F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,n_owners:bigint,n_repos:bigint,live:boolean>>"))
    base = F.filter(spans, lambda x: x["kind"] < 3)
    of_kind = lambda k: lambda x: x["kind"] == k
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    return found.select(
        "doc_id",
        *(count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(spans).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
    )
