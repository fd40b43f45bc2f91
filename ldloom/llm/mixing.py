"""Mixing sources to target weights: token totals per source, repetition rates, then floor(rate) copies of each document
plus one more with probability equal to the fraction, drawn from a hash of the seed and the document's id.

Totals are one aggregation with map-side sums, so a hot source costs no more than a small one. Targets fill like water:
a source's share by weight stops at ``cap`` times its size and the excess goes to the others by weight, which is solved at
once by sorting the sources by cap/weight. The targets come back to the documents as a broadcast table while there are at
most ``BROADCAST_SOURCES`` of them (their number is read from the written table), and by a plain join beyond that.

Defined cases: a null or wordless text has size 0 and is taken 0 words (copies are still drawn); a null source is a
source of its own, ordered last; a source without words has target 0 and gives no copies; a null id draws like any id;
repeated rows draw alike; an empty table gives no rows. Other columns are kept, whatever their names; ``size``, ``source_size``, ``target``,
``copies`` and ``taken`` replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

WORD = "[^\\x20\\x09-\\x0D]+"
CAP = 3
SEED = "mix-1"
BROADCAST_SOURCES = 50_000


def targets(sized: DataFrame, source: str = "source", cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target. ``sized`` has a column ``size``."""
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("nth"))
    per = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    per = per.withColumn("nth", F.row_number().over(by_name)).withColumn("weight", (F.col("nth") - 1) % 3 + 1)
    per = per.withColumn("limit", F.lit(cap) * F.col("source_size"))
    per = per.withColumn("all_words", F.sum("source_size").over(total))
    per = per.withColumn("capped_before", F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("all_words") - F.coalesce("capped_before", F.lit(0))).cast("double") / F.col("weight_from").cast("double")
    per = per.withColumn("own_level", level)
    first_free = F.min(F.when(F.col("own_level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("nth"), F.col("own_level"))))
    per = per.withColumn("level", first_free.over(total)["own_level"])
    return per.select(source, "source_size", F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP, seed: str = SEED) -> DataFrame:
    """df with size, source_size, target, copies and taken; one row per input row."""
    sized = df.drop("size", "source_size", "target", "copies", "taken").withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    wanted = cut(targets(sized.select(source, "size"), source, cap), "targets")
    if wanted.count() <= BROADCAST_SOURCES:
        wanted = F.broadcast(wanted)
    own = fresh(sized, "own_source")
    out = sized.join(wanted.withColumnRenamed(source, own), sized[source].eqNullSafe(F.col(own))).drop(own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    copies = F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row ``copies`` times."""
    nth = fresh(mixed, "nth")
    return mixed.where("copies > 0").withColumn(nth, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(nth)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3, ... of the sources by code point."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, (nth - 1) % 3 + 1 AS weight, 3 * source_size AS lim, sum(source_size) OVER () AS words FROM s),
c AS (SELECT *, ((words - coalesce(sum(lim) OVER (ORDER BY lim / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY lim / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS own_level FROM w),
l AS (SELECT arg_min(own_level, lim / weight) AS level FROM c WHERE own_level * weight <= lim),
t AS (SELECT source, source_size, least(lim::DOUBLE, coalesce(level * weight, 0)) AS target FROM c, l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS drawn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM r
"""
