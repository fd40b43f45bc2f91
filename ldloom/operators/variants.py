"""Operators over variants: frequency, filters, duplicate ids, ordinals, counters.

A frame of variants has row_idx, chrom, pos, id, ref, alt, info_af (double; null: no AF, NaN: missing value) and ds
(array<float>; null: no dosages). Two modes differ on purpose:

- ``standard`` counts an id among the rows that pass the frequency and have dosages; a NaN frequency passes.
- ``chunked`` counts it among the rows whose frequency is a number in range, with dosages or not. A NaN frequency passes
  without being counted: its row stays where exactly one row of its id was counted, and else leaves as a duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dosage as D

#: Rows that share a bucket are ranked in one task; buckets are summed first, so no task sees all rows.
BUCKET_ROWS = 1 << 16


def project_samples(df: DataFrame, indices: list[int] | None) -> DataFrame:
    """Dosages of the chosen samples, missing ones 0. Null stays null: the row has no dosages."""
    ds = F.col("ds") if indices is None else D.gather(F.col("ds"), indices)
    return df.withColumn("ds", F.when(F.col("ds").isNotNull(), D.impute_zero(ds)))


def derive_af(df: DataFrame) -> DataFrame:
    """af: from INFO, else from the dosages, else null. A reader may have made it already."""
    return df if "af" in df.columns else df.withColumn("af", F.coalesce("info_af", D.af_from_dosage(F.col("ds"))))


def af_known(af: str = "af") -> Column:
    """There is a frequency. NaN is one; a negative number, as tools write for none, is not."""
    return F.col(af).isNotNull() & ~(F.col(af) < 0)


def passes_maf(maf: float, mode: str = "standard", af: str = "af") -> Column:
    """Known and in [maf, 1 - maf], both ends included. Spark holds NaN above all numbers, so it is tested by itself."""
    inside = (F.col(af) >= F.lit(float(maf))) & (F.col(af) <= F.lit(1.0 - float(maf))) & ~F.isnan(af)
    return af_known(af) & ((inside | F.isnan(af)) if mode == "standard" else inside)


def maf_filter(df: DataFrame, maf: float, mode: str = "standard") -> DataFrame:
    return df.where(passes_maf(maf, mode))


def dosages_there(df: DataFrame) -> Column:
    """Whether a row has dosages; rows that were read without them say so in has_ds."""
    return F.col("ds").isNotNull() if "ds" in df.columns else F.col("has_ds")


def has_dosages(df: DataFrame) -> DataFrame:
    return df.where(dosages_there(df))


def unique_ids(df: DataFrame) -> DataFrame:
    """Ids that occur once. Only ids are shuffled, summed in each task first, so the id '.' is no hot key."""
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")


def repeated_ids(df: DataFrame) -> DataFrame:
    """Ids that occur more than once, summed like unique_ids; commonly few."""
    return df.groupBy(F.col("id").alias("repeated_id")).agg(F.count("*").alias("n")).where("n > 1").select("repeated_id")


def without_repeated_ids(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows whose id ``counted`` holds once at most. A null id is an id. The repeated ids are few where the unique ones are
    many, so it is they that come to the rows, by broadcast when the planner finds them small."""
    repeated = repeated_ids(counted)
    return df.join(repeated, df["id"].eqNullSafe(repeated["repeated_id"]), "left_anti")


def comes_through(df: DataFrame, maf: float, mode: str = "standard") -> Column:
    """What the test of ids is made on: a frequency that passes, NaN too, and in standard mode dosages."""
    return passes_maf(maf) & (dosages_there(df) if mode == "standard" else F.lit(True))


def single_ids(df: DataFrame, maf: float, mode: str = "standard") -> DataFrame:
    """Rows that come through and pass the test of ids."""
    passed = df.where(comes_through(df, maf, mode))
    if mode == "standard":
        return without_repeated_ids(passed, passed)
    counted = passed.groupBy(F.col("id").alias("other_id")).agg(F.count_if(~F.isnan("af")).alias("n")).where("n != 1").select("other_id")
    return passed.join(counted, passed["id"].eqNullSafe(counted["other_id"]), "left_anti")


def drop_nonunique_ids(df: DataFrame, maf: float, mode: str = "standard") -> DataFrame:
    """Variants that pass all filters. ``df`` has af; arrays are shuffled only if the planner can't broadcast the repeated ids."""
    return has_dosages(single_ids(df, maf, mode))


#: Rows that one row of bits tells of, as bitmap_construct_agg makes them.
BITS = 1 << 15
#: Rows of bits, 4 KB each, that are sent to all tasks; more are joined like any table.
BROADCAST_BITS = 1 << 14


def bitmap(rows: DataFrame) -> DataFrame:
    """bucket, bits: which rows have dosages, a bit for each row_idx; single, whole: how many rows there are, and how many have dosages."""
    there = dosages_there(rows)
    of = rows.groupBy(F.floor(F.col("row_idx") / BITS).cast("long").alias("bucket"))
    return of.agg(F.bitmap_construct_agg(F.when(there, F.col("row_idx") % BITS)).alias("bits"), F.count("*").alias("single"), F.count_if(there).alias("whole"))


def rows_in(df: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of df whose row_idx is in a bitmap, a written table; df isn't shuffled while the bits are few."""
    few = F.broadcast(bits.select("bucket", "bits")) if bits.count() <= BROADCAST_BITS else bits.select("bucket", "bits")
    place = F.col("row_idx") % BITS
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(row_idx % {BITS} as int) div 8 + 1, 1)")), 16, 10).cast("long")
    met = df.withColumn("bucket", F.floor(F.col("row_idx") / BITS).cast("long")).join(few, "bucket")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*df.columns)


def pipeline_stats(df: DataFrame, maf: float, mode: str = "standard") -> DataFrame:
    """One row: total, filtered, duplicates, as the two modes count them. ``df`` has af."""
    keep = passes_maf(maf, mode) & (dosages_there(df) if mode == "standard" else F.lit(True))
    nan = F.isnan("af") if mode == "chunked" else F.lit(False)
    has = dosages_there(df)
    per = df.groupBy("id").agg(
        F.count("*").alias("rows"),
        F.count_if(keep).alias("kept"),
        F.count_if(keep & has).alias("whole"),
        F.count_if(F.coalesce(nan, F.lit(False))).alias("nans"),
        F.count_if(F.coalesce(nan, F.lit(False)) & has).alias("whole_nans"),
    )
    return per.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("kept") == 1, F.col("whole") + F.col("whole_nans")).otherwise(0)), F.lit(0)).alias("filtered"),
        # a NaN row is let through to the duplicate test in chunked mode and leaves there unless its id is counted once
        F.coalesce(F.sum(F.when(F.col("kept") != 1, F.col("kept") + F.col("nans")).otherwise(0)), F.lit(0)).alias("duplicates"),
    )


def with_rank(df: DataFrame, order: str = "row_idx", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rank: 0, 1, ... in the order of a non-negative long column. Rows are summed by bucket of that column; only the
    sums are ordered as a whole, and each bucket is ranked alone. Whole rows are shuffled: give it narrow ones."""
    bucket = F.floor(F.col(order) / F.lit(bucket_rows)).cast("long")
    sums = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)).cast("long") - 1
    ranked = df.withColumn("_bucket", bucket).withColumn("_inside", inside)
    return ranked.join(offsets, "_bucket").withColumn("rank", F.col("_offset") + F.col("_inside")).drop("_bucket", "_inside", "_offset")


def chunk_bounds(df: DataFrame, chunk_size: int) -> DataFrame:
    """chunk_id, first and end row_idx (end: null for the last), from the row_idx column alone: a row a chunk."""
    starts = with_rank(df.select("row_idx")).where(F.col("rank") % chunk_size == 0)
    return starts.select((F.col("rank") / chunk_size).cast("int").alias("chunk_id"), F.col("row_idx").alias("first"), F.lead("row_idx").over(Window.orderBy("row_idx")).alias("end"))


def assign_chunks(df: DataFrame, chunk_size: int) -> DataFrame:
    """chunk_id and row_in_chunk by rank among the rows that are left. Only row_idx is ranked over all rows. A chunk
    spans chunk_size values of row_idx at least, so a bucket of that width meets two chunks at most: rows find theirs by
    an equi-join with the bounds (few, so the planner broadcasts them) and are shuffled once, chunk by chunk."""
    width = F.lit(chunk_size)
    bucket = lambda c: F.floor(c / width).cast("long")
    top = df.agg(F.max("row_idx").alias("top"))
    bounds = chunk_bounds(df, chunk_size).crossJoin(F.broadcast(top))  # one row on the right
    upto = F.coalesce(F.col("end") - 1, F.col("top"))
    met = bounds.select("chunk_id", "first", upto.alias("last"), F.explode(F.sequence(bucket(F.col("first")), bucket(upto))).alias("_bucket"))
    placed = df.withColumn("_bucket", bucket(F.col("row_idx"))).join(met, "_bucket").where(F.col("row_idx").between(F.col("first"), F.col("last")))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("row_idx")).cast("int") - 1
    return placed.withColumn("row_in_chunk", place).select(*df.columns, "chunk_id", "row_in_chunk")


def chunk_range(df: DataFrame, start: int = -1, end: int = -1) -> DataFrame:
    """Chunks in [start, end] if both are given, else all; on partitioned Parquet this prunes folders."""
    return df.where(F.col("chunk_id").between(start, end)) if start >= 0 and end >= 0 else df
