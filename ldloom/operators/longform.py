"""The same operators over (variant, sample, dosage) rows. Cells that aren't there are missing, which counts as 0, so
sums run over the stored cells and the absent ones enter by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(cells: DataFrame, n_samples: Column) -> DataFrame:
    """variant, cells, mean, sd over all samples. The centred sum keeps constant rows exact."""
    sums = cells.groupBy("variant").agg(F.count("*").alias("cells"), F.sum("dosage").alias("total"))
    mean = sums.select("variant", "cells", (F.col("total") / n_samples).alias("mean"))
    squares = cells.join(mean, "variant").groupBy("variant", "cells", "mean").agg(F.sum((F.col("dosage") - F.col("mean")) * (F.col("dosage") - F.col("mean"))).alias("s"))
    return squares.select("variant", "cells", "mean", F.sqrt((F.col("s") + (n_samples - F.col("cells")) * F.col("mean") * F.col("mean")) / n_samples).alias("sd"))


def standardize(cells: DataFrame, n_samples: Column) -> DataFrame:
    """variant, sample, z of the stored cells."""
    joined = cells.join(moments(cells, n_samples), "variant")
    return joined.select("variant", "sample", F.when(F.col("sd") == 0, 0.0).otherwise((F.col("dosage") - F.col("mean")) / F.when(F.col("sd") != 0, F.col("sd"))).alias("z"))


def simulate(cells: DataFrame, weights: DataFrame, n_samples: Column) -> DataFrame:
    """variant, trait, y = z . w / S, by an equi-join on the sample. weights: sample, trait, w."""
    totals = weights.groupBy("trait").agg(F.sum("w").alias("w_total"))
    sums = cells.join(weights, "sample").groupBy("variant", "trait").agg(F.sum(F.col("dosage") * F.col("w")).alias("dw"))
    every = sums.join(totals, "trait").join(moments(cells, n_samples), "variant")
    y = (F.col("dw") - F.col("mean") * F.col("w_total")) / F.when(F.col("sd") != 0, F.col("sd") * n_samples)
    return every.select("variant", "trait", F.when(F.col("sd") == 0, 0.0).otherwise(y).alias("y"))


def scale(rows: DataFrame, value: str = "y") -> DataFrame:
    """variant, trait, dosage: each variant's values to [0, 2]."""
    w = Window.partitionBy("variant")
    lo, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    both = rows.withColumn("_lo", lo).withColumn("_span", span)
    return both.select("variant", "trait", F.when(F.col("_span") == 0, 1.0).otherwise(F.lit(2.0) * (F.col(value) - F.col("_lo")) / F.when(F.col("_span") != 0, F.col("_span"))).alias("dosage"))
