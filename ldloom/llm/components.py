"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in Spark joins.

Each step links nodes to the smallest neighbour known; the number of rounds grows with the logarithm of the component
size. Minima are summed in each task before the shuffle, so a node with very many neighbours is one key of a few rows; the joins back are
plain equi-joins whose large partitions Spark may split. Every round is written to the shared folder, and the round before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each upper node has one edge and is no one's lower node."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not both.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge between different nodes, the smallest node it can reach."""
    kept = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    kept = cut(kept, "edges")
    while not _is_star_forest(kept):
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(kept)
        kept = after
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
