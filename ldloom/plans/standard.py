"""The whole flow in one plan: read, derive and filter, drop repeated ids, standardize, project, rescale, write."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import StandardConfig, traits_per_tile
from ..functions import dosage as D
from ..operators import variants as V
from ..operators.blocked import blocked_product
from ..operators.simulate import MATRIX_BYTES, multiplier
from ..operators.traits import fresh_seed, traits
from ..sources.store import stored
from ..sources.vcf import VcfFile
from ..sources.vcf_write import in_order, write_vcf

log = logging.getLogger("ldloom")


@contextmanager
def timed(what: str):
    began = time.monotonic()
    yield
    log.info("%s: %.1f s", what, time.monotonic() - began)


def passing(spark: SparkSession, path: str, samples: str, maf: float, mode: str = "standard") -> tuple[DataFrame, list[str], dict[str, int]]:
    """(variants that pass all filters, sample names, what the filters counted).

    A first pass reads ids, frequencies and whether a line has dosages, in a narrow table; what passes is kept as a bitmap of row numbers, and only these
    lines' cells are decoded."""
    file, seen = VcfFile(spark, path, samples), Observation("heads")
    heads = file.heads().select("row_idx", "id", "af", "has_ds")
    heads = stored(heads.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(V.comes_through(heads, maf, mode)).alias("passed")), "heads")
    bits = stored(V.bitmap(V.single_ids(heads, maf, mode)), "passing")
    single, whole = bits.agg(F.coalesce(F.sum("single"), F.lit(0)), F.coalesce(F.sum("whole"), F.lit(0))).first()
    counts = {"total": seen.get["total"], "filtered": whole, "duplicates": seen.get["passed"] - single}
    log.info("total %(total)d, filtered %(filtered)d, duplicates %(duplicates)d", counts)
    return file.variants(bits).drop("has_ds"), file.names, counts


def with_z(kept: DataFrame) -> DataFrame:
    """z in place of ds."""
    return kept.withColumn("z", D.standardize(F.col("ds"))).drop("ds", "info_af")


def standardized(variants: DataFrame, maf: float, mode: str = "standard") -> DataFrame:
    """Variants that pass, with z in place of ds."""
    return with_z(V.drop_nonunique_ids(V.derive_af(variants), maf, mode))


def run_standard(spark: SparkSession, cfg: StandardConfig) -> int:
    """Writes the synthetic dosages; the number of variants written. Raises if none passes."""
    seed = fresh_seed() if cfg.seed is None else cfg.seed
    with timed("filter and standardize"):
        variants, names, counts = passing(spark, cfg.vcf, cfg.samples, cfg.maf)
        z = stored(with_z(variants), "standardized")
    if not (n := counts["filtered"]):
        raise ValueError("no variant passed the filters")
    if 8 * cfg.n_traits * len(names) <= MATRIX_BYTES:
        made, make = in_order(z), multiplier(z, seed=seed, n_traits=cfg.n_traits, per_tile=min(cfg.n_traits, 2000))
    else:  # no task makes a tile anew for each of its rows
        tile = traits_per_tile(cfg.n_traits, len(names))
        make, made = None, in_order(blocked_product(z, traits(spark, cfg.n_traits, len(names), seed, tile), len(names)))
    with timed("simulate and write"):
        write_vcf(made, cfg.out, cfg.n_traits, "standard", cfg.compress, ordered=True, make=make)
    return n
