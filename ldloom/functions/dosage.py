"""Column functions over dosage arrays. They stay in the JVM; none needs a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; inside a lambda a plain column would be computed once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round6(x: Column) -> Column:
    """Six decimals, half away from zero, without negative zero."""
    return F.round(x * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)


def impute_zero(ds: Column) -> Column:
    """Missing dosages count as 0 (homozygous reference); float values widen to double."""
    return F.transform(ds, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))


def gather(ds: Column, indices: list[int]) -> Column:
    """The dosages at these positions, in this order, repeats included; beyond the array: missing."""
    return F.transform(F.array(*map(F.lit, indices)), lambda i: F.get(ds, i))


def af_from_dosage(d: Column) -> Column:
    """Sum of the non-negative dosages over twice their number, 6 decimals; null if there is none."""
    counted = F.filter(d, lambda x: (x >= 0) & ~F.isnan(x))
    total = F.aggregate(counted, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(counted) > 0, F.round(total / (F.lit(2.0) * F.size(counted)) * 1e6, 0) / 1e6)


def af_from_info(info: Column) -> Column:
    """First AF value as float, widened, 6 decimals; null without AF, NaN for a missing value."""
    text = F.regexp_extract(info, "(?:^|;)AF=([^;,]*)", 1)
    number = F.try_cast(text, "float") if hasattr(F, "try_cast") else text.try_cast("float")
    value = F.when(text == ".", F.lit(float("nan"))).when(text != "", number.cast("double"))
    return F.when(F.isnan(value), value).otherwise(F.round(value * 1e6, 0) / 1e6)


def moments(d: Column) -> Column:
    """struct(mean, sd) with the population standard deviation, in two passes."""
    n = F.size(d).cast("double")
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0.0))
    return let(mean, lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n).alias("sd")))


def standardize(d: Column) -> Column:
    """z-scores; zeros where the standard deviation is 0."""
    scaled = let(moments(d), lambda s: F.transform(d, lambda x: F.when(s["sd"] == 0, F.lit(0.0)).otherwise((x - s["mean"]) / F.when(s["sd"] != 0, s["sd"]))))
    return F.when(F.size(d) == 0, d).otherwise(scaled)


def scale_to_dosage(y: Column) -> Column:
    """Least value to 0, greatest to 2; all 1 where they are equal; all NaN where one is NaN."""
    ends = F.struct(F.array_min(y).alias("lo"), F.array_max(y).alias("hi"), F.exists(y, F.isnan).alias("nan"))

    def scaled(s: Column) -> Column:
        span = s["hi"] - s["lo"]
        return F.transform(
            y,
            lambda v: F.when(s["nan"], F.lit(float("nan"))).when(span == 0, F.lit(1.0)).otherwise(F.lit(2.0) * (v - s["lo"]) / F.when(span != 0, span)),
        )

    return F.when(F.size(y) == 0, y).otherwise(let(ends, scaled))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def parse_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def split_text(text: Column, delimiter: str) -> Column:
    """Parts of a text; empty ones inside stay, one at the end goes, so an empty text has none."""
    parts = F.split(text, re.escape(delimiter), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
