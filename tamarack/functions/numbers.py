"""Arithmetic with the rounding and NULL rules of exact SQL numerics.

Money stays decimal while it is summed, so no result depends on the order in
which partitions arrive. Ratios are formed in double from those exact sums and
rounded half away from zero through a decimal of ten places, which absorbs the
last-digit noise of the division.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDING_TYPE = "decimal(28,10)"


def round_exact(x: Column, digits: int) -> Column:
    return F.round(x.cast(ROUNDING_TYPE), digits).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """a / b in double, NULL where b is zero or NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def mean(x: Column) -> Column:
    """Average as exact sum over count of non-NULL values; NULL for an empty group."""
    return safe_div(F.sum(x), F.count(x))


def mean_if(condition: Column, x: Column) -> Column:
    """Average over the rows where the condition is true, NULL if there are none."""
    return mean(F.when(condition, x))


def sum_if(condition: Column, x: Column) -> Column:
    """Sum over the rows where the condition is true, 0 if there are none."""
    return F.sum(F.when(condition, x).otherwise(F.lit(0).cast("decimal(12,2)")))


def ratio_pct(part: Column, whole: Column) -> Column:
    return safe_div(part * F.lit(100), whole)


def pct_true(flag: Column) -> Column:
    """Share of true among the known flags, in percent."""
    return ratio_pct(F.sum(flag.cast("int")), F.count(flag))


def sd_or_null(x: Column) -> Column:
    """Sample standard deviation; NULL instead of zero, so that it can be divided by."""
    return F.nullif(F.stddev_samp(x.cast("double")), F.lit(0.0))


def zscore(x: Column, centre: Column, sd: Column) -> Column:
    return (x.cast("double") - centre) / sd


def clip(x: Column, lo: float, hi: float) -> Column:
    """x limited to [lo, hi]; NULL becomes lo, because greatest() skips NULL."""
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def weighted_clip_score(zs: Mapping[str, Column], weights: Mapping[str, float], hi: float) -> Column:
    """Sum over the metrics of clip(z, 0, hi) / hi * weight."""
    return reduce(
        lambda total, part: total + part,
        [clip(zs[name], 0, hi) / F.lit(float(hi)) * F.lit(float(w)) for name, w in weights.items()],
    )


def capped(x: Column, cap: float, points: float, rate: float) -> Column:
    """A fixed number of points above the cap, points in proportion up to it."""
    return F.when(x > F.lit(cap), F.lit(float(points))).otherwise(x.cast("double") * F.lit(float(rate)))


def per_year(x: Column, days: Column) -> Column:
    return safe_div(x, days) * F.lit(365.0)


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent of the previous value, NULL where that is NULL or zero."""
    return safe_div(current - previous, previous) * F.lit(100.0)


def euclid(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda t, p: t + p, [F.pow(a - b, F.lit(2.0)) for a, b in zip(left, right, strict=True)]))


def positive_count(*xs: Column) -> Column:
    """How many of the values are above zero."""
    return reduce(lambda t, p: t + p, [F.when(x > 0, F.lit(1)).otherwise(F.lit(0)) for x in xs])
