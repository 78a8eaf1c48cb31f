"""Grand totals beside rows, without a cross join and without a one-task window.

A global aggregate has exactly one row. Spark runs it as a scalar subquery and
places the value into the projection, so the detail rows are neither shuffled
nor gathered, however many there are.

The subquery reads the same rows as the query around it. Left alone, Spark would
prune the columns it does not sum, get a different plan and compute everything
twice, down to the scan. Touching every column in the subquery keeps the two
plans equal up to their last shuffle, which is then run once and reused.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions import ratio_pct, round_exact


def with_totals(df: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Every row of ``df`` with the named aggregates over all its rows."""
    touch_all = F.max(F.xxhash64(*df.columns)).alias("_touch_all")
    row = df.agg(*[agg.alias(name) for name, agg in totals.items()], touch_all)
    packed = row.select(F.struct(*row.columns).alias("totals")).scalar()
    return df.withColumn("_totals", packed).select("*", "_totals.*").drop("_totals", "_touch_all")


def share_of_total(df: DataFrame, column: str, name: str, digits: int = 2) -> DataFrame:
    """Percent of the column's sum over all rows."""
    beside = with_totals(df, {"_whole": F.sum(column)})
    return beside.withColumn(name, round_exact(ratio_pct(F.col(column), F.col("_whole")), digits)).drop("_whole")
