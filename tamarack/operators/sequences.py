"""Order inside a group: previous value, first row, numbering in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import hour_start

def previous(column: str, keys: Sequence[str], order: str) -> Column:
    """Value of the preceding row of the same group."""
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(order))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The order columns of each group's first row.

    The least struct is an aggregate with a partial step before the shuffle, so
    a group of any size costs one row per task; a window would sort it whole.
    """
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select(*keys, *[F.col("_first")[c].alias(c) for c in order])
    )


def sequence(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Number the rows of each key by time (``rn``) and count them (``group_rows``), whatever the skew.

    Rows are numbered within (key, hour); the counts of the earlier hours, at
    most one row per hour of the calendar for each key, shift the numbers. NULL
    is a key like any other: inside a struct it equals itself.
    """
    hourly = df.withColumns({"_key": F.struct(key), "_hour": hour_start(F.col(ts))})
    calendar = Window.partitionBy("_key").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        hourly.groupBy("_key", "_hour")
        .agg(F.count("*").alias("_n"))
        .select(
            "_key",
            F.struct("_hour").alias("_at"),
            F.coalesce(F.sum("_n").over(calendar), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy("_key")).alias("group_rows"),
        )
    )
    in_hour = Window.partitionBy("_key", "_at").orderBy(ts, tie)
    return (
        hourly.withColumn("_at", F.struct("_hour"))
        .withColumn("_in_hour", F.row_number().over(in_hour))
        .join(shifts, ["_key", "_at"])
        .withColumn("rn", F.col("_before") + F.col("_in_hour"))
        .select(*df.columns, "rn", "group_rows")
    )


def half_split(rn: Column, n: Column) -> Column:
    """``early`` for the first half of a sequence, ``late`` for the rest (the larger half if odd)."""
    return F.when(rn <= n.cast("double") / F.lit(2.0), F.lit("early")).otherwise(F.lit("late"))
