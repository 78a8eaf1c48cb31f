"""Columns to rows, rows to columns, and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric, in one scan; values become double to share a type."""
    typed = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(list(ids), list(metrics), "metric", "value")


def pivot_years(value: Column, year: Column, years: Sequence[int]) -> list[Column]:
    """Aggregates ``y_<year>``, to be used in one groupBy with others."""
    return [F.max(F.when(year == y, value)).alias(f"y_{y}") for y in years]


def union_all_nulls(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column that only one side has is NULL on the other."""
    return a.unionByName(b, allowMissingColumns=True)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
