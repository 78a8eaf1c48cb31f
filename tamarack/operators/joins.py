"""Joins of many rows with one row per key, in which a hot key can be divided."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def divisible_join(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Put group statistics, one row per key, beside the rows of the group.

    Adaptive execution broadcasts the statistics if their measured size allows,
    and otherwise divides hot keys, but only where both sides are shuffled for
    the join itself. An aggregate by the key is not: it keeps its own shuffle. A
    hash of the keys as one more join key changes no row and forces that form.
    """
    mark = F.xxhash64(*keys)
    left, right = rows.withColumn("_mark_of_keys", mark), stats.withColumn("_mark_of_keys", mark)
    return left.join(right, [*keys, "_mark_of_keys"], how).drop("_mark_of_keys")
