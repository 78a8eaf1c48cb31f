"""Row filters. A NULL test drops the row, as in SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import contains_text


def where_flag(df: DataFrame, flag: str, value: bool = True) -> DataFrame:
    return df.filter(F.col(flag) if value else ~F.col(flag))


def in_bands(x: Column, bands: Sequence[tuple[float, float]]) -> Column:
    """True where x lies in any of the ranges, both ends included."""
    return reduce(lambda a, b: a | b, [x.between(lo, hi) for lo, hi in bands])


def having_count(grouped: DataFrame, floor: int, count_column: str) -> DataFrame:
    """Groups with at least ``floor`` rows."""
    return grouped.filter(F.col(count_column) >= floor)


def dimension_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one dimension value; ``'all'`` keeps every row."""
    return df if value == fv.NO_FILTER else df.filter(F.col(column) == value)


def text_search(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    """Rows where any column contains the text, in any case; empty text keeps all."""
    return df.filter(contains_text([F.col(c) for c in columns], needle)) if needle else df


def equals_all(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows equal to every given value, compared as text; empty or ``'__all__'`` is no condition."""
    for column, value in wanted.items():
        if value not in (None, "", fv.NO_COLUMN_FILTER):
            df = df.filter(F.col(column).cast("string") == str(value))
    return df


def share_of(key: str, shares: int) -> Column:
    """Number, from 0, of the share that a row belongs to: by a hash of the key, so that equal keys, NULL too, stay together."""
    return F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")
