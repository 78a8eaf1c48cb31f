"""Sorts, ranks, top-k and pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack import fixed_values as fv
from tamarack.operators.filters import equals_all, text_search
from tamarack.session import stored


def _place(direction: str, nulls: str | None) -> str:
    return nulls or ("first" if direction == "desc" else "last")


def sort_key(column: str | Column, direction: str = "asc", nulls: str | None = None) -> Column:
    """Sort key whose NULL counts as the largest value, unless ``nulls`` says first or last."""
    column = F.col(column) if isinstance(column, str) else column
    return getattr(column, f"{direction}_nulls_{_place(direction, nulls)}")()


#: (column or expression, direction, place of NULL); the last two may be left out
Key = tuple


def ranges_for(df: DataFrame) -> int:
    """Ranges into which rows are cut for a global order: as many as the session has shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def order(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """Sort by (column, direction[, nulls]) keys.

    End the list with a unique column: it settles ties, and lets the range
    partitioner divide a run of equal leading values among tasks.
    """
    return df.orderBy(*[sort_key(*k) for k in keys])


def user_sort(df: DataFrame, column: str, direction: str) -> Key:
    """Sort key of a table header: NULL counts as empty text, text sorts by Unicode collation."""
    key = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        key = F.collate(F.coalesce(key, F.lit("")), "UNICODE")
    return key, direction, "first" if direction == "asc" else "last"


def custom_order(column: Column, values: Sequence[str]) -> Column:
    """Position of the value in the given list, to sort by; NULL if not listed."""
    chain = F.when(column == values[0], F.lit(1))
    for position, value in enumerate(values[1:], start=2):
        chain = chain.when(column == value, F.lit(position))
    return chain


def top_k(df: DataFrame, keys: Sequence[Key], k: int) -> DataFrame:
    """First k rows in the order; each task keeps k rows only."""
    return order(df, keys).limit(k)


def rank_in_group(keys: Sequence[str], column: str, direction: str = "asc") -> Column:
    return F.rank().over(Window.partitionBy(*keys).orderBy(sort_key(column, direction)))


def _range_of(cuts: Column, most: int, passed: Callable[[Column], Column]) -> Column:
    """How many of at most ``most`` cuts, which stand in order, the row has passed: found by halving, not by a look at each."""
    halves = [1 << i for i in reversed(range(most.bit_length()))]

    def step(low: Column, half: Column) -> Column:
        at = low + half
        return F.when((at <= F.size(cuts)) & passed(F.get(cuts, at - 1)), at).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)


def rank_global(df: DataFrame, column: str, name: str, buckets: int | None = None) -> DataFrame:
    """Rank of every row by a numeric column, largest first, without a one-task sort.

    Equal values are counted first. The distinct values are cut into ranges at
    approximate quantiles (only the balance depends on them, the result does
    not); a value's rank is one more than the rows in higher ranges and the rows
    of higher values in its own range.
    """
    buckets = buckets or ranges_for(df)
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    fractions = F.array(*[F.lit((i + 1) / (buckets + 1)) for i in range(buckets)])
    cuts = counts.agg(F.percentile_approx(F.col(column).cast("double"), fractions, F.lit(10 * buckets))).scalar()
    value = F.col(column).cast("double")
    placed = (
        counts.withColumn("_cuts", cuts)
        .withColumn(
            "_range",
            F.when(value.isNull(), F.lit(buckets + 1)).otherwise(_range_of(F.col("_cuts"), buckets, lambda c: c < value)),
        )
        .drop("_cuts")
    )
    within = Window.partitionBy("_range").orderBy(sort_key(column, "desc"))
    # at most buckets + 2 rows meet in this window, and are broadcast after it
    above = Window.orderBy(F.col("_range").desc())
    ranges = (
        placed.groupBy("_range")
        .agg(F.sum("_n").alias("_rows"))
        .select(
            "_range",
            F.coalesce(F.sum("_rows").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"),
        )
    )
    ahead = F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = (
        placed.withColumn("_ahead", ahead)
        .join(F.broadcast(ranges), "_range")
        .select(F.col(column).alias("_value"), (F.col("_ahead") + F.col("_above") + 1).alias(name))
    )
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def _comes_before(a: Column, b: Column, keys: Sequence[Key]) -> Column:
    """Whether ``a`` stands before ``b`` in the order; both are structs of key values."""
    before, tied = F.lit(False), F.lit(True)
    for i, (_, *rest) in enumerate(keys):
        direction = rest[0] if rest else "asc"
        x, y = a[f"k{i}"], b[f"k{i}"]
        first = (x.isNull() & y.isNotNull()) if _place(direction, *(rest[1:] or [None])) == "first" else (x.isNotNull() & y.isNull())
        less = first | F.coalesce(x < y if direction == "asc" else x > y, F.lit(False))
        before, tied = before | (tied & less), tied & x.eqNullSafe(y)
    return before


def page(df: DataFrame, keys: Sequence[Key], number: int, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of the sorted rows; beyond the end, the last page.

    The sort keys must identify a row. The first page is a top-k. For any other
    a few rows, picked by a hash of their keys, cut the order into ranges; each
    row finds its range by halving, rows are counted per range, and only the ranges that hold the page are sorted.
    Where the cuts lie decides the balance alone, not the result.
    """
    if number == 0:
        return order(df, keys).limit(size)
    values = F.struct(*[(F.col(k[0]) if isinstance(k[0], str) else k[0]).alias(f"k{i}") for i, k in enumerate(keys)])
    picked = df.select(values.alias("_cut")).orderBy(F.xxhash64(F.to_json("_cut")), F.to_json("_cut")).limit(ranges_for(df) - 1)

    def compared(a: Column, b: Column) -> Column:
        return F.when(_comes_before(a, b, keys), F.lit(-1)).when(_comes_before(b, a, keys), F.lit(1)).otherwise(F.lit(0))

    cuts = picked.agg(F.array_sort(F.collect_list("_cut"), compared)).scalar()
    here = df.withColumns({"_cuts": cuts, "_here": values})
    passed = _range_of(F.col("_cuts"), ranges_for(df), lambda cut: _comes_before(cut, F.col("_here"), keys))
    ranged = here.withColumn("_range", passed).drop("_cuts", "_here")
    # as many rows as ranges meet in these windows
    upto, everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    first = F.least(F.lit(number), F.greatest(F.ceil(F.sum("_n").over(everything) / size) - 1, F.lit(0))) * size
    wanted = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .withColumns({"_start": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_first": first})
        .filter((F.col("_start") < F.col("_first") + size) & (F.col("_start") + F.col("_n") > F.col("_first")))
        .select("_range", "_start", "_first")
    )
    within = Window.partitionBy("_range").orderBy(*[sort_key(*k) for k in keys])
    numbered = ranged.join(wanted, "_range").withColumn("_at", F.col("_start") + F.row_number().over(within) - 1)
    shown = numbered.filter((F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_first") + size))
    return order(shown, keys).select(*df.columns)


def table_view(
    df: DataFrame,
    unique: str,
    search: str = "",
    search_columns: Sequence[str] = (),
    filters: Mapping[str, object] | None = None,
    sort: tuple[str, str] | None = None,
    number: int = 0,
    size: int | None = fv.PAGE_SIZE,
) -> DataFrame:
    """Search, filter, sort and page a result table, with the number of rows found.

    ``unique`` names a column that identifies a row and settles ties. The rows
    found are stored: their number, the cuts, the ranges and the page are read
    from them, so that ``df`` is computed once.
    """
    found = stored(equals_all(text_search(df, search_columns, search), filters or {}), "table-view")
    keys = [*([user_sort(df, *sort)] if sort else []), (unique, "asc")]
    shown = order(found, keys) if size is None else page(found, keys, number, size)
    return shown.withColumn("rows_found", found.agg(F.count("*")).scalar())
