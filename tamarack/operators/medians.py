"""Exact median of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_E = 256
#: Equal parts into which the middle cell is divided, and how often.
PARTS, REFINEMENTS = 1_024, 2


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Continuous median of ``value`` per group, in double; NULL keys are a group.

    Equal values are counted before the shuffle. A logarithmic grid, at most a
    few thousand cells per key for any decimal(12,2), tells which cell holds the
    middle row; its values are then
    divided evenly, twice over, and only those of the part that holds the middle row are put in order.
    """
    magnitude = F.log1p(F.abs(F.col(value)).cast("double")) * F.lit(float(STEPS_PER_E))
    counts = (
        df.filter(F.col(value).isNotNull())
        # inside a struct NULL equals itself, and the join below asks for no key that is not NULL:
        # both its sides then have one plan up to the shuffle of the counts
        .groupBy(F.struct(*keys).alias("_group"), value)
        .agg(F.count("*").alias("_n"))
        .withColumn("_cell", F.struct(F.floor(F.signum(F.col(value).cast("double")) * magnitude)))
    )
    upto = Window.partitionBy("_group").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        counts.groupBy("_group", "_cell")
        .agg(F.sum("_n").alias("_rows"), F.min(value).alias("_least"), F.max(value).alias("_most"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_rows").over(upto), F.lit(0)),
                "_total": F.sum("_rows").over(Window.partitionBy("_group")),
            }
        )
        # positions, from 0, of the two middle rows; the same row if the count is odd
        .withColumns({"_lo": F.expr("(_total - 1) div 2"), "_hi": F.expr("_total div 2")})
        .filter(_HOLDS_MIDDLE)
        .drop("_rows", "_total")
    )
    placed = counts.join(cells, ["_group", "_cell"])
    for _ in range(REFINEMENTS):
        placed = _refined(placed, value)
    in_cell = Window.partitionBy("_group", "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(in_cell), F.lit(0)))

    def at(position: str):
        covers = (F.col("_start") <= F.col(position)) & (F.col("_start") + F.col("_n") > F.col(position))
        return F.max(F.when(covers, F.col(value).cast("double")))

    medians = placed.groupBy("_group").agg(((at("_lo") + at("_hi")) / F.lit(2.0)).alias(name))
    return medians.select("_group.*", name)


_HOLDS_MIDDLE = "_before <= _hi AND _before + _rows > _lo"


def _refined(placed: DataFrame, value: str) -> DataFrame:
    """The values of the middle cells, cut down to those parts of each cell that hold a middle row.

    A cell is divided evenly between its least and largest value; rows are counted per part, so no task puts more
    than the parts of a cell in order.
    """
    low, high, x = (F.col(c).cast("double") for c in ("_least", "_most", value))
    part = F.least(F.floor((x - low) / F.greatest(high - low, F.lit(1e-300)) * PARTS), F.lit(PARTS - 1))
    divided = placed.withColumn("_part", part)
    cell = ["_group", "_cell"]
    upto = Window.partitionBy(*cell).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        divided.groupBy(*cell, "_part", F.col("_before").alias("_ahead"), "_lo", "_hi")
        .agg(F.sum("_n").alias("_rows"), F.min(value).alias("_least"), F.max(value).alias("_most"))
        .withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
        .filter(_HOLDS_MIDDLE)
        .select(*cell, "_part", "_before", "_lo", "_hi", "_least", "_most")
    )
    kept = divided.select(*cell, "_part", value, "_n").join(parts, [*cell, "_part"])
    return kept.withColumn("_cell", F.struct("_cell", "_part")).drop("_part")
