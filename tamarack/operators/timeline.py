"""Running totals of events read off at given instants."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.joins import divisible_join


def totals_after(events: DataFrame, marks: DataFrame, key: str, ts: str, measures: Mapping[str, str]) -> DataFrame:
    """For every mark (key, ts, …): the sums over the key's events strictly later than it.

    ``measures`` maps an event column to the name of its sum. Events and marks
    are laid on one time line per (key, minute): no event is ever paired with a
    mark, so a key with many of both stays linear, and a hot key is spread over
    the minutes of its days. The totals of later minutes, at most one row per
    minute of the calendar for each key, are added to the rest of the mark's own.
    """
    carried = [c for c in marks.columns if c not in (key, ts)]
    mark_types = {f.name: f.dataType for f in marks.schema.fields}
    event_types = {f.name: f.dataType for f in events.schema.fields}
    line = events.select(
        key,
        ts,
        F.lit(False).alias("_mark"),
        *measures,
        *[F.lit(None).cast(mark_types[c]).alias(c) for c in carried],
    ).unionByName(
        marks.select(
            key,
            ts,
            F.lit(True).alias("_mark"),
            *[F.lit(None).cast(event_types[m]).alias(m) for m in measures],
            *carried,
        )
    ).withColumn("_minute", F.date_trunc("minute", ts))

    # later rows first, so "everything before the current row" is "later in this minute";
    # at the same instant the mark comes first and does not see the event
    rest = (
        Window.partitionBy(key, "_minute")
        .orderBy(F.col(ts).desc(), F.col("_mark").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    later = Window.partitionBy(key).orderBy(F.col("_minute").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = line.withColumns({f"_rest_{m}": F.sum(m).over(rest) for m in measures}).filter("_mark")
    minutes = (
        line.groupBy(key, "_minute")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(key, "_minute", *[F.sum(m).over(later).alias(f"_later_{m}") for m in measures])
    )

    def after(m: str):
        return F.coalesce(F.col(f"_rest_{m}"), F.lit(0)) + F.coalesce(F.col(f"_later_{m}"), F.lit(0))

    return divisible_join(marked, minutes, [key, "_minute"]).select(
        key, ts, *carried, *[after(m).alias(name) for m, name in measures.items()]
    )
