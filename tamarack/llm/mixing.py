"""Mix sources to target weights: words per source, repetition rates, and hashed draws for the fraction.

Each document is taken floor(rate) times, and once more if a hash of its id,
its size and a seed falls below the fraction. ``SEEDS`` seeds are tried per
source in one pass, and the one whose words come nearest to the target is used:
sources of few documents of unlike size would else stray far.

Defined results: a null text has size 0; the null source is a source, the last
one; a source without words has target 0 and rate 0; rows that repeat an id are
drawn alike; of seeds that come equally near the smallest is used; a text of any
length is read whole and counts with all its words; an empty table gives an empty
result. Columns of any name pass through, since a row travels as one struct.

Since the best of several seeds is used, a copy's probability is not quite the
fraction: documents whose draws bring the source nearer to its target gain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import stored

#: Weights of the sources by code point, repeating; share of all words that the mix has; most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Hash seeds tried for each source.
SEEDS = 32


def words(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``place`` (from 0, by code point, null last), sorted in ranges, not in one task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id())
    ranges = stored(ordered, "mix-sources").withColumn("_range", F.shiftright("_id", 33))
    # a row for each range of the sort, as many as shuffle partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranges.join(starts, "_range").select("source", "source_size", place.alias("place"))


def source_rates(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """A row per source: ``source_size``, ``target`` and the repetition ``rate``.

    Targets share ``share`` of all words by weight and stop at ``most`` times the
    source's size; the excess goes to the others by weight until none is above.
    A round is one aggregate over the sources; the level per weight only rises.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    sources = stored(numbered_sources(sizes).withColumns({"_weight": weight, "_cap": cap}), "mix-weights")
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None
    while True:
        above = F.col("_cap") <= F.col("_weight") * level
        took, free, n = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0)), F.count_if(above)
        ).first()
        if n == full or not free:
            break
        full, level = n, (goal - took) / free
    target = F.least(F.col("_cap"), F.col("_weight") * level) if free else F.col("_cap")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return sources.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def _draw(seed: Column) -> Column:
    """Uniform in [0, 1) from the id, the size and the seed."""
    return F.shiftrightunsigned(F.xxhash64("_id", "size", seed), 11) * F.lit(2.0**-53)


@dataclass
class Mix:
    """``rates`` per source with the chosen ``seed``; ``rows`` have ``_row``, size, source_size, target and copies."""

    rates: DataFrame
    rows: DataFrame


def mix(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seeds: int = SEEDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> Mix:
    """How often each document is taken; ``carry`` names the columns that ``_row`` has (all if not given)."""
    size = words(F.col(text_column)).alias("size")
    sizes = stored(docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("source"), size), "mix-sizes")
    rates = stored(source_rates(sizes, weights, share, most), "mix-rates")

    whole, fraction = F.floor("rate"), F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(_draw(F.lit(s)) < fraction, F.col("size")).otherwise(0)).alias(f"_extra{s}") for s in range(seeds)]
    drawn = _attach(sizes, rates).groupBy("source").agg(*extra)
    miss = [F.struct(F.abs(whole * F.col("source_size") + F.col(f"_extra{s}") - F.col("target")), F.lit(s).alias("seed")) for s in range(seeds)]
    best = F.array_min(F.array(*miss))["seed"].alias("seed")
    chosen = stored(
        drawn.withColumnRenamed("source", "_source").join(rates, F.col("_source").eqNullSafe(F.col("source"))).select(*rates.columns, best), "mix-seeds"
    )

    if carry is not None and set(carry) <= {id_column}:  # the sizes hold all that is asked for
        rows = sizes.select(F.struct(F.col("_id").alias(id_column)).alias("_row"), "_id", "source", "size")
    else:
        rows = docs.select(F.struct(*(carry or docs.columns)).alias("_row"), F.col(id_column).alias("_id"), F.col(source_column).alias("source"), size)
    copies = (whole + (_draw(F.col("seed")) < fraction).cast("long")).cast("int")
    return Mix(chosen, _attach(rows, chosen).select("_row", "size", "source_size", "target", copies.alias("copies")))


def _attach(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rates are read from a stored table: few are broadcast by their size, many make a join whose hot source can be split."""
    return rows.withColumnRenamed("source", "_source").join(rates, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **options).rows.filter("copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_row.*")
