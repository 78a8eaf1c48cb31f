"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each group of input partitions sends to each shard is drawn first,
exactly, from counts alone: group by group, shard by shard, hypergeometric draws
from what is left, so that shard sizes differ by one at most. Each group then
orders its rows by a hash and deals them out by those counts, which makes the
counts of its single partitions hypergeometric as well; each shard orders what it
gets by a second hash. Both orders go range by range of the hash, so that neither
a large partition nor a shard is one task's work.

There are ``GROUPS`` groups at most, whatever the input: the draws, their matrix
and what the driver reads have a fixed bound.

Defined results: a null text has no bytes and the checksum of no bytes; rows
that repeat are rows of their own, and rows of equal hashes are ordered as they come;
a text's length, however large, changes its size and checksum but not its place;
with fewer rows than shards the last shards stay empty; an empty table gives an empty result; columns of any name pass
through, since a row travels as one struct.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import literal_table
from tamarack.session import stored

SHARDS, SEED = 40, 20_240_229
#: Input partitions are dealt in so many groups at most, by their number modulo it.
GROUPS = 256
#: Rows that one range of a permutation has at most, on average.
RANGE_ROWS = 50_000


def hypergeometric(random_state: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from ``good`` + ``bad``: inversion outward from the mode, for counts of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    at = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def chosen(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(chosen(good, at) + chosen(bad, draws - at) - chosen(good + bad, draws))
    left = random_state.random() - p
    below = above = at
    p_below = p_above = p
    while left > 0 and (below > low or above < high):
        if above < high:
            p_above *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            left -= p_above
            if left <= 0:
                return above
        if below > low:
            p_below *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            left -= p_below
            if left <= 0:
                return below
    return at


def communication_matrix(counts: Sequence[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Rows that each group sends to each shard; row sums are ``counts``, column sums differ by one at most."""
    random_state, total = random.Random(seed), sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for count in counts:
        rest, row = sum(left), []
        for s in range(shards):
            rest -= left[s]
            n = hypergeometric(random_state, left[s], rest, count - sum(row))
            row.append(n)
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _permuted(rows: DataFrame, key: str, seed: int, most: int, name: str) -> DataFrame:
    """Adds ``name``: the place of each row, from 0, in a random order of the rows of its ``key``, ``most`` at most.

    ``rows`` are read twice, so they come from a stored table.
    """
    bits = (most // RANGE_ROWS).bit_length()
    order = F.xxhash64("_id", F.lit(seed))
    ranged = rows.withColumns({"_order": order, "_range": F.shiftrightunsigned(order, 63 - bits)})
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(key, "_range").count().select(key, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    # unsigned order within a range is signed order, since a range has one sign
    within = Window.partitionBy(key, "_range").orderBy("_order", "_id")
    placed = ranged.withColumn("_at", F.row_number().over(within) - 1).join(starts, [key, "_range"])
    return placed.withColumn(name, F.col("_start") + F.col("_at")).drop("_order", "_range", "_start", "_at")


def dealt(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``_shard`` to stored rows that have ``_part``, the number of their input partition, and a distinct ``_id``."""
    grouped = rows.withColumn("_group", F.pmod("_part", F.lit(GROUPS)))
    sizes = sorted(tuple(r) for r in grouped.groupBy("_group").count().collect())  # GROUPS rows at most
    counts = [n for _, n in sizes]
    matrix = communication_matrix(counts, shards, seed)
    ends = [{"_of": group, "_ends": list(accumulate(row))} for (group, _), row in zip(sizes, matrix, strict=True)]
    dealing = literal_table(rows.sparkSession, ends, "_of: int, _ends: array<bigint>")
    ranked = _permuted(grouped, "_group", seed, max(counts, default=0), "_rank").join(dealing, F.col("_group") == F.col("_of"))
    return ranked.withColumn("_shard", F.size(F.filter("_ends", lambda end: end <= F.col("_rank")))).drop("_group", "_rank", "_of", "_ends")


def sharded(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, carry: Sequence[str] | None = None, weigh_column: str = "text"
) -> DataFrame:
    """Per row ``_row``, ``_size`` (UTF-8 bytes plus 16), ``_crc32``, ``_shard`` and ``_slot`` (gapless from 0).

    ``carry`` names the columns that ``_row`` has; they are what is exchanged.
    """
    text = F.coalesce(F.col(weigh_column), F.lit(""))
    rows = stored(
        docs.select(
            F.struct(*(carry or docs.columns)).alias("_row"),
            (F.octet_length(text) + 16).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc32"),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_id"),
        ),
        "shard-rows",
    )
    sent = stored(dealt(rows, shards, seed).drop("_part"), "shard-dealt")
    most = -(-sent.count() // shards)  # the files' footers tell it
    return _permuted(sent, "_shard", seed + 1, most, "_slot").select("_row", "_size", "_crc32", "_shard", "_slot")
