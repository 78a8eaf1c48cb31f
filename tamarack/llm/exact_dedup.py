"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

The first scan yields three narrow columns. Lengths and prefixes that occur once
settle their rows; what is left of the ids becomes a fixed number of membership
bits, and only rows that pass them have their whole text hashed, in a second
scan. A bit set by chance costs one hash and changes nothing. Rows whose text
stands alone are never shuffled.

Defined results: a null text counts as empty; of equal texts the row with the
most code points stays, then the smallest id (null last), then any one of
rows that agree in both; repeated rows are rows of their own, of which one
stays; texts of any length are hashed whole, the prefix only spares work; an empty
table gives an empty result; columns of any name pass through, since a row
travels as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import maybe_in, membership, without_spaces
from tamarack.session import stored

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64


def _refined(docs: DataFrame, carry: Sequence[str] | None, id_column: str, text_column: str):
    """Rows alone with their text, and the stored rows of the groups left with their full hash."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("_row"), F.col(id_column).alias("_id"), text.alias("_text"))
    bare = without_spaces(F.col("_text"))

    keyed = stored(
        rows.select("_id", F.octet_length(bare).alias("_length"), F.xxhash64(F.substring(bare, 1, PREFIX)).alias("_prefix")),
        "dedup-keys",
    )
    prefixes = keyed.groupBy("_length", "_prefix").agg(F.count("*").alias("_n"))
    lengths = prefixes.groupBy("_length").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_length")
    shared = prefixes.join(lengths, "_length", "left_semi").filter("_n > 1")
    key = F.xxhash64("_length", "_prefix")
    open_rows = maybe_in(keyed, key, membership(shared, key), "_open").filter("_open")
    # stored, since the rows are probed twice: for the groups and for those alone
    bits = stored(membership(open_rows, F.xxhash64("_id")), "dedup-bits")
    probed = maybe_in(rows, F.xxhash64("_id"), bits, "_open")

    alone = probed.filter("NOT _open").select("_row", "_id")
    grouped = stored(
        probed.filter("_open").select(
            "_row",
            "_id",
            F.length("_text").alias("_points"),
            F.sha2(bare, 256).alias("_full"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "dedup-rows",
    )
    best = F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id"), F.col("_at")))
    groups = grouped.groupBy("_full").agg(F.count("*").alias("_size"), best.alias("_best"))
    return alone, grouped, groups


def exact_groups(
    docs: DataFrame, carry: Sequence[str] | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every row, as struct ``_row`` of the ``carry`` columns, with ``_keep_id``, ``_size`` and ``_kept``."""
    alone, grouped, groups = _refined(docs, carry, id_column, text_column)
    # stored, so that both sides of the join are plain shuffles and a group with a third of all rows is split
    groups = stored(groups, "dedup-groups")
    found = grouped.join(groups, "_full").select(
        "_row",
        F.col("_best._id").alias("_keep_id"),
        "_size",
        (F.col("_at") == F.col("_best._at")).alias("_kept"),
    )
    single = alone.select("_row", F.col("_id").alias("_keep_id"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    return single.unionByName(found)


def exact_unique(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    alone, grouped, groups = _refined(docs, None, id_column, text_column)
    kept = grouped.join(groups.select(F.col("_best._at").alias("_at")), "_at", "left_semi")
    return alone.select("_row").unionByName(kept.select("_row")).select("_row.*")
