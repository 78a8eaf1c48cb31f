"""What several operators share: reading, fixed-size membership bits, literal tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Membership bits are kept in at most this many 64-bit words (2^20 words of 64 bits, 16 MB as rows).
WORD_BITS = 20

#: The characters of ``[\x20\x09-\x0D]``.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def literal_table(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small table given in the program, as one JSON literal that the JVM parses."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def without_spaces(text: Column) -> Column:
    """The text after deleting every character of ``[\\x20\\x09-\\x0D]``."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _place(hashed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(hashed, 64 - WORD_BITS), hashed.bitwiseAND(F.lit(63)).cast("int")


def membership(keys: DataFrame, hashed: Column) -> DataFrame:
    """Bits set at the 64-bit hashes of ``keys``: at most 2^20 rows (word, bits), whatever the input."""
    word, bit = _place(hashed)
    return (
        keys.select(word.alias("_word"), bit.alias("_bit"))
        .select("_word", F.expr("shiftleft(1L, _bit)").alias("_bits"))
        .groupBy("_word")
        .agg(F.bit_or("_bits").alias("_bits"))
    )


def maybe_in(rows: DataFrame, hashed: Column, words: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false only if the hash is surely absent. The words are broadcast; 2^20 rows bound them."""
    word, bit = _place(hashed)
    probed = rows.withColumns({"_probe": word, "_at": bit}).join(F.broadcast(words), F.col("_probe") == F.col("_word"), "left")
    hit = F.coalesce(F.expr("bit_get(_bits, _at)") == 1, F.lit(False))
    return probed.withColumn(name, hit).drop("_probe", "_at", "_word", "_bits")


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
