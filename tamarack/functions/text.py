"""Text functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack import fixed_values as fv


def title_case(text: Column) -> Column:
    """Underscores to spaces, first letter of each word upper case, the rest untouched.

    Words consist of ASCII letters and digits; any other letter ends a word.
    """
    spaced = F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" "))
    pieces = F.regexp_extract_all(spaced, F.lit(r"(\w+|\W+)"), F.lit(1))

    def capitalised(piece: Column) -> Column:
        first = F.translate(F.substring(piece, 1, 1), ascii_lowercase, ascii_uppercase)
        return F.concat(first, F.substr(piece, F.lit(2)))

    return F.array_join(F.transform(pieces, capitalised), "")


def strip_pictographs(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), fv.PICTOGRAPHS, ""))


def contains_text(columns: Sequence[Column], needle: str) -> Column:
    """True where any of the columns, read as text, holds the needle in any case."""
    wanted = F.lower(F.lit(needle))
    return reduce(
        lambda a, b: a | b,
        [F.lower(F.coalesce(c.cast("string"), F.lit(""))).contains(wanted) for c in columns],
    )
