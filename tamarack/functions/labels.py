"""Values to labels: bands, verdicts, tiers. A NULL test counts as not met."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack import fixed_values as fv


def banded(rules: Iterable[tuple[Column, str]], default: str) -> Column:
    """Text of the first rule whose condition holds."""
    chain = None
    for condition, text in rules:
        chain = F.when(condition, F.lit(text)) if chain is None else chain.when(condition, F.lit(text))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def time_window(hour: Column) -> Column:
    return banded([(hour.between(lo, hi), name) for lo, hi, name in fv.TIME_WINDOWS], fv.TIME_WINDOW_REST)


def label_flag(test: Column, yes: str, no: str) -> Column:
    return banded([(test, yes)], no)


def interpret(
    metric: Column,
    change: Column,
    readings: Mapping[str, tuple[str, str]] = fv.READINGS,
) -> Column:
    """Plain-language reading of a metric's direction."""
    rising = F.create_map(*[F.lit(x) for name, (up, _) in readings.items() for x in (name, up)])
    falling = F.create_map(*[F.lit(x) for name, (_, down) in readings.items() for x in (name, down)])
    return (
        F.when(change.isNull(), F.lit(fv.READING_UNKNOWN))
        .when(change > 0, F.coalesce(F.try_element_at(rising, metric), F.lit(fv.READING_FLAT)))
        .when(change < 0, F.coalesce(F.try_element_at(falling, metric), F.lit(fv.READING_FLAT)))
        .otherwise(F.lit(fv.READING_FLAT))
    )


def verdict_tier(verdict: Column) -> Column:
    """Tier of a verdict text, from its mark or else from its first word."""
    upper = F.upper(verdict)

    def any_of(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, tests)

    rules = [(any_of([verdict.contains(m) for m in marks]), tier) for marks, tier in fv.TIER_MARKS]
    rules += [(any_of([upper.startswith(w) for w in words]), tier) for words, tier in fv.TIER_WORDS]
    return banded(rules, fv.NEUTRAL_TIER)
