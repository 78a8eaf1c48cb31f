"""Constraint audit: what a database would have refused."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PrimaryKey:
    """Rows beyond the first with the same key, and rows without one."""

    name: str
    table: DataFrame
    column: str

    def key(self) -> Column:
        return F.col(self.column).cast("string")

    @staticmethod
    def violations() -> Column:
        return F.when(F.col("key").isNull(), F.col("rows")).otherwise(F.col("rows") - 1)


@dataclass(frozen=True)
class ForeignKey:
    """Rows whose non-NULL value is not among the parent's keys."""

    name: str
    table: DataFrame
    column: str
    parent: DataFrame
    parent_column: str

    def key(self) -> Column:
        return F.col(self.column).cast("string")

    @staticmethod
    def violations() -> Column:
        return F.when(F.col("key").isNotNull() & ~F.col("known"), F.col("rows")).otherwise(F.lit(0))


@dataclass(frozen=True)
class Check:
    """Rows where the condition is false; NULL passes, as in SQL."""

    name: str
    table: DataFrame
    condition: str

    def key(self) -> Column:
        return F.when(~F.expr(self.condition), F.lit("broken"))

    @staticmethod
    def violations() -> Column:
        return F.when(F.col("key").isNotNull(), F.col("rows")).otherwise(F.lit(0))


Rule = PrimaryKey | ForeignKey | Check


def not_null(name: str, table: DataFrame, column: str) -> Check:
    return Check(name, table, f"{column} IS NOT NULL")


def _entry(at: int, key: Column, rows: int) -> Column:
    """A key under a rule: of a row that the rule holds for, or (no rows) of a parent."""
    known = F.lit(rows == 0) & key.isNotNull()
    return F.struct(F.lit(at).alias("at"), key.alias("key"), F.lit(rows).alias("rows"), known.alias("known"))


def audit(rules: Sequence[Rule]) -> DataFrame:
    """(rule, violations) for every rule, in one scan of each table and one grouped count.

    A table gives each row's keys under all of its rules at once, and its keys as
    a parent; equal keys are added up before the shuffle, so a hot one crosses as
    one row per task. Keys are compared as text.
    """
    tables: dict[int, tuple[DataFrame, list[Column]]] = {}
    for at, rule in enumerate(rules):
        tables.setdefault(id(rule.table), (rule.table, []))[1].append(_entry(at, rule.key(), 1))
        if isinstance(rule, ForeignKey):
            key = F.col(rule.parent_column).cast("string")
            tables.setdefault(id(rule.parent), (rule.parent, []))[1].append(_entry(at, key, 0))
    # a rule of an empty table is reported as well: a NULL key of no rows
    every = rules[0].table.sparkSession.range(1).select(
        F.inline(F.array(*[_entry(at, F.lit(None).cast("string"), 0) for at in range(len(rules))]))
    )
    entries = [table.select(F.inline(F.array(*own))) for table, own in tables.values()]
    counts = reduce(DataFrame.unionByName, entries, every).groupBy("at", "key").agg(
        F.sum("rows").alias("rows"), F.max("known").alias("known")
    )
    name, wrong = F, F
    for at, rule in enumerate(rules):
        name = name.when(F.col("at") == at, F.lit(rule.name))
        wrong = wrong.when(F.col("at") == at, F.greatest(rule.violations(), F.lit(0)))
    return counts.groupBy(name.alias("rule")).agg(F.sum(wrong).alias("violations"))
