"""Q2: how each pattern's behaviour moves from year to year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, interpret, mean, pct_change, ratio_pct, round_exact, year_of
from tamarack.operators.ranking import custom_order
from tamarack.operators.reshape import pivot_years, unpivot_metrics
from tamarack.operators.sequences import previous


def yearly_metrics(transactions: DataFrame) -> DataFrame:
    """The seven rounded metrics per pattern and year of fraud."""
    n = F.count("*")
    return (
        transactions.filter("is_fraud AND fraud_pattern IS NOT NULL")
        .groupBy("fraud_pattern", year_of(F.col("ts")).alias("year"))
        .agg(
            n.alias("attacks"),
            round_exact(mean(F.col("amount")), 2).alias("avg_attack_size"),
            round_exact(mean(F.col("velocity_1h")), 2).alias("avg_velocity"),
            round_exact(mean(F.col("ip_risk_score")), 2).alias("avg_ip_risk"),
            round_exact(mean(F.col("amount_vs_avg_ratio")), 3).alias("behavioural_disguise_score"),
            round_exact(ratio_pct(F.count_if("has_2fa"), n), 1).alias("pct_bypassing_2fa"),
            round_exact(ratio_pct(F.count_if("device_known"), n), 1).alias("pct_using_known_device"),
        )
    )


def yoy_changes(yearly: DataFrame) -> DataFrame:
    """Metric rows with the change from the previous year present, on rounded values."""
    rows = unpivot_metrics(yearly, ["fraud_pattern", "year"], fv.YOY_METRICS)
    before = previous("value", ["fraud_pattern", "metric"], "year")
    return rows.withColumn("prev_value", before).withColumn(
        "pct_change", round_exact(pct_change(F.col("value"), F.col("prev_value")), 1)
    )


def yoy_evolution(transactions: DataFrame, years: Sequence[int] = fv.YEARS) -> DataFrame:
    return summarise_evolution(yearly_metrics(transactions), years)


def summarise_evolution(yearly: DataFrame, years: Sequence[int] = fv.YEARS) -> DataFrame:
    """One row per pattern and metric: values by year, average change, reading.

    The year columns and the average change come from one aggregate over the
    rows of the change step, so neither a second scan nor a join back is needed.
    """
    change = F.col("avg_pct_change")
    trend = banded(
        [(change.isNull(), fv.TREND_UNKNOWN), (change > 0, fv.TREND_UP), (change < 0, fv.TREND_DOWN)], fv.TREND_FLAT
    )
    return (
        yoy_changes(yearly)
        .groupBy("fraud_pattern", "metric")
        .agg(
            *pivot_years(F.col("value"), F.col("year"), years),
            round_exact(F.avg("pct_change"), 1).alias("avg_pct_change"),
        )
        .withColumns({"avg_change_trend": trend, "business_interpretation": interpret(F.col("metric"), change)})
        .orderBy("fraud_pattern", custom_order(F.col("metric"), fv.YOY_METRICS))
    )
