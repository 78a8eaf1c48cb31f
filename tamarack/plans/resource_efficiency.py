"""Q1: which patterns cause more loss than their share of attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, ratio_pct, round_exact, safe_div
from tamarack.operators.ranking import order
from tamarack.operators.totals import with_totals


def resource_efficiency(transactions: DataFrame, fraud_patterns: DataFrame, gap: float = fv.EFFICIENCY_GAP) -> DataFrame:
    """Loss share against volume share per pattern.

    Fraud is summed per pattern before it meets the pattern table, so the join
    has one row per pattern on either side and no hot key.
    """
    summed = (
        transactions.filter("is_fraud AND fraud_pattern IS NOT NULL")
        .groupBy("fraud_pattern")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("loss"), F.count("amount").alias("priced"))
    )
    known = fraud_patterns.select(
        "fraud_pattern",
        F.col("avg_velocity_1h").cast("double").alias("attack_speed"),
        F.col("pct_card_not_present").cast("double").alias("pct_card_not_present"),
        F.col("pct_foreign").cast("double").alias("pct_foreign"),
    )
    joined = summed.join(known, "fraud_pattern")
    shares = with_totals(joined, {"all_n": F.sum("n"), "all_loss": F.sum("loss")}).select(
        "fraud_pattern",
        F.col("n").alias("total_fraud_txns"),
        F.col("loss").cast("double").alias("total_loss"),
        round_exact(safe_div(F.col("loss"), F.col("priced")), 2).alias("avg_loss_per_attack"),
        round_exact(ratio_pct(F.col("n"), F.col("all_n")), 2).alias("share_of_fraud_volume"),
        round_exact(ratio_pct(F.col("loss"), F.col("all_loss")), 2).alias("share_of_fraud_loss"),
        "attack_speed",
        "pct_card_not_present",
        "pct_foreign",
    )
    return order(classify_efficiency(shares, gap), [("resource_efficiency_gap", "desc"), ("fraud_pattern",)])


def classify_efficiency(shares: DataFrame, gap: float = fv.EFFICIENCY_GAP) -> DataFrame:
    """Gap between the rounded shares, and the verdict on it."""
    difference = F.col("share_of_fraud_loss") - F.col("share_of_fraud_volume")
    rounded = F.col("resource_efficiency_gap")
    return shares.withColumn("resource_efficiency_gap", round_exact(difference, 2)).withColumn(
        "control_efficiency_verdict",
        banded([(rounded > gap, fv.UNDER_POLICED), (rounded < -gap, fv.OVER_POLICED)], fv.BALANCED),
    )
