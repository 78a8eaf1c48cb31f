"""Q7: the circumstances under which fraud succeeds most often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, label_flag, mean_if, ratio_pct, round_exact, sum_if, time_window
from tamarack.operators.filters import having_count
from tamarack.operators.ranking import rank_in_group, top_k

DIMENSIONS = ("time_window", "day_type", "device_type", "txn_geography", "auth_strength", "merchant_category")


def attack_windows(transactions: DataFrame, min_txns: int = fv.WINDOW_MIN_TXNS) -> DataFrame:
    """Fraud rate and loss per combination with at least ``min_txns`` transactions."""
    c, n = F.col, F.count("*")
    grouped = transactions.groupBy(
        time_window(c("hour_of_day")).alias("time_window"),
        label_flag(c("is_weekend"), fv.WEEKEND, fv.WEEKDAY).alias("day_type"),
        "device_type",
        label_flag(c("is_foreign_txn"), fv.FOREIGN, fv.DOMESTIC).alias("txn_geography"),
        label_flag(~c("has_2fa"), fv.NO_2FA, fv.HAS_2FA).alias("auth_strength"),
        "merchant_category",
    ).agg(
        n.alias("total_txns"),
        F.sum(c("is_fraud").cast("int")).alias("fraud_txns"),
        round_exact(ratio_pct(F.sum(c("is_fraud").cast("int")), n), 2).alias("fraud_success_rate_pct"),
        round_exact(mean_if(c("is_fraud"), c("amount")), 2).alias("avg_fraud_amount"),
        sum_if(c("is_fraud"), c("amount")).cast("double").alias("total_fraud_loss"),
    )
    return having_count(grouped, min_txns, "total_txns")


def attack_window(
    transactions: DataFrame,
    min_txns: int = fv.WINDOW_MIN_TXNS,
    reliability: Sequence[tuple[int, str]] = fv.RELIABILITY_CUTS,
    top: int = fv.WINDOW_TOP,
) -> DataFrame:
    """The ``top`` riskiest windows.

    A window's rank depends only on the windows above it, and those are all
    among the first rows. So the first rows are taken by a distributed top-k and
    ranked afterwards; no task sorts the whole list.
    """
    n = F.col("total_txns")
    best = top_k(
        attack_windows(transactions, min_txns),
        [("fraud_success_rate_pct", "desc"), ("total_txns", "desc"), *[(d,) for d in DIMENSIONS]],
        top,
    )
    return best.select(
        rank_in_group([], "fraud_success_rate_pct", "desc").alias("risk_rank"),
        *DIMENSIONS,
        "total_txns",
        "fraud_txns",
        "fraud_success_rate_pct",
        banded([(n >= cut, text) for cut, text in reliability], fv.RELIABILITY_LOW).alias("sample_reliability"),
        "avg_fraud_amount",
        "total_fraud_loss",
    ).orderBy("risk_rank", F.col("total_txns").desc(), *DIMENSIONS)
