"""Tables derived from the transactions: accounts, patterns, hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import hour_start, mean, pct_true, ratio_pct, round_exact, safe_div, sum_if
from tamarack.operators.medians import exact_median
from tamarack.operators.totals import share_of_total


def account_totals(transactions: DataFrame) -> DataFrame:
    """Counts and exact sums per account, one row each.

    One pass: each task passes on a row per account with its sums and its
    distinct values, so an account of any size is a row per task, and nothing
    is shuffled twice.
    """
    return transactions.groupBy("account_id").agg(
        F.count("*").alias("n"),
        F.sum("amount").alias("amt"),
        F.max("amount").alias("mx"),
        F.count_if("is_fraud").alias("nf"),
        sum_if(F.col("is_fraud"), F.col("amount")).alias("amtf"),
        F.count_if("is_foreign_txn").alias("nfor"),
        F.sum("velocity_1h").alias("vel"),
        F.sum("ip_risk_score").alias("ip"),
        F.size(F.collect_set("merchant_country")).cast("bigint").alias("nc"),
        F.size(F.collect_set("merchant_category")).cast("bigint").alias("ncat"),
    )


def account_profile(transactions: DataFrame) -> DataFrame:
    """The aggregate columns of the account table."""
    n = F.col("n")
    return account_totals(transactions).select(
        "account_id",
        n.alias("total_transactions"),
        F.col("amt").cast("double").alias("total_amount"),
        round_exact(safe_div(F.col("amt"), n), 2).alias("avg_amount"),
        F.col("mx").cast("double").alias("max_amount"),
        F.col("nf").alias("fraud_count"),
        F.col("amtf").cast("double").alias("fraud_amount"),
        round_exact(safe_div(F.col("nf"), n), 6).alias("fraud_rate"),
        round_exact(safe_div(F.col("nfor"), n), 4).alias("pct_foreign"),
        round_exact(safe_div(F.col("vel"), n), 4).alias("avg_velocity"),
        F.col("nc").alias("unique_countries"),
        F.col("ncat").alias("unique_categories"),
        round_exact(safe_div(F.col("ip"), n), 2).alias("avg_ip_risk"),
    )


def pattern_stats(transactions: DataFrame) -> DataFrame:
    """Profile of each fraud pattern, all but the median."""
    fraud = transactions.filter("is_fraud AND fraud_pattern IS NOT NULL")
    night = F.col("hour_of_day").between(*fv.NIGHT_HOURS)
    rows = fraud.groupBy("fraud_pattern").agg(
        F.count("*").alias("transaction_count"),
        round_exact(mean(F.col("amount")), 2).alias("avg_amount"),
        round_exact(ratio_pct(F.count_if(night), F.count("*")), 2).alias("pct_night_0_5"),
        round_exact(pct_true(F.col("is_foreign_txn")), 2).alias("pct_foreign"),
        round_exact(pct_true(~F.col("card_present")), 2).alias("pct_card_not_present"),
        round_exact(mean(F.col("velocity_1h")), 4).alias("avg_velocity_1h"),
        round_exact(mean(F.col("ip_risk_score")), 2).alias("avg_ip_risk"),
        round_exact(pct_true(~F.col("has_2fa")), 2).alias("pct_no_2fa"),
    )
    return share_of_total(rows, "transaction_count", "fraud_share_pct")


def pattern_profile(transactions: DataFrame) -> DataFrame:
    """The ``fraud_patterns`` table: one row per pattern, exact median included."""
    fraud = transactions.filter("is_fraud AND fraud_pattern IS NOT NULL")
    medians = exact_median(fraud, ["fraud_pattern"], "amount", "median")
    return (
        pattern_stats(transactions)
        .join(medians, "fraud_pattern", "left")
        .select(
            "fraud_pattern",
            "transaction_count",
            "fraud_share_pct",
            "avg_amount",
            round_exact(F.col("median"), 2).alias("median_amount"),
            "pct_night_0_5",
            "pct_foreign",
            "pct_card_not_present",
            "avg_velocity_1h",
            "avg_ip_risk",
            "pct_no_2fa",
        )
    )


def hourly_rollup(transactions: DataFrame) -> DataFrame:
    """The ``time_series_stats`` table: one row per calendar hour; Monday is day 0."""
    hour = hour_start(F.col("ts"))
    n, weekday = F.col("transaction_count"), F.weekday("hour")
    return (
        transactions.groupBy(hour.alias("hour"))
        .agg(
            F.count("*").alias("transaction_count"),
            F.count_if("is_fraud").alias("fraud_count"),
            F.sum("amount").cast("double").alias("total_amount"),
            round_exact(mean(F.col("amount")), 2).alias("avg_amount"),
            round_exact(mean(F.col("ip_risk_score")), 2).alias("avg_ip_risk"),
        )
        .withColumns(
            {
                "fraud_rate": round_exact(safe_div(F.col("fraud_count"), n), 6),
                "hour_of_day": F.hour("hour"),
                "day_of_week": weekday,
                "is_weekend": weekday >= 5,
            }
        )
    )
