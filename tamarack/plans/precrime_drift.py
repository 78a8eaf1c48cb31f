"""Q9: accounts whose clean history drifted before their first fraud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, mean_if, positive_count, round_exact
from tamarack.operators.joins import divisible_join
from tamarack.operators.ranking import order
from tamarack.operators.sequences import half_split, sequence

SIGNALS = ("ip_risk_score", "velocity_1h", "is_foreign_txn", "amount_vs_avg_ratio")


def clean_history(transactions: DataFrame, min_pre: int = fv.MIN_PRE_TXNS) -> DataFrame:
    """Clean transactions before the first fraud, numbered in time, with their count.

    One aggregate finds each account's first fraud and how many clean rows it
    has; accounts that cannot reach ``min_pre`` go no further.
    """
    accounts = (
        transactions.groupBy("account_id")
        .agg(
            F.min(F.when(F.col("is_fraud"), F.col("ts"))).alias("first_fraud_ts"),
            F.count_if(~F.col("is_fraud")).alias("clean_rows"),
        )
        .filter((F.col("clean_rows") >= min_pre) & F.col("first_fraud_ts").isNotNull())
        .select("account_id", "first_fraud_ts")
    )
    clean = transactions.filter(~F.col("is_fraud")).select("account_id", "ts", "transaction_id", *SIGNALS)
    earlier = divisible_join(clean, accounts, ["account_id"]).filter(F.col("ts") < F.col("first_fraud_ts"))
    return sequence(earlier, "account_id", "ts", "transaction_id").filter(F.col("group_rows") >= min_pre)


def precrime_drift(transactions: DataFrame, min_pre: int = fv.MIN_PRE_TXNS) -> DataFrame:
    """Late half minus early half of four risk signals per account.

    Both halves are averaged side by side in one aggregate instead of a self-join.
    """
    halved = clean_history(transactions, min_pre).withColumn("phase", half_split(F.col("rn"), F.col("group_rows")))
    early, late = F.col("phase") == "early", F.col("phase") == "late"

    def drift(x, scale: int = 1):
        return (mean_if(late, x) - mean_if(early, x)) * F.lit(float(scale))

    c = F.col
    drifts = halved.groupBy("account_id").agg(
        round_exact(drift(c("ip_risk_score")), 2).alias("ip_drift"),
        round_exact(drift(c("velocity_1h")), 2).alias("velocity_drift"),
        round_exact(drift(c("is_foreign_txn").cast("int"), 100), 2).alias("foreign_pct_drift"),
        round_exact(drift(c("amount_vs_avg_ratio")), 2).alias("spend_ratio_drift"),
    )
    return order(judge_drift(drifts), [("drift_signals_positive", "desc"), ("ip_drift", "desc"), ("account_id",)])


def judge_drift(drifts: DataFrame) -> DataFrame:
    ip, velocity = F.col("ip_drift"), F.col("velocity_drift")
    foreign, spend = F.col("foreign_pct_drift"), F.col("spend_ratio_drift")
    found = (ip > 0) & (velocity > 0) & ((foreign > 0) | (spend > 0))
    return drifts.withColumns(
        {
            "drift_signals_positive": positive_count(ip, velocity, foreign, spend),
            "pre_crime_verdict": banded([(found, fv.DRIFT_FOUND)], fv.DRIFT_NONE),
        }
    )
