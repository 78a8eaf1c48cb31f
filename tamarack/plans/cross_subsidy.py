"""Q6: which customer segments pay for the fraud of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, ratio_pct, round_exact, safe_div, sum_if
from tamarack.operators.ranking import order
from tamarack.operators.totals import with_totals


def segment_fraud(transactions: DataFrame, account_profiles: DataFrame) -> DataFrame:
    """Accounts, transactions and fraud per account type.

    Transactions are summed per account first, so the join is one row to one
    row and the distinct accounts are a plain count. Account averages stay
    weighted by transactions, as if every transaction carried them.
    """
    per_account = transactions.groupBy("account_id").agg(
        F.count("*").alias("rows"),
        F.count("transaction_id").alias("txns"),
        F.count_if("is_fraud").alias("frauds"),
        sum_if(F.col("is_fraud"), F.col("amount")).alias("loss"),
        F.sum("amount").alias("volume"),
    )

    def weighted_mean(column: str):
        known = F.when(F.col(column).isNotNull(), F.col("rows"))
        return safe_div(F.sum(F.col(column).cast("decimal(12,2)") * F.col("rows").cast("decimal(18,0)")), F.sum(known))

    return (
        account_profiles.select("account_id", "account_type", "credit_limit", "risk_score")
        .join(per_account, "account_id")
        .groupBy("account_type")
        .agg(
            F.count("*").alias("total_accounts"),
            F.sum("txns").alias("total_txns"),
            F.sum("frauds").alias("fraud_txns"),
            F.sum("loss").cast("double").alias("fraud_loss"),
            F.sum("volume").cast("double").alias("total_volume"),
            round_exact(weighted_mean("credit_limit"), 2).alias("avg_credit_limit"),
            round_exact(weighted_mean("risk_score"), 2).alias("avg_risk_score"),
        )
    )


def cross_subsidy(transactions: DataFrame, account_profiles: DataFrame, risk_cut: float = fv.RISK_CUT) -> DataFrame:
    segments = with_totals(
        segment_fraud(transactions, account_profiles),
        {
            "grand_total_fraud_loss": F.sum(F.col("fraud_loss").cast("decimal(28,2)")),
            "grand_total_txns": F.sum("total_txns"),
        },
    )
    return price_segments(segments, risk_cut)


def price_segments(segments: DataFrame, risk_cut: float = fv.RISK_CUT) -> DataFrame:
    """Fraud cost per transaction of each segment against the portfolio's."""
    c = F.col
    taxed = segments.withColumns(
        {
            "blended_portfolio_fraud_tax_per_txn": round_exact(
                safe_div(c("grand_total_fraud_loss"), c("grand_total_txns")), 4
            ),
            "implied_fraud_tax_per_txn": round_exact(safe_div(c("fraud_loss"), c("total_txns")), 4),
        }
    )
    blended, implied = c("blended_portfolio_fraud_tax_per_txn"), c("implied_fraud_tax_per_txn")
    verdict = banded(
        [
            ((implied < blended) & (c("avg_risk_score") < risk_cut), fv.SUBSIDISING),
            ((implied > blended) & (c("avg_risk_score") >= risk_cut), fv.SUBSIDISED),
        ],
        fv.FAIRLY_PRICED,
    )
    result = taxed.select(
        "account_type",
        "total_accounts",
        "total_txns",
        "fraud_txns",
        round_exact(ratio_pct(c("fraud_txns"), c("total_txns")), 2).alias("fraud_rate_pct"),
        "fraud_loss",
        round_exact(ratio_pct(c("fraud_loss"), c("grand_total_fraud_loss")), 2).alias("share_of_total_fraud_loss"),
        round_exact(safe_div(c("fraud_loss"), c("total_accounts")), 2).alias("fraud_cost_per_account"),
        "avg_risk_score",
        "implied_fraud_tax_per_txn",
        "blended_portfolio_fraud_tax_per_txn",
        round_exact(blended - implied, 4).alias("subsidy_gap_per_txn"),
        round_exact((blended - implied) * c("total_txns"), 2).alias("net_dollar_subsidy_effect"),
        verdict.alias("cross_subsidy_verdict"),
    )
    return order(result, [("net_dollar_subsidy_effect", "desc"), ("account_type",)])
