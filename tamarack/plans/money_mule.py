"""Q4: accounts that move money the way mules do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, capped, mean, mean_if, ratio_pct, round_exact
from tamarack.operators.filters import in_bands
from tamarack.operators.ranking import order


def account_behaviour(
    transactions: DataFrame, bands: Sequence[tuple[float, float]] = fv.STRUCTURING_BANDS
) -> DataFrame:
    """Behaviour per account. The distinct count aggregates by (account, country)
    first, so even an account with a third of all rows is spread over tasks."""
    n = F.count("*")
    return transactions.groupBy("account_id").agg(
        round_exact(mean_if(F.col("is_foreign_txn"), F.col("amount")), 2).alias("avg_foreign_amount"),
        F.count_if("is_foreign_txn").alias("foreign_txn_count"),
        round_exact(mean(F.col("velocity_1h")), 2).alias("avg_velocity"),
        F.max("velocity_1h").alias("peak_velocity"),
        round_exact(ratio_pct(F.count_if(F.col("hour_of_day").between(*fv.NIGHT_HOURS)), n), 1).alias(
            "pct_night_activity"
        ),
        F.count_if(in_bands(F.col("amount"), bands)).alias("structuring_txn_count"),
        n.alias("total_txns"),
        F.sum("amount").cast("double").alias("total_volume"),
        F.count_distinct("merchant_country").alias("countries_touched"),
    )


def money_mule(
    transactions: DataFrame,
    account_profiles: DataFrame,
    bands: Sequence[tuple[float, float]] = fv.STRUCTURING_BANDS,
    rules: Mapping[str, tuple[float, float, float]] = fv.MULE_RULES,
    min_score: float = fv.MULE_MIN_SCORE,
    cuts: Sequence[tuple[float, str]] = fv.MULE_CUTS,
) -> DataFrame:
    """Rule score per account, above ``min_score``.

    Transactions are summed per account before the join, which then matches one
    row with one row. The score needs no account columns, so accounts below the
    floor are dropped before they are shuffled to it.
    """
    behaviour = account_behaviour(transactions, bands)
    signals = [capped(F.col(name), *rule) for name, rule in rules.items()]
    structured = F.col("structuring_txn_count") > 0
    points = sum(signals, F.when(structured, F.lit(float(fv.STRUCTURING_POINTS))).otherwise(F.lit(0.0)))
    score = F.col("mule_suspicion_score")
    scored = behaviour.withColumn("mule_suspicion_score", round_exact(points, 1)).filter(score > min_score)
    accounts = account_profiles.select("account_id", "account_type", "home_country", "risk_score", "is_fraudster")
    verdict = banded(
        [
            (structured & (F.col("peak_velocity") > fv.BURST_VELOCITY), fv.MULE_BURST),
            *[(score >= cut, text) for cut, text in cuts],
        ],
        fv.MULE_NORMAL,
    )
    result = scored.join(accounts, "account_id").select(
        "account_id",
        "account_type",
        "home_country",
        "total_txns",
        "total_volume",
        "foreign_txn_count",
        "avg_velocity",
        "peak_velocity",
        "pct_night_activity",
        "structuring_txn_count",
        "countries_touched",
        "mule_suspicion_score",
        F.col("risk_score").cast("double").alias("risk_score"),
        "is_fraudster",
        verdict.alias("aml_verdict"),
    )
    return order(result, [("mule_suspicion_score", "desc"), ("account_id",)])
