"""Q8: what fraud cost after a ring's first member was known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import plus_days
from tamarack.operators.ranking import order
from tamarack.operators.rings import ring_first_events, ring_pairs
from tamarack.operators.timeline import totals_after


def response_lag(transactions: DataFrame, edges: DataFrame, window_days: int = fv.RESPONSE_WINDOW_DAYS) -> DataFrame:
    """Loss of the other members after the seed date, split at the response window."""
    return lag_cost(ring_first_events(transactions, edges), transactions, window_days)


def lag_cost(members: DataFrame, transactions: DataFrame, window_days: int = fv.RESPONSE_WINDOW_DAYS) -> DataFrame:
    """The same from (ring_id, account_id, first_fraud_date), which the contagion reads as well.

    Each member asks its own fraud twice for what came later: after the seed
    date and after the window. Both answers come from running totals, so an
    account in many rings with much fraud is not multiplied out; the loss within
    the window is the difference.
    """
    others = ring_pairs(members)
    seed = F.col("seed_fraud_date")
    instants = F.posexplode(F.array(seed, plus_days(seed, window_days))).alias("cut", "ts")
    marks = others.select("account_id", "ring_id", "seed_account", "seed_fraud_date", instants)
    fraud = transactions.filter("is_fraud").select("account_id", "ts", "amount", F.lit(1).cast("bigint").alias("txns"))
    later = totals_after(fraud, marks, "account_id", "ts", {"amount": "loss", "txns": "n"})

    at_seed, at_end = F.col("cut") == 0, F.col("cut") == 1
    per_ring = (
        later.groupBy("ring_id", "seed_account", "seed_fraud_date")
        .agg(
            F.count_if(at_seed & (F.col("n") > 0)).alias("downstream_accounts_activated"),
            F.sum(F.when(at_seed, F.col("n"))).alias("downstream_fraud_txns"),
            F.sum(F.when(at_seed, F.col("loss"))).alias("loss"),
            F.sum(F.when(at_end, F.col("loss"))).alias("late"),
        )
        .filter("downstream_fraud_txns > 0")
    )
    result = per_ring.select(
        "ring_id",
        "seed_account",
        F.to_date("seed_fraud_date").alias("ring_detected_date"),
        "downstream_accounts_activated",
        "downstream_fraud_txns",
        F.col("loss").cast("double").alias("preventable_loss_usd"),
        (F.col("loss") - F.col("late")).cast("double").alias("loss_within_5day_response_window"),
        F.col("late").cast("double").alias("loss_after_response_window_missed"),
    )
    return order(result, [("preventable_loss_usd", "desc"), ("ring_id",)])
