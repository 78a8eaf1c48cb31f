"""Q5: how fast fraud spreads through a ring after its first member."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, days_between, micros, round_exact
from tamarack.functions.times import MICROS_PER_DAY
from tamarack.operators.ranking import order
from tamarack.operators.rings import ring_first_events


def ring_contagion(
    transactions: DataFrame, edges: DataFrame, cuts: Sequence[tuple[float, str]] = fv.RESPONSE_CUTS
) -> DataFrame:
    return contagion_speed(ring_first_events(transactions, edges), cuts)


def contagion_speed(members: DataFrame, cuts: Sequence[tuple[float, str]] = fv.RESPONSE_CUTS) -> DataFrame:
    """Spread per ring from (ring_id, account_id, first_fraud_date).

    Members are never joined with their ring: the seed and the next member are
    the first two in time (each task passes on two rows per ring at most), and
    everything else is a plain aggregate. A ring of any size is therefore
    reduced before the shuffle.
    """
    in_time = Window.partitionBy("ring_id").orderBy("first_fraud_date", "account_id")
    first_two = members.withColumn("rn", F.row_number().over(in_time)).filter("rn <= 2")
    opening = first_two.groupBy("ring_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("account_id"))).alias("seed_account"),
        F.max(F.when(F.col("rn") == 1, F.col("first_fraud_date"))).alias("seed_date"),
        F.max(F.when(F.col("rn") == 2, F.col("first_fraud_date"))).alias("next_date"),
    )
    size = members.groupBy("ring_id").agg(
        (F.count("*") - 1).alias("connected_accounts"),
        F.max("first_fraud_date").alias("last_date"),
        # exact, and wide enough for any number of members
        F.sum(micros(F.col("first_fraud_date")).cast("decimal(20,0)")).alias("sum_micros"),
    )
    c = F.col
    others, seed_micros = c("connected_accounts"), micros(c("seed_date")).cast("decimal(20,0)")
    spread_micros = (c("sum_micros") - seed_micros * (others + 1)).cast("double")
    soonest = days_between(c("seed_date"), c("next_date"))
    rings = opening.join(size, "ring_id").filter(others > 0)
    result = rings.select(
        "ring_id",
        "seed_account",
        F.to_date("seed_date").alias("ring_detected_date"),
        "connected_accounts",
        F.to_date("next_date").alias("first_infected_date"),
        F.to_date("last_date").alias("last_infected_date"),
        round_exact(soonest, 1).alias("first_replication_speed_days"),
        round_exact(days_between(c("seed_date"), c("last_date")), 1).alias("quarantine_window_days"),
        round_exact(spread_micros / others.cast("double") / F.lit(float(MICROS_PER_DAY)), 1).alias(
            "avg_days_to_spread"
        ),
        banded([(soonest < cut, text) for cut, text in cuts], fv.RESPONSE_STANDARD).alias("response_priority"),
    )
    return order(result, [("first_replication_speed_days", "asc"), ("ring_id",)])
