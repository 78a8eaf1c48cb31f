"""Fraud rings: members, first fraud of each member, seed account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.joins import divisible_join
from tamarack.operators.sequences import first_per_group


def first_event(transactions: DataFrame) -> DataFrame:
    """Time of the first fraud per account."""
    return transactions.filter("is_fraud").groupBy("account_id").agg(F.min("ts").alias("first_fraud_date"))


def ring_members(edges: DataFrame) -> DataFrame:
    """Distinct (ring, account) over both ends of the edges between two fraudsters."""
    ends = F.explode(F.array("account_a", "account_b")).alias("account_id")
    return edges.filter("both_fraud").select("ring_id", ends).distinct()


def ring_first_events(transactions: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of named rings with the time of their first fraud.

    An account may belong to any number of rings; such a hub is divided.
    """
    members = ring_members(edges.filter("ring_id IS NOT NULL AND account_a IS NOT NULL AND account_b IS NOT NULL"))
    return divisible_join(members, first_event(transactions), ["account_id"])


def ring_seeds(members: DataFrame) -> DataFrame:
    """Earliest member of each ring, the lower account first on equal times."""
    first = first_per_group(members, ["ring_id"], ["first_fraud_date", "account_id"])
    return first.select(
        "ring_id", F.col("account_id").alias("seed_account"), F.col("first_fraud_date").alias("seed_fraud_date")
    )


def ring_pairs(members: DataFrame) -> DataFrame:
    """Every other member of a ring beside the ring's seed.

    One seed row per ring, so the output is no larger than the members. A hot
    ring is divided among tasks.
    """
    return divisible_join(members, ring_seeds(members), ["ring_id"]).filter(F.col("account_id") != F.col("seed_account"))
