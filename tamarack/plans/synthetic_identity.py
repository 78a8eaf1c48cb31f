"""Q3: accounts whose behaviour no genuine customer of their kind shows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import (
    banded,
    per_year,
    round_exact,
    safe_div,
    sd_or_null,
    weighted_clip_score,
    zscore,
)
from tamarack.operators.joins import divisible_join
from tamarack.operators.ranking import order


def identity_metrics(account_profiles: DataFrame) -> DataFrame:
    """The six behavioural metrics per account."""
    c = F.col
    return account_profiles.select(
        "account_id",
        "account_type",
        "home_country",
        "account_age_days",
        round_exact(per_year(c("unique_countries"), c("account_age_days")), 2).alias("countries_per_year"),
        round_exact(safe_div(c("unique_categories"), c("avg_monthly_txns")), 2).alias("category_diversity_ratio"),
        c("pct_foreign").cast("double").alias("foreign_txn_pct"),
        c("avg_ip_risk").cast("double").alias("avg_ip_risk"),
        c("avg_velocity").cast("double").alias("avg_velocity"),
        round_exact(safe_div(c("avg_txn_amount"), c("credit_limit")) * 100, 2).alias("avg_credit_utilization_pct"),
        "is_fraudster",
    )


def cohort_stats(
    accounts: DataFrame, metrics: Sequence[str], key: str = "account_type", counted: Column | None = None
) -> DataFrame:
    """Mean and non-zero sample deviation of each metric per cohort, over the accounts that ``counted`` admits.

    The condition stands in the aggregates, not before them, and every column is
    touched: the accounts beside the statistics then have the same plan up to
    their shuffle, which is run once.
    """
    aggregates = [F.max(F.xxhash64(*accounts.columns)).alias("_touch_all")]
    for m in metrics:
        value = F.col(m) if counted is None else F.when(counted, F.col(m))
        aggregates += [F.avg(value).alias(f"mean_{m}"), sd_or_null(value).alias(f"sd_{m}")]
    return accounts.groupBy(key).agg(*aggregates).filter(F.col(key).isNotNull()).drop("_touch_all")


def synthetic_identity(
    account_profiles: DataFrame,
    min_age: int = fv.MIN_AGE_DAYS,
    clip: float = fv.Z_CLIP,
    weights: Mapping[str, float] = fv.SYNTHETIC_WEIGHTS,
    cuts: Sequence[tuple[float, str]] = fv.SYNTHETIC_CUTS,
) -> DataFrame:
    """The scored accounts, the most suspicious first."""
    result = scored_identities(account_profiles, min_age, clip, weights, cuts)
    return order(result, [("synthetic_id_suspicion_score", "desc", "last"), ("account_id",)])


def scored_identities(
    account_profiles: DataFrame,
    min_age: int = fv.MIN_AGE_DAYS,
    clip: float = fv.Z_CLIP,
    weights: Mapping[str, float] = fv.SYNTHETIC_WEIGHTS,
    cuts: Sequence[tuple[float, str]] = fv.SYNTHETIC_CUTS,
) -> DataFrame:
    """Suspicion score against the account's cohort, in no order; young accounts stay unscored.

    Both groups of accounts pass through one scan: the left join leaves young
    accounts in place, and the age decides who is scored.
    """
    mature = F.col("account_age_days") >= min_age
    known = F.col("account_age_days").isNotNull() & (~mature | F.col("account_type").isNotNull())
    rows = identity_metrics(account_profiles).filter(known)
    stats = cohort_stats(rows, list(weights), counted=mature)
    beside = divisible_join(rows, stats, ["account_type"], "left")
    zs = {m: zscore(F.col(m), F.col(f"mean_{m}"), F.col(f"sd_{m}")) for m in weights}
    score = F.when(mature, round_exact(weighted_clip_score(zs, weights, clip), 1))
    scored = beside.withColumn("synthetic_id_suspicion_score", score)
    suspicion = F.col("synthetic_id_suspicion_score")
    verdict = banded(
        [(~mature, fv.SYNTHETIC_IMMATURE), *[(suspicion >= cut, text) for cut, text in cuts]], fv.SYNTHETIC_OK
    )
    return scored.select(
        "account_id",
        "account_type",
        "home_country",
        "account_age_days",
        *weights,
        "synthetic_id_suspicion_score",
        verdict.alias("synthetic_id_verdict"),
        "is_fraudster",
    )
