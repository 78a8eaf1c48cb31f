"""Q10: which pattern's behaviour foreshadows another's a year later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import banded, euclid, mean, pct_true, round_exact, sd_or_null, year_of, zscore
from tamarack.operators.ranking import order, rank_in_group
from tamarack.operators.totals import with_totals

METRICS = ("avg_vel", "avg_ip", "pct_foreign", "pct_cnp", "pct_no_2fa")


def pattern_fingerprints(transactions: DataFrame) -> DataFrame:
    """Five behavioural averages per pattern and year.

    The year is tested here because the join of years would test it on one path
    only, and the totals could then not share the shuffle.
    """
    c = F.col
    return (
        transactions.filter("is_fraud AND fraud_pattern IS NOT NULL")
        .filter(year_of(c("ts")).isNotNull())
        .groupBy("fraud_pattern", year_of(c("ts")).alias("year"))
        .agg(
            mean(c("velocity_1h")).alias("avg_vel"),
            mean(c("ip_risk_score")).alias("avg_ip"),
            pct_true(c("is_foreign_txn")).alias("pct_foreign"),
            pct_true(~c("card_present")).alias("pct_cnp"),
            pct_true(~c("has_2fa")).alias("pct_no_2fa"),
        )
    )


def standardised(fingerprints: DataFrame) -> DataFrame:
    """The metrics as z-scores over all pattern-years."""
    stats = {f"m_{m}": F.avg(m) for m in METRICS} | {f"sd_{m}": sd_or_null(F.col(m)) for m in METRICS}
    beside = with_totals(fingerprints, stats)
    return beside.select(
        "fraud_pattern",
        "year",
        *[zscore(F.col(m), F.col(f"m_{m}"), F.col(f"sd_{m}")).alias(f"z_{m}") for m in METRICS],
    )


def year_offset_pairs(z: DataFrame, offset: int = 1) -> DataFrame:
    """Distance of every pattern-year to the other patterns ``offset`` years later.

    One row per pattern and year goes in, so the pairs number patterns² × years
    whatever the number of transactions.
    """
    zs = [f"z_{m}" for m in METRICS]
    a = z.select(F.col("fraud_pattern").alias("pattern_a"), F.col("year").alias("year_a"), F.array(*zs).alias("za"))
    b = z.select(F.col("fraud_pattern").alias("pattern_b"), F.col("year").alias("year_b"), F.array(*zs).alias("zb"))
    n = range(len(METRICS))
    distance = euclid([F.col("za")[i] for i in n], [F.col("zb")[i] for i in n])
    following = (F.col("year_b") == F.col("year_a") + offset) & (F.col("pattern_a") != F.col("pattern_b"))
    return a.join(b, following).select(
        "pattern_a", "year_a", "pattern_b", "year_b", round_exact(distance, 3).alias("behavioural_distance")
    )


def qualified_matches(pairs: DataFrame) -> DataFrame:
    """Closest predecessors that also lie strictly below their cohort's median.

    Rank and median share one partitioning, so the median needs no join back.
    """
    cohort = Window.partitionBy("pattern_b", "year_b")
    distance = F.col("behavioural_distance")
    return pairs.withColumns(
        {
            "closest_predecessor_rank": rank_in_group(["pattern_b", "year_b"], "behavioural_distance"),
            "median_distance_this_cohort": F.percentile(distance, F.lit(0.5)).over(cohort),
        }
    ).filter((F.col("closest_predecessor_rank") == 1) & (distance < F.col("median_distance_this_cohort")))


def pattern_evolution(transactions: DataFrame, repeat: int = fv.REPEAT_TIMES) -> DataFrame:
    return judge_matches(
        qualified_matches(year_offset_pairs(standardised(pattern_fingerprints(transactions)))), repeat
    )


def judge_matches(matches: DataFrame, repeat: int = fv.REPEAT_TIMES) -> DataFrame:
    """Count how often each pair recurs, and say whether that is a signal."""
    times = F.col("times_flagged_as_predecessor")
    repetitions = matches.groupBy("pattern_a", "pattern_b").agg(
        F.count("*").alias("times_flagged_as_predecessor"),
        F.expr("listagg(CAST(year_b AS STRING), ', ') WITHIN GROUP (ORDER BY year_b)").alias(
            "years_flagged"
        ),
    )
    result = matches.join(repetitions, ["pattern_a", "pattern_b"]).select(
        "pattern_a",
        "year_a",
        "pattern_b",
        "year_b",
        "behavioural_distance",
        round_exact(F.col("median_distance_this_cohort"), 2).alias("median_distance_in_cohort"),
        "times_flagged_as_predecessor",
        "years_flagged",
        banded([(times >= repeat, fv.REPEAT_DONOR)], fv.SINGLE_MATCH).alias("signal_strength_verdict"),
    )
    return order(result, [("times_flagged_as_predecessor", "desc"), ("pattern_b",), ("year_b",), ("pattern_a",)])
