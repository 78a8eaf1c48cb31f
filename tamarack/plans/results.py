"""Summaries drawn from the investigations' results.

Each takes result tables and returns a small one. Averages over a result count
a missing number as zero, as a total over displayed rows does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack.functions import ratio_pct, round_exact, safe_div, verdict_tier
from tamarack.operators.filters import dimension_filter, text_search
from tamarack.operators.ranking import table_view, top_k
from tamarack.operators.totals import share_of_total

MONEY = "decimal(28,2)"
RATIO = "decimal(28,4)"


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def _sum_money(column: str) -> Column:
    return zero_if_null(F.sum(F.col(column).cast(MONEY))).cast("double")


def _mean_shown(column: str) -> Column:
    """Mean of displayed values, missing ones as zero."""
    return safe_div(F.sum(zero_if_null(F.col(column)).cast(RATIO)), F.count("*"))


def _is_flagged(verdict: str) -> Column:
    return verdict_tier(F.col(verdict)) != "good"


def portfolio_kpis(
    efficiency: DataFrame, contagion: DataFrame, lag: DataFrame, pattern: str = fv.NO_FILTER
) -> DataFrame:
    """Headline numbers; only loss and transactions follow the pattern filter."""
    chosen = dimension_filter(efficiency, "fraud_pattern", pattern).agg(
        _sum_money("total_loss").alias("total_loss"),
        zero_if_null(F.sum("total_fraud_txns")).alias("total_fraud_txns"),
    )
    rings = contagion.agg(
        F.struct(
            F.count("*").alias("ring_count"),
            zero_if_null(round_exact(_mean_shown("avg_days_to_spread"), 1)).alias("avg_days_to_spread"),
        )
    ).scalar()
    return (
        chosen.withColumn("rings", rings)
        .withColumn("loss_to_response_lag", lag.agg(_sum_money("loss_after_response_window_missed")).scalar())
        .select("total_loss", "total_fraud_txns", "rings.*", "loss_to_response_lag")
    )


def loss_share(efficiency: DataFrame, pattern: str = fv.NO_FILTER) -> DataFrame:
    """Loss and its share per pattern, among the patterns shown."""
    chosen = dimension_filter(efficiency, "fraud_pattern", pattern)
    losses = chosen.groupBy("fraud_pattern").agg(_sum_money("total_loss").alias("total_loss"))
    return share_of_total(losses, "total_loss", "loss_share_pct")


def heatmap_cells(hourly: DataFrame) -> DataFrame:
    """Transactions, fraud and fraud rate per weekday and hour."""
    return (
        hourly.groupBy(F.col("day_of_week").cast("int").alias("day"), F.col("hour_of_day").cast("int").alias("hour"))
        .agg(F.sum("transaction_count").alias("txn"), F.sum("fraud_count").alias("fraud"))
        .withColumn("rate", round_exact(ratio_pct(F.col("fraud"), F.col("txn")), 3))
    )


def heatmap(hourly: DataFrame) -> DataFrame:
    """All 168 cells, empty ones as zero, with the intensity relative to the hottest."""
    cells = heatmap_cells(hourly)
    grid = hourly.sparkSession.range(7 * 24).select(
        F.expr("CAST(id div 24 AS INT)").alias("day"), F.expr("CAST(id % 24 AS INT)").alias("hour")
    )
    filled = grid.join(cells, ["day", "hour"], "left").select(
        "day", "hour", *[zero_if_null(F.col(x)).alias(x) for x in ("txn", "fraud", "rate")]
    )
    # 168 rows at most
    hottest = F.max("rate").over(Window.partitionBy())
    return filled.withColumn("intensity", round_exact(zero_if_null(safe_div(F.col("rate"), hottest)), 4))


def metric_trend(evolution: DataFrame, metric: str, years: Sequence[int] = fv.YEARS) -> DataFrame:
    """Yearly values of one metric, one series per pattern."""
    chosen = dimension_filter(evolution, "metric", metric)
    return chosen.select("fraud_pattern", *[f"y_{y}" for y in years])


def metric_names(evolution: DataFrame) -> DataFrame:
    return evolution.select("metric").distinct()


def verdict_distribution(result: DataFrame, verdict: str) -> DataFrame:
    """Rows, share and tier per verdict."""
    counts = result.groupBy(F.col(verdict).alias("verdict")).agg(F.count("*").alias("n"))
    return share_of_total(counts, "n", "pct", 1).withColumn("tier", verdict_tier(F.col("verdict")))


def precision_kpis(identity: DataFrame) -> DataFrame:
    """Flagged accounts and how many of them are known fraudsters.

    Unscored young accounts count as flagged, their verdict not being a good one.
    """
    n, flagged = F.count("*"), F.count_if(_is_flagged("synthetic_id_verdict"))
    caught = F.count_if(_is_flagged("synthetic_id_verdict") & (F.col("is_fraudster") == 1))
    return identity.agg(
        n.alias("accounts"),
        flagged.alias("flagged"),
        round_exact(ratio_pct(flagged, n), 1).alias("flagged_pct"),
        caught.alias("confirmed_fraudsters"),
        round_exact(ratio_pct(caught, flagged), 1).alias("precision_pct"),
        round_exact(_mean_shown("synthetic_id_suspicion_score"), 1).alias("avg_score"),
    )


def score_histogram(
    identity: DataFrame, width: int = fv.HISTOGRAM_BIN, bins: int = fv.HISTOGRAM_BINS, include_unscored: bool = False
) -> DataFrame:
    """Accounts per score bin, fraudsters and others apart; the last bin holds its upper end.

    ``include_unscored`` counts accounts without a score in the first bin.
    """
    score = F.col("synthetic_id_suspicion_score")
    rows = identity.withColumn("s", zero_if_null(score) if include_unscored else score).filter("s IS NOT NULL")
    bin_start = F.least(F.floor(F.col("s") / width), F.lit(bins - 1)) * width
    counts = rows.groupBy(bin_start.cast("int").alias("bin_start")).agg(
        F.count_if(F.col("is_fraudster") == 1).alias("fraudsters"),
        F.count_if(F.col("is_fraudster") == 0).alias("legitimate"),
    )
    all_bins = identity.sparkSession.range(bins).select((F.col("id") * width).cast("int").alias("bin_start"))
    return (
        all_bins.join(counts, "bin_start", "left")
        .select(
            "bin_start",
            zero_if_null(F.col("fraudsters")).alias("fraudsters"),
            zero_if_null(F.col("legitimate")).alias("legitimate"),
        )
    )


def mule_kpis(mules: DataFrame) -> DataFrame:
    n, flagged = F.count("*"), F.count_if(_is_flagged("aml_verdict"))
    return mules.agg(
        n.alias("accounts"),
        flagged.alias("flagged"),
        round_exact(ratio_pct(flagged, n), 1).alias("flagged_pct"),
        F.count_if(F.col("structuring_txn_count") > 0).alias("structuring_accounts"),
        round_exact(_mean_shown("mule_suspicion_score"), 1).alias("avg_score"),
    )


def mule_by_type(mules: DataFrame) -> DataFrame:
    return mules.groupBy("account_type").agg(
        round_exact(_mean_shown("mule_suspicion_score"), 2).alias("avg_mule_score")
    )


def ring_kpis(contagion: DataFrame) -> DataFrame:
    return contagion.agg(
        F.count("*").alias("rings"),
        round_exact(_mean_shown("connected_accounts"), 1).alias("avg_ring_size"),
        round_exact(_mean_shown("avg_days_to_spread"), 1).alias("avg_days_to_spread"),
        F.count_if(F.col("response_priority").contains("CRITICAL")).alias("critical_rings"),
        F.min("first_replication_speed_days").alias("fastest_replication_days"),
    )


def ring_points(contagion: DataFrame) -> DataFrame:
    """Size against spread, one point per ring, with its tier."""
    return contagion.select(
        "ring_id",
        "connected_accounts",
        "avg_days_to_spread",
        verdict_tier(F.col("response_priority")).alias("tier"),
    )


def lag_kpis(lag: DataFrame) -> DataFrame:
    sums = lag.agg(
        F.count("*").alias("rings"),
        _sum_money("preventable_loss_usd").alias("preventable"),
        _sum_money("loss_within_5day_response_window").alias("within_window"),
        _sum_money("loss_after_response_window_missed").alias("after_window"),
    )
    c = F.col
    return sums.withColumns(
        {
            "within_pct": round_exact(ratio_pct(c("within_window"), c("preventable")), 1),
            "after_pct": round_exact(ratio_pct(c("after_window"), c("preventable")), 1),
            "avg_per_ring": round_exact(safe_div(c("preventable"), c("rings")), 2),
        }
    )


def top_rings(lag: DataFrame, k: int = fv.TOP_RINGS) -> DataFrame:
    return top_k(lag, [("preventable_loss_usd", "desc"), ("ring_id",)], k).select(
        "ring_id", "preventable_loss_usd", "loss_within_5day_response_window", "loss_after_response_window_missed"
    )


def drift_kpis(drifts: DataFrame) -> DataFrame:
    return drifts.agg(
        F.count("*").alias("accounts"),
        round_exact(_mean_shown("drift_signals_positive"), 2).alias("avg_signals"),
        F.count_if(F.col("drift_signals_positive") == 4).alias("all_four_positive"),
        round_exact(_mean_shown("ip_drift"), 1).alias("avg_ip_drift"),
    )


def drift_histogram(drifts: DataFrame) -> DataFrame:
    """Accounts per number of positive signals, from one to four."""
    counts = drifts.agg(*[F.count_if(F.col("drift_signals_positive") == n).alias(str(n)) for n in range(1, 5)])
    return counts.unpivot([], ["1", "2", "3", "4"], "signals", "accounts").withColumn(
        "signals", F.col("signals").cast("int")
    )


def drift_points(drifts: DataFrame) -> DataFrame:
    """IP-risk drift against velocity drift, one point per account."""
    return drifts.select(
        "account_id", "ip_drift", "velocity_drift", (F.col("drift_signals_positive") == 4).alias("all_four_positive")
    )


def predecessor_totals(evolution: DataFrame) -> DataFrame:
    """How often each pattern was flagged, over all its matches."""
    return evolution.groupBy("pattern_a").agg(
        zero_if_null(F.sum("times_flagged_as_predecessor")).alias("times_flagged")
    )


def transition_points(evolution: DataFrame) -> DataFrame:
    """Distance against cohort median, one point per match, with its tier."""
    return evolution.select(
        "pattern_a",
        "year_a",
        "pattern_b",
        "year_b",
        "behavioural_distance",
        "median_distance_in_cohort",
        verdict_tier(F.col("signal_strength_verdict")).alias("tier"),
    )


# columns in which each result table is searched
SEARCH_COLUMNS: Mapping[str, tuple[str, ...]] = {
    "synthetic_identity": ("account_id", "home_country"),
    "money_mule": ("account_id", "home_country"),
    "ring_contagion": ("ring_id", "seed_account"),
    "response_lag": ("ring_id", "seed_account"),
    "precrime_drift": ("account_id",),
}


def search_result(result: DataFrame, kind: str, needle: str) -> DataFrame:
    return text_search(result, SEARCH_COLUMNS[kind], needle)


def result_page(
    result: DataFrame,
    kind: str,
    search: str = "",
    filters: Mapping[str, object] | None = None,
    sort: tuple[str, str] | None = None,
    number: int = 0,
    size: int | None = fv.PAGE_SIZE,
) -> DataFrame:
    """One page of a result table as it is browsed."""
    columns = SEARCH_COLUMNS[kind]
    return table_view(result, columns[0], search, columns, filters, sort, number, size)
