"""Every investigation, operator and summary as a query over one folder of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack import functions as fn
from tamarack.operators import (
    filters,
    joins,
    medians,
    quality,
    ranking,
    reshape,
    rings,
    sequences,
    timeline,
    totals,
)
from tamarack.plans import derived, results
from tamarack.plans.attack_window import attack_window, attack_windows
from tamarack.plans.cross_subsidy import cross_subsidy, segment_fraud
from tamarack.plans.money_mule import account_behaviour, money_mule
from tamarack.plans.pattern_evolution import (
    pattern_evolution,
    pattern_fingerprints,
    qualified_matches,
    standardised,
    year_offset_pairs,
)
from tamarack.plans.precrime_drift import clean_history, precrime_drift
from tamarack.plans.resource_efficiency import resource_efficiency
from tamarack.plans.response_lag import lag_cost, response_lag
from tamarack.plans.ring_contagion import contagion_speed, ring_contagion
from tamarack.plans.synthetic_identity import cohort_stats, identity_metrics, scored_identities, synthetic_identity
from tamarack.plans.yoy_evolution import yearly_metrics, yoy_changes, yoy_evolution
from tamarack.session import shared_folder, stored_in_turn
from tamarack.sources import files, schemas
from tamarack.sources.star import StarTables

Query = Callable[[SparkSession, str], DataFrame]

# the years in which the derived transactions lie
STAR_YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)

c = F.col


def _over_tables(build: Callable[[StarTables], DataFrame]) -> Query:
    return lambda spark, folder: build(StarTables(spark, folder))


# --- investigations -----------------------------------------------------------


def q01(t: StarTables) -> DataFrame:
    return resource_efficiency(t.transactions, t.fraud_pattern_rates)


def q02(t: StarTables) -> DataFrame:
    return yoy_evolution(t.transactions, STAR_YEARS)


def q03(t: StarTables) -> DataFrame:
    return synthetic_identity(t.account_profiles)


def q04(t: StarTables) -> DataFrame:
    return money_mule(t.transactions, t.accounts_with_fraud)


def q05(t: StarTables) -> DataFrame:
    return ring_contagion(t.transactions, t.network_edges)


def q06(t: StarTables) -> DataFrame:
    return cross_subsidy(t.transactions, t.accounts)


def q07(t: StarTables) -> DataFrame:
    return attack_window(t.transactions)


def q08(t: StarTables) -> DataFrame:
    return response_lag(t.transactions, t.network_edges)


def q09(t: StarTables) -> DataFrame:
    return precrime_drift(t.transactions)


def q10(t: StarTables) -> DataFrame:
    return pattern_evolution(t.transactions)


# --- sources, sinks, audit -----------------------------------------------------


def audit_constraints(t: StarTables) -> DataFrame:
    """The rules of the schema, and one that the line items are known to break: their two-part key repeats.

    Patterns are known by the parts, not by the transactions under test.
    """
    tx, accounts, edges, hourly, patterns = t.transactions, t.accounts, t.network_edges, t.time_series_stats, t.part_patterns
    return quality.audit(
        [
            quality.PrimaryKey("account_profiles.account_id is unique", accounts, "account_id"),
            quality.PrimaryKey("transactions.transaction_id is unique", tx, "transaction_id"),
            quality.PrimaryKey("time_series_stats.hour is unique", hourly, "hour"),
            quality.PrimaryKey("part.p_partkey is unique", patterns, "p_partkey"),
            quality.PrimaryKey("lineitem.line is unique", t.lines, "line"),
            quality.not_null("network_edges.account_a is present", edges, "account_a"),
            quality.not_null("network_edges.account_b is present", edges, "account_b"),
            quality.ForeignKey("transactions.account_id is known", tx, "account_id", accounts, "account_id"),
            quality.ForeignKey("network_edges.account_a is known", edges, "account_a", accounts, "account_id"),
            quality.ForeignKey("network_edges.account_b is known", edges, "account_b", accounts, "account_id"),
            quality.ForeignKey("transactions.fraud_pattern is known", tx, "fraud_pattern", patterns, "fraud_pattern"),
            quality.not_null("transactions.ts is present", tx, "ts"),
            quality.Check("transactions.hour_of_day is an hour", tx, "hour_of_day BETWEEN 0 AND 23"),
            quality.Check("transactions.day_of_week is a weekday", tx, "day_of_week BETWEEN 0 AND 6"),
            quality.Check("time_series_stats.hour_of_day is an hour", hourly, "hour_of_day BETWEEN 0 AND 23"),
            quality.Check("time_series_stats.day_of_week is a weekday", hourly, "day_of_week BETWEEN 0 AND 6"),
        ]
    )


def src_csv_roundtrip(t: StarTables) -> DataFrame:
    """Accounts with a note that is NULL, empty, quoted or broken into lines."""
    notes = F.expr(
        r"""CASE CAST(substring(account_id, 4) AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
            WHEN 2 THEN ' a "quoted", part ' ELSE 'line one\nline two' END"""
    )
    profile = derived.account_profile(t.transactions).withColumn("note", notes)
    folder = shared_folder(t.spark, "csv")
    files.write_result(profile, f"{folder}/accounts", "csv")
    return files.load_csv(t.spark, f"{folder}/accounts", profile.schema, f"{folder}/table", multi_line=True)


def src_csv_column_list(t: StarTables) -> DataFrame:
    """A file without some of the table's columns, with empty fields for NULL."""
    given = [n for n in schemas.TRANSACTIONS.names if n in t.transactions.columns]
    folder = shared_folder(t.spark, "csv")
    files.write_result(t.transactions.select(*given), f"{folder}/transactions", "csv")
    loaded = files.load_csv(t.spark, f"{folder}/transactions", schemas.TRANSACTIONS, f"{folder}/table", given)
    decimals = [f.name for f in schemas.TRANSACTIONS if f.dataType.typeName() == "decimal"]
    return loaded.withColumns({name: c(name).cast("double") for name in decimals})


def src_csv_inferred(t: StarTables) -> DataFrame:
    path = f"{shared_folder(t.spark, 'csv')}/evolution"
    files.write_result(q02(t), path, "csv")
    return files.load_csv_inferred(t.spark, path)


def src_json_array(t: StarTables) -> DataFrame:
    path = f"{shared_folder(t.spark, 'json')}/heatmap"
    files.write_json_array(results.heatmap_cells(t.time_series_stats), path, ["day", "hour"])
    return files.load_json(t.spark, path, schemas.HEATMAP)


def src_flags(t: StarTables) -> DataFrame:
    flags = ["is_weekend", "card_present", "device_known", "is_foreign_txn", "has_2fa", "is_fraud"]
    return files.normalise_flags(t.transactions, flags).groupBy(*flags).agg(F.count("*").alias("n"))


# --- filters and labels ---------------------------------------------------------


def fil_flag(t: StarTables) -> DataFrame:
    return filters.where_flag(filters.where_flag(t.transactions, "is_fraud"), "has_2fa", False).select(
        "transaction_id", "account_id"
    )


def fil_not_null(t: StarTables) -> DataFrame:
    return t.transactions.filter(c("fraud_pattern").isNotNull()).select("transaction_id", "fraud_pattern")


def fil_structuring_bands(t: StarTables) -> DataFrame:
    in_band = filters.in_bands(c("amount"), fv.STRUCTURING_BANDS)
    return t.transactions.filter(in_band).select("transaction_id", c("amount").cast("double").alias("amount"))


def fil_having_floor(t: StarTables) -> DataFrame:
    return attack_windows(t.transactions)


def fil_dimension(t: StarTables) -> DataFrame:
    return filters.dimension_filter(q10(t), "pattern_a", "pattern_3")


def fil_text_search(t: StarTables) -> DataFrame:
    return results.search_result(q04(t), "money_mule", "aCC00003")


def fil_equals_all(t: StarTables) -> DataFrame:
    wanted = {"drift_signals_positive": 3, "pre_crime_verdict": fv.NO_COLUMN_FILTER}
    return filters.equals_all(q09(t), wanted)


def prj_labels(t: StarTables) -> DataFrame:
    return t.transactions.select(
        "transaction_id",
        fn.time_window(c("hour_of_day")).alias("time_window"),
        fn.label_flag(c("is_weekend"), fv.WEEKEND, fv.WEEKDAY).alias("day_type"),
        fn.label_flag(c("is_foreign_txn"), fv.FOREIGN, fv.DOMESTIC).alias("txn_geography"),
        fn.label_flag(~c("has_2fa"), fv.NO_2FA, fv.HAS_2FA).alias("auth_strength"),
    )


def prj_interpret(t: StarTables) -> DataFrame:
    changes = yoy_changes(yearly_metrics(t.transactions))
    return changes.select(
        "fraud_pattern", "metric", "year", fn.interpret(c("metric"), c("pct_change")).alias("reading")
    )


# --- joins ------------------------------------------------------------------------


def join_dimension(t: StarTables) -> DataFrame:
    """Fraud rows beside their pattern's profile."""
    fraud = t.transactions.filter("is_fraud").select("transaction_id", "fraud_pattern")
    profile = t.fraud_pattern_rates.select("fraud_pattern", "avg_velocity_1h", "pct_foreign")
    return joins.divisible_join(fraud, profile, ["fraud_pattern"])


def join_accounts(t: StarTables) -> DataFrame:
    """Transactions beside their account."""
    accounts = t.accounts.select("account_id", "account_type", "home_country")
    return t.transactions.select("transaction_id", "account_id").join(accounts, "account_id")


def join_first_event(t: StarTables) -> DataFrame:
    return rings.ring_first_events(t.transactions, t.network_edges)


def join_ring_pairs(t: StarTables) -> DataFrame:
    return rings.ring_pairs(rings.ring_first_events(t.transactions, t.network_edges))


def join_later_events(t: StarTables) -> DataFrame:
    """Fraud of each other ring member after the ring's seed date."""
    marks = join_ring_pairs(t).select("account_id", c("seed_fraud_date").alias("ts"), "ring_id")
    fraud = t.transactions.filter("is_fraud").select("account_id", "ts", "amount", F.lit(1).alias("one"))
    after = timeline.totals_after(fraud, marks, "account_id", "ts", {"one": "later_txns", "amount": "later_loss"})
    return after.select("ring_id", "account_id", "later_txns", c("later_loss").cast("double").alias("later_loss"))


def join_cross_totals(t: StarTables) -> DataFrame:
    segments = segment_fraud(t.transactions, t.accounts)
    named = segments.select("account_type", "total_txns", c("fraud_loss").cast("decimal(28,2)").alias("loss"))
    return totals.with_totals(named, {"all_txns": F.sum("total_txns"), "all_loss": F.sum("loss")}).select(
        "account_type", "total_txns", "all_txns", c("all_loss").cast("double").alias("all_loss")
    )


def join_year_offset(t: StarTables) -> DataFrame:
    return year_offset_pairs(standardised(pattern_fingerprints(t.transactions)))


# --- aggregates ---------------------------------------------------------------------


def agg_conditional(t: StarTables) -> DataFrame:
    n = F.count("*")
    return t.transactions.groupBy("merchant_category").agg(
        n.alias("txns"),
        F.count("fraud_pattern").alias("patterned"),
        F.count_if("is_foreign_txn").alias("foreign_txns"),
        fn.sum_if(c("is_fraud"), c("amount")).cast("double").alias("fraud_loss"),
        fn.round_exact(fn.mean_if(c("is_fraud"), c("amount")), 2).alias("avg_fraud_amount"),
        fn.round_exact(fn.pct_true(~c("has_2fa")), 2).alias("pct_no_2fa"),
        fn.round_exact(fn.ratio_pct(F.count_if(c("hour_of_day") < 6), n), 1).alias("pct_night"),
    )


def agg_count_distinct_mix(t: StarTables) -> DataFrame:
    return t.transactions.groupBy("device_type").agg(
        F.count("*").alias("txns"),
        F.count_distinct("account_id").alias("accounts"),
        F.sum("amount").cast("double").alias("volume"),
        F.min("amount").cast("double").alias("least"),
        F.max("amount").cast("double").alias("most"),
    )


def agg_deviation(t: StarTables) -> DataFrame:
    metrics = list(fv.SYNTHETIC_WEIGHTS)
    stats = cohort_stats(identity_metrics(t.account_profiles), metrics)
    columns = [x for m in metrics for x in (f"mean_{m}", f"sd_{m}")]
    return stats.select("account_type", *[fn.round_exact(c(x), 6).alias(x) for x in columns])


def agg_median(t: StarTables) -> DataFrame:
    """Exact medians over all transactions, far more rows per group than fraud has."""
    return medians.exact_median(t.transactions, ["merchant_category"], "amount", "median_amount").withColumn(
        "median_amount", fn.round_exact(c("median_amount"), 3)
    )


def agg_listagg_ordered(t: StarTables) -> DataFrame:
    seen = t.transactions.filter("is_fraud").select("fraud_pattern", fn.year_of(c("ts")).alias("year")).distinct()
    years = F.expr("listagg(CAST(year AS STRING), ', ') WITHIN GROUP (ORDER BY year)")
    return seen.groupBy("fraud_pattern").agg(years.alias("years"))


def agg_global(t: StarTables) -> DataFrame:
    return t.transactions.agg(
        F.count("*").alias("txns"),
        F.count_if("is_fraud").alias("frauds"),
        F.sum("amount").cast("double").alias("volume"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def agg_distinct(t: StarTables) -> DataFrame:
    return t.transactions.select("account_id", "device_type").distinct()


# --- windows ---------------------------------------------------------------------------


def win_share_of_total(t: StarTables) -> DataFrame:
    per_account = t.transactions.groupBy("account_id").agg(F.sum("amount").alias("volume"))
    shared = totals.share_of_total(per_account, "volume", "volume_share_pct", 6)
    return shared.withColumn("volume", c("volume").cast("double"))


def win_previous_value(t: StarTables) -> DataFrame:
    return yoy_changes(yearly_metrics(t.transactions))


def win_first_per_group(t: StarTables) -> DataFrame:
    return rings.ring_seeds(rings.ring_first_events(t.transactions, t.network_edges))


def win_sequence(t: StarTables) -> DataFrame:
    rows = t.transactions.select("account_id", "transaction_id", "ts", "amount")
    numbered = sequences.sequence(rows, "account_id", "ts", "transaction_id")
    phase = sequences.half_split(c("rn"), c("group_rows"))
    return numbered.groupBy("account_id", phase.alias("phase"), "group_rows").agg(
        F.count("*").alias("txns"), F.max("rn").alias("last_rn"), F.sum("amount").cast("double").alias("volume")
    )


def win_clean_history(t: StarTables) -> DataFrame:
    return clean_history(t.transactions).select("account_id", "transaction_id", "rn", "group_rows")


def win_rank_global(t: StarTables) -> DataFrame:
    windows = attack_windows(t.transactions, min_txns=1)
    return ranking.rank_global(windows, "fraud_success_rate_pct", "risk_rank").select(
        "time_window", "day_type", "device_type", "txn_geography", "auth_strength", "merchant_category",
        "fraud_success_rate_pct", "risk_rank",
    )


def win_rank_in_group(t: StarTables) -> DataFrame:
    rank = ranking.rank_in_group(["pattern_b", "year_b"], "behavioural_distance")
    cohort = Window.partitionBy("pattern_b", "year_b")
    return join_year_offset(t).withColumns(
        {
            "nearness": rank,
            "cohort_median": fn.round_exact(F.percentile("behavioural_distance", F.lit(0.5)).over(cohort), 4),
        }
    )


# --- sorting, sets, reshaping -------------------------------------------------------------


def srt_custom_order(t: StarTables) -> DataFrame:
    rows = reshape.unpivot_metrics(yearly_metrics(t.transactions), ["fraud_pattern", "year"], fv.YOY_METRICS)
    position = ranking.custom_order(c("metric"), fv.YOY_METRICS)
    return rows.withColumn("position", position).orderBy("position", "fraud_pattern", "year")


def srt_top_k(t: StarTables) -> DataFrame:
    rows = t.transactions.select("transaction_id", c("amount").cast("double").alias("amount"))
    return ranking.top_k(rows, [("amount", "desc"), ("transaction_id",)], fv.WINDOW_TOP)


def srt_page(t: StarTables) -> DataFrame:
    accounts = t.accounts.select("account_id", c("credit_limit").cast("double").alias("credit_limit"))
    return ranking.page(accounts, [("credit_limit", "desc"), ("account_id",)], number=3)


def srt_page_deep(t: StarTables) -> DataFrame:
    """The last page."""
    accounts = t.accounts.select("account_id", c("credit_limit").cast("double").alias("credit_limit"))
    keys = [("credit_limit", "desc"), ("account_id",)]
    return ranking.page(accounts, keys, number=10**9)


def srt_table_view(t: StarTables) -> DataFrame:
    wanted = {"synthetic_id_verdict": fv.SYNTHETIC_OK}
    return results.result_page(
        scored_identities(t.account_profiles), "synthetic_identity", "acc", wanted, ("synthetic_id_suspicion_score", "desc"), 1
    )


def srt_table_view_text(t: StarTables) -> DataFrame:
    """Sorted by a text column."""
    return results.result_page(
        scored_identities(t.account_profiles), "synthetic_identity", "", {}, ("account_type", "desc"), 2
    )


def set_union_all_nulls(t: StarTables) -> DataFrame:
    base = identity_metrics(t.account_profiles).select("account_id", "account_age_days", "countries_per_year")
    mature = base.filter(c("account_age_days") >= fv.MIN_AGE_DAYS)
    return reshape.union_all_nulls(mature, base.filter(c("account_age_days") < fv.MIN_AGE_DAYS).drop("countries_per_year"))


def set_union_distinct(t: StarTables) -> DataFrame:
    edges = t.network_edges.filter("both_fraud")
    return reshape.union_distinct(
        edges.select("ring_id", c("account_a").alias("account_id")),
        edges.select("ring_id", c("account_b").alias("account_id")),
    )


def set_ring_members(t: StarTables) -> DataFrame:
    return rings.ring_members(t.network_edges)


def set_unpivot(t: StarTables) -> DataFrame:
    return reshape.unpivot_metrics(yearly_metrics(t.transactions), ["fraud_pattern", "year"], fv.YOY_METRICS)


def set_pivot_years(t: StarTables) -> DataFrame:
    rows = reshape.unpivot_metrics(yearly_metrics(t.transactions), ["fraud_pattern", "year"], fv.YOY_METRICS)
    return rows.groupBy("fraud_pattern", "metric").agg(*reshape.pivot_years(c("value"), c("year"), STAR_YEARS))


# --- scalar functions -------------------------------------------------------------------------


def _identity_zscores(t: StarTables) -> tuple[DataFrame, dict]:
    metrics = list(fv.SYNTHETIC_WEIGHTS)
    mature = identity_metrics(t.account_profiles).filter(c("account_age_days") >= fv.MIN_AGE_DAYS)
    beside = joins.divisible_join(mature, cohort_stats(mature, metrics), ["account_type"])
    return beside, {m: fn.zscore(c(m), c(f"mean_{m}"), c(f"sd_{m}")) for m in metrics}


def sca_zscore(t: StarTables) -> DataFrame:
    rows, zs = _identity_zscores(t)
    return rows.select("account_id", *[fn.round_exact(z, 4).alias(f"z_{m}") for m, z in zs.items()])


def sca_clip(t: StarTables) -> DataFrame:
    rows, zs = _identity_zscores(t)
    return rows.select("account_id", *[fn.round_exact(fn.clip(z, 0, fv.Z_CLIP), 4).alias(m) for m, z in zs.items()])


def sca_ratios(t: StarTables) -> DataFrame:
    return identity_metrics(t.account_profiles)


def sca_capped_points(t: StarTables) -> DataFrame:
    points = {n: fn.round_exact(fn.capped(c(n), *rule), 2).alias(f"points_{n}") for n, rule in fv.MULE_RULES.items()}
    return account_behaviour(t.transactions).select("account_id", *points.values())


def sca_days_between(t: StarTables) -> DataFrame:
    days = fn.days_between(c("seed_fraud_date"), c("first_fraud_date"))
    deadline = fn.plus_days(c("seed_fraud_date"), fv.RESPONSE_WINDOW_DAYS)
    return join_ring_pairs(t).select(
        "ring_id", "account_id", fn.round_exact(days, 5).alias("days"), deadline.alias("deadline"),
        F.to_date("first_fraud_date").alias("first_day"),
    )


def sca_title_case(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select("doc_id", fn.title_case(c("text")).alias("titled"))


def sca_strip_pictographs(t: StarTables) -> DataFrame:
    return q03(t).select("account_id", fn.strip_pictographs(c("synthetic_id_verdict")).alias("label"))


def sca_verdict_tier(t: StarTables) -> DataFrame:
    """Tiers of all verdicts, and of the priorities written without a mark.

    Verdicts are counted per investigation, which rids each of its final sort. The two that shuffle most are counted
    before the others, the drift of one share of the accounts after another, so that little of it is on disk at once.
    """
    t = t.with_stored_transactions()

    def counted(result: DataFrame, column: str) -> DataFrame:
        return result.groupBy(c(column).alias("verdict")).agg(F.count("*").alias("n"))

    def first() -> Iterator[DataFrame]:
        yield counted(q03(t), "synthetic_id_verdict")
        for part in t.shares_of_accounts():
            yield counted(q09(part), "pre_crime_verdict")

    priorities = counted(q05(t), "response_priority")
    sources = [
        stored_in_turn(first(), "verdicts"),
        counted(q01(t), "control_efficiency_verdict"),
        counted(q04(t), "aml_verdict"),
        priorities.select(F.explode(F.array("verdict", fn.strip_pictographs(c("verdict")))).alias("verdict"), "n"),
        counted(q06(t), "cross_subsidy_verdict"),
        counted(q07(t), "sample_reliability"),
        counted(q10(t), "signal_strength_verdict"),
    ]
    verdicts = reduce(lambda a, b: a.unionByName(b), sources).groupBy("verdict").agg(F.sum("n").alias("n"))
    return verdicts.withColumn("tier", fn.verdict_tier(c("verdict")))


# --- summaries ----------------------------------------------------------------------------------


def _portfolio(t: StarTables, pattern: str = fv.NO_FILTER) -> DataFrame:
    """Contagion and lag cost read the same members."""
    members = rings.ring_first_events(t.transactions, t.network_edges)
    return results.portfolio_kpis(q01(t), contagion_speed(members), lag_cost(members, t.transactions), pattern)


def res_heatmap(t: StarTables) -> DataFrame:
    return results.heatmap(t.time_series_stats)


def queries() -> dict[str, Query]:
    over_tables: dict[str, Callable[[StarTables], DataFrame]] = {
        "q01_resource_efficiency": q01,
        "q02_yoy_evolution": q02,
        "q03_synthetic_identity": q03,
        "q04_money_mule": q04,
        "q05_ring_contagion": q05,
        "q06_cross_subsidy": q06,
        "q07_attack_window": q07,
        "q08_response_lag": q08,
        "q09_precrime_drift": q09,
        "q10_pattern_evolution": q10,
        "der_pattern_profile": lambda t: t.fraud_patterns,
        "der_hourly_rollup": lambda t: t.time_series_stats,
        "der_account_profile": lambda t: derived.account_profile(t.transactions),
        "audit_constraints": audit_constraints,
        "src_csv_roundtrip": src_csv_roundtrip,
        "src_csv_column_list": src_csv_column_list,
        "src_csv_inferred": src_csv_inferred,
        "src_json_array": src_json_array,
        "src_flags": src_flags,
        "fil_flag": fil_flag,
        "fil_not_null": fil_not_null,
        "fil_structuring_bands": fil_structuring_bands,
        "fil_having_floor": fil_having_floor,
        "fil_dimension": fil_dimension,
        "fil_text_search": fil_text_search,
        "fil_equals_all": fil_equals_all,
        "prj_labels": prj_labels,
        "prj_interpret": prj_interpret,
        "join_dimension": join_dimension,
        "join_accounts": join_accounts,
        "join_first_event": join_first_event,
        "join_ring_pairs": join_ring_pairs,
        "join_later_events": join_later_events,
        "join_cross_totals": join_cross_totals,
        "join_year_offset": join_year_offset,
        "agg_conditional": agg_conditional,
        "agg_count_distinct_mix": agg_count_distinct_mix,
        "agg_deviation": agg_deviation,
        "agg_median": agg_median,
        "agg_listagg_ordered": agg_listagg_ordered,
        "agg_global": agg_global,
        "agg_distinct": agg_distinct,
        "win_share_of_total": win_share_of_total,
        "win_previous_value": win_previous_value,
        "win_first_per_group": win_first_per_group,
        "win_sequence": win_sequence,
        "win_clean_history": win_clean_history,
        "win_rank_global": win_rank_global,
        "win_rank_in_group": win_rank_in_group,
        "srt_custom_order": srt_custom_order,
        "srt_top_k": srt_top_k,
        "srt_page": srt_page,
        "srt_page_deep": srt_page_deep,
        "srt_table_view": srt_table_view,
        "srt_table_view_text": srt_table_view_text,
        "set_union_all_nulls": set_union_all_nulls,
        "set_union_distinct": set_union_distinct,
        "set_ring_members": set_ring_members,
        "set_unpivot": set_unpivot,
        "set_pivot_years": set_pivot_years,
        "sca_zscore": sca_zscore,
        "sca_clip": sca_clip,
        "sca_ratios": sca_ratios,
        "sca_capped_points": sca_capped_points,
        "sca_days_between": sca_days_between,
        "sca_strip_pictographs": sca_strip_pictographs,
        "sca_verdict_tier": sca_verdict_tier,
        "res_portfolio_kpis": _portfolio,
        "res_portfolio_kpis_filtered": lambda t: _portfolio(t, "pattern_2"),
        "res_loss_share": lambda t: results.loss_share(q01(t)),
        "res_heatmap": res_heatmap,
        "res_metric_trend": lambda t: results.metric_trend(q02(t), "avg_ip_risk", STAR_YEARS),
        "res_metric_names": lambda t: results.metric_names(q02(t)),
        "res_verdicts_identity": lambda t: results.verdict_distribution(q03(t), "synthetic_id_verdict"),
        "res_verdicts_mule": lambda t: results.verdict_distribution(q04(t), "aml_verdict"),
        "res_verdicts_rings": lambda t: results.verdict_distribution(q05(t), "response_priority"),
        "res_precision": lambda t: results.precision_kpis(q03(t)),
        "res_score_histogram": lambda t: results.score_histogram(q03(t)),
        "res_mule_kpis": lambda t: results.mule_kpis(q04(t)),
        "res_mule_by_type": lambda t: results.mule_by_type(q04(t)),
        "res_ring_kpis": lambda t: results.ring_kpis(q05(t)),
        "res_ring_points": lambda t: results.ring_points(q05(t)),
        "res_lag_kpis": lambda t: results.lag_kpis(q08(t)),
        "res_top_rings": lambda t: results.top_rings(q08(t)),
        "res_drift_kpis": lambda t: results.drift_kpis(q09(t)),
        "res_drift_histogram": lambda t: results.drift_histogram(q09(t)),
        "res_drift_points": lambda t: results.drift_points(q09(t)),
        "res_predecessor_totals": lambda t: results.predecessor_totals(q10(t)),
        "res_transition_points": lambda t: results.transition_points(q10(t)),
    }
    return {**{name: _over_tables(build) for name, build in over_tables.items()}, "sca_title_case": sca_title_case}
