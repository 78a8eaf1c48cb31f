"""The investigations on hand-made tables that sit on their boundaries."""

import datetime as dt
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack import registry, session
from tamarack.plans import results
from tamarack.plans.attack_window import attack_window
from tamarack.plans.cross_subsidy import cross_subsidy, price_segments
from tamarack.plans.derived import hourly_rollup, pattern_profile
from tamarack.plans.money_mule import money_mule
from tamarack.plans.pattern_evolution import judge_matches, pattern_evolution, qualified_matches
from tamarack.plans.precrime_drift import precrime_drift
from tamarack.plans.resource_efficiency import classify_efficiency, resource_efficiency
from tamarack.plans.response_lag import response_lag
from tamarack.plans.ring_contagion import ring_contagion
from tamarack.plans.synthetic_identity import synthetic_identity
from tamarack.plans.yoy_evolution import summarise_evolution, yoy_evolution
from tamarack.sources.star import SHARES, StarTables
from tests import frames


def by(df, key):
    return {r[key]: r for r in df.collect()}


def fraud(account="A", **more):
    return {"account_id": account, "is_fraud": True, "fraud_pattern": "p", **more}


# --- Q1 ---


def test_efficiency_of_published_shares(spark):
    # fixed values: volume share, loss share, gap per pattern
    published = [
        ("account_takeover", 20.02, 32.99, 12.97),
        ("identity_theft", 3.83, 6.10, 2.27),
        ("card_not_present", 34.89, 36.89, 2.00),
        ("atm_fraud", 7.09, 4.53, -2.56),
        ("card_present_stolen", 18.20, 13.88, -4.32),
        ("money_laundering", 5.90, 0.76, -5.14),
        ("friendly_fraud", 10.07, 4.86, -5.21),
    ]
    shares = spark.createDataFrame(
        [p[:3] for p in published], "fraud_pattern string, share_of_fraud_volume double, share_of_fraud_loss double"
    )
    found = by(classify_efficiency(shares), "fraud_pattern")
    assert {k: r.resource_efficiency_gap for k, r in found.items()} == {p[0]: p[3] for p in published}
    verdicts = {k: r.control_efficiency_verdict for k, r in found.items()}
    assert verdicts["account_takeover"] == fv.UNDER_POLICED
    assert verdicts["money_laundering"] == verdicts["friendly_fraud"] == fv.OVER_POLICED
    assert [v for v in verdicts.values()].count(fv.BALANCED) == 4


def test_efficiency_of_published_totals(spark):
    """Shares, averages and gaps follow from the published counts and losses."""
    # fixed values: transactions, loss, average, volume share, loss share
    published = {
        "account_takeover": (3432, "4129144.46", 1203.13, 20.02, 32.99),
        "identity_theft": (656, "763253.67", 1163.50, 3.83, 6.10),
        "card_not_present": (5982, "4616806.56", 771.78, 34.89, 36.89),
        "atm_fraud": (1216, "566971.58", 466.26, 7.09, 4.53),
        "card_present_stolen": (3120, "1737328.15", 556.84, 18.20, 13.88),
        "money_laundering": (1011, "94619.32", 93.59, 5.90, 0.76),
        "friendly_fraud": (1726, "608610.35", 352.61, 10.07, 4.86),
    }
    rows = []
    for pattern, (n, loss, *_) in published.items():
        cents = int(loss.replace(".", ""))
        rows += [(pattern, cents - (n - 1) * (cents // n) if i == 0 else cents // n) for i in range(n)]
    tx = spark.createDataFrame(rows, "fraud_pattern string, cents bigint").selectExpr(
        "fraud_pattern", "CAST(cents / 100 AS DECIMAL(12,2)) AS amount", "true AS is_fraud"
    )
    patterns = spark.createDataFrame(
        [(p, 3.95, 74.0, 58.0) for p in published],
        "fraud_pattern string, avg_velocity_1h double, pct_card_not_present double, pct_foreign double",
    )
    found = by(resource_efficiency(tx, patterns), "fraud_pattern")
    for p, (n, loss, average, volume_share, loss_share) in published.items():
        r = found[p]
        assert (r.total_fraud_txns, r.total_loss, r.avg_loss_per_attack) == (n, float(loss), average)
        assert (r.share_of_fraud_volume, r.share_of_fraud_loss) == (volume_share, loss_share)


def test_efficiency_drops_unknown_patterns(spark):
    tx = frames.transactions(spark, [fraud(), fraud(fraud_pattern=None), fraud(fraud_pattern="q"), {"fraud_pattern": "p"}])
    patterns = pattern_profile(tx.filter("fraud_pattern = 'p'"))
    rows = resource_efficiency(tx, patterns).collect()
    assert [(r.fraud_pattern, r.total_fraud_txns, r.share_of_fraud_volume) for r in rows] == [("p", 1, 100.0)]


# --- Q2 ---


def test_evolution_of_published_metrics(spark):
    # fixed values: metric -> yearly values, average change
    published = {
        "attacks": (1151, 1077, 1204, 2.7),
        "avg_attack_size": (1277.03, 1147.13, 1182.57, -3.6),
        "avg_velocity": (3.98, 3.94, 3.97, -0.1),
        "avg_ip_risk": (56.14, 56.00, 55.56, -0.5),
        "behavioural_disguise_score": (22.195, 21.593, 22.081, -0.2),
        "pct_bypassing_2fa": (57.8, 57.6, 59.4, 1.4),
        "pct_using_known_device": (47.4, 40.9, 41.7, -5.9),
    }
    yearly = spark.createDataFrame(
        [("p", 2022 + i, *[float(v[i]) for v in published.values()]) for i in range(3)],
        "fraud_pattern string, year int, " + ", ".join(f"{m} double" for m in published),
    )
    rows = summarise_evolution(yearly).collect()
    assert [r.metric for r in rows] == list(published)
    for r in rows:
        *values, change = published[r.metric]
        assert [r.y_2022, r.y_2023, r.y_2024] == values and r.avg_pct_change == pytest.approx(change, abs=0.11)
        assert r.business_interpretation == fv.READINGS[r.metric][0 if change > 0 else 1]
        assert r.avg_change_trend == (fv.TREND_UP if change > 0 else fv.TREND_DOWN)


def test_evolution_compares_with_the_last_year_present(spark):
    rows = [fraud(ts=frames.after(0), velocity_1h=0, has_2fa=None)]
    rows += [fraud(ts=frames.after(731), velocity_1h=3) for _ in range(3)]
    rows += [fraud(ts=frames.after(0), fraud_pattern=None), fraud(ts=frames.after(0), fraud_pattern="once")]
    found = {(r.fraud_pattern, r.metric): r for r in yoy_evolution(frames.transactions(spark, rows)).collect()}
    attacks = found["p", "attacks"]
    assert (attacks.y_2022, attacks.y_2023, attacks.y_2024, attacks.avg_pct_change) == (1.0, None, 3.0, 200.0)
    assert found["p", "avg_velocity"].avg_pct_change is None  # from zero
    assert found["p", "pct_bypassing_2fa"].y_2022 == 0.0
    once = found["once", "attacks"]
    assert once.avg_change_trend == "Not enough data" and len(found) == 14


# --- Q3 ---


def account(i, kind="x", age=400, **more):
    base = {
        "account_id": f"A{i:03d}", "account_type": kind, "home_country": "US", "account_age_days": age,
        "credit_limit": "1000", "avg_txn_amount": "100", "avg_monthly_txns": "10", "unique_countries": 2,
        "unique_categories": 3, "avg_ip_risk": "20", "pct_foreign": "0.1", "avg_velocity": "1", "is_fraudster": 0,
    }
    return {**base, **more}


def test_identity_scores(spark):
    outlier = {"unique_countries": 90, "unique_categories": 40, "pct_foreign": "0.9", "avg_ip_risk": "95",
               "avg_velocity": "9", "avg_txn_amount": "900"}
    rows = [account(i) for i in range(20)] + [account(20, **outlier)]
    rows += [account(21, "lonely"), account(22, age=None), account(23, age=0), account(24, age=29), account(25, age=30)]
    rows += [account(26, None), account(27, None, age=3), account(28, avg_monthly_txns=0, credit_limit=0)]
    found = by(synthetic_identity(frames.accounts(spark, rows)), "account_id")
    assert found["A020"].synthetic_id_suspicion_score == 100.0
    assert found["A020"].synthetic_id_verdict == fv.SYNTHETIC_CUTS[0][1]
    assert found["A021"].synthetic_id_suspicion_score == 0.0  # deviation unknown
    assert found["A000"].synthetic_id_verdict == fv.SYNTHETIC_OK
    assert "A022" not in found and "A026" not in found  # no age; mature without a cohort
    for young in ("A023", "A024", "A027"):
        assert found[young].synthetic_id_suspicion_score is None
        assert found[young].synthetic_id_verdict == fv.SYNTHETIC_IMMATURE
    assert found["A023"].countries_per_year is None and found["A025"].synthetic_id_suspicion_score is not None
    assert found["A028"].category_diversity_ratio is None and found["A028"].avg_credit_utilization_pct is None
    assert all(0 <= r.synthetic_id_suspicion_score <= 100 for r in found.values() if r.synthetic_id_suspicion_score is not None)

    histogram = by(results.score_histogram(synthetic_identity(frames.accounts(spark, rows))), "bin_start")
    assert histogram[90].legitimate == 1 and len(histogram) == 10  # the score of 100 has a bin
    scored = sum(r.legitimate for r in histogram.values())
    unscored = results.score_histogram(synthetic_identity(frames.accounts(spark, rows)), include_unscored=True)
    assert sum(r.legitimate for r in unscored.collect()) == scored + 3


# --- Q4 ---


def test_mule_scores(spark):
    tx = [{"account_id": "foreign11", "is_foreign_txn": True, "velocity_1h": 0} for _ in range(11)]
    tx += [{"account_id": "foreign10", "is_foreign_txn": True, "velocity_1h": 0} for _ in range(10)]
    tx += [{"account_id": "burst", "velocity_1h": 9, "amount": "990.00"}]
    tx += [{"account_id": "calm", "velocity_1h": 8, "amount": "989.99"}]
    tx += [{"account_id": "night", "hour_of_day": h, "velocity_1h": 0} for h in (0, 1, 2, 3, 5, 6, 12, 12, 12, 23)]
    tx += [{"account_id": "night40", "hour_of_day": h, "velocity_1h": 0} for h in (0, 5, 6, 7, None)]
    tx += [{"account_id": "unknown", "velocity_1h": None, "amount": "999.00"}, {"account_id": "stranger", "velocity_1h": 9}]
    ids = {t["account_id"] for t in tx} - {"stranger"}
    people = frames.accounts(spark, [{"account_id": a, "risk_score": 5, "is_fraudster": 0} for a in ids])
    found = by(money_mule(frames.transactions(spark, tx), people, min_score=-1), "account_id")
    scores = {a: r.mule_suspicion_score for a, r in found.items()}
    assert scores == {"foreign11": 30.0, "foreign10": 30.0, "burst": 45.0, "calm": 24.0, "night": 25.0, "night40": 24.0}
    assert found["burst"].aml_verdict == fv.MULE_BURST and found["calm"].aml_verdict == fv.MULE_NORMAL
    assert found["burst"].structuring_txn_count == 1 and found["calm"].structuring_txn_count == 0
    kept = money_mule(frames.transactions(spark, tx), people, min_score=24).collect()
    assert {r.account_id for r in kept} == {"foreign11", "foreign10", "burst", "night"}  # 24 is not above 24


# --- Q5, Q8 ---


def ring_tables(spark):
    tx = [
        fraud("A", ts=frames.after(0)), fraud("B", ts=frames.after(0)),  # same first date: A is the seed
        fraud("C", ts=frames.after(4, hours=1, minutes=12)),  # 4.05 days
        fraud("C", ts=frames.after(5), amount="20"), fraud("C", ts=frames.after(5, microseconds=1), amount="40"),
        fraud("B", ts=frames.after(0, microseconds=1), amount="80"),
        fraud("D", ts=frames.after(60)), fraud("E", ts=frames.after(1)),
        fraud("A", ts=frames.after(70), amount="1000"),
    ]
    # C is in two rings; LONE has one dated member; a ring without a name is none
    pairs = [("A", "B", "R1"), ("A", "C", "R1"), ("C", "D", "R2"), ("E", "Z", "LONE"), ("A", "D", None), ("A", "E", "R1", False)]
    return frames.transactions(spark, tx), frames.edges(spark, pairs)


def test_contagion(spark):
    found = by(ring_contagion(*ring_tables(spark)), "ring_id")
    assert set(found) == {"R1", "R2"}
    one, two = found["R1"], found["R2"]
    assert (one.seed_account, one.connected_accounts) == ("A", 2)
    assert (one.first_replication_speed_days, one.quarantine_window_days, one.avg_days_to_spread) == (0.0, 4.1, 2.0)
    assert one.response_priority == fv.RESPONSE_CUTS[0][1]
    assert two.seed_account == "C" and two.first_replication_speed_days == 56.0  # 55.95
    assert two.response_priority == fv.RESPONSE_STANDARD and two.first_infected_date == two.last_infected_date


def test_response_lag(spark):
    found = by(response_lag(*ring_tables(spark)), "ring_id")
    one, two = found["R1"], found["R2"]
    # B's fraud at the seed instant does not count, the one just after does; day 5 is within, a moment later is not
    assert (one.downstream_accounts_activated, one.downstream_fraud_txns) == (2, 4)
    assert one.preventable_loss_usd == 80 + 10 + 20 + 40
    assert one.loss_within_5day_response_window == 110 and one.loss_after_response_window_missed == 40
    assert (two.downstream_fraud_txns, two.loss_within_5day_response_window) == (1, 0.0) and "LONE" not in found


# --- Q6 ---


def test_subsidy_of_published_segments(spark):
    # fixed values: accounts, transactions, fraud transactions, loss, risk -> cost per account, tax, gap, effect
    published = {
        "premium": ((4944, 99422, 1618, 1105843.31, 20.02), (1.63, 8.83, 223.67, 11.1227, 1.3940, 138594.27)),
        "business": ((9972, 197218, 3463, 2415375.91, 19.85), (1.76, 19.30, 242.22, 12.2472, 0.2695, 53150.25)),
        "personal": ((34987, 703360, 12062, 8995514.87, 19.88), (1.71, 71.87, 257.11, 12.7893, -0.2726, -191735.94)),
    }
    segments = spark.createDataFrame(
        [(k, *given) for k, (given, _) in published.items()],
        "account_type string, total_accounts long, total_txns long, fraud_txns long, fraud_loss double, avg_risk_score double",
    )
    totals = {"grand_total_fraud_loss": F.lit("12516734.09").cast("decimal(28,2)"), "grand_total_txns": F.lit(1_000_000)}
    found = by(price_segments(segments.withColumns(totals)), "account_type")
    for kind, (_, expected) in published.items():
        r = found[kind]
        assert r.blended_portfolio_fraud_tax_per_txn == 12.5167
        assert expected == (
            r.fraud_rate_pct, r.share_of_total_fraud_loss, r.fraud_cost_per_account, r.implied_fraud_tax_per_txn,
            r.subsidy_gap_per_txn, r.net_dollar_subsidy_effect,
        )
    assert found["premium"].cross_subsidy_verdict == found["business"].cross_subsidy_verdict == fv.SUBSIDISING
    assert found["personal"].cross_subsidy_verdict == fv.FAIRLY_PRICED


def test_subsidy_averages_are_weighted_by_transactions(spark):
    people = frames.accounts(
        spark,
        [{"account_id": a, "account_type": "x", "risk_score": s, "credit_limit": 1} for a, s in (("A", 10), ("B", 40), ("C", 99))],
    )
    tx = frames.transactions(spark, [{"account_id": "A"}] * 3 + [fraud("B", amount="8")] + [{"account_id": "gone"}])
    (row,) = cross_subsidy(tx, people).collect()
    assert (row.total_accounts, row.total_txns, row.avg_risk_score, row.fraud_cost_per_account) == (2, 4, 17.5, 4.0)


# --- Q7 ---


def test_attack_windows(spark):
    def group(category, n, frauds, **more):
        return [{"account_id": "A", "merchant_category": category, "is_fraud": i < frauds, **more} for i in range(n)]

    rows = group("c199", 199, 199) + group("c200", 200, 20) + group("c500", 500, 50) + group("none", 200, 0)
    rows += group("dark", 200, 20, has_2fa=None, is_weekend=None, hour_of_day=None)
    tx = frames.transactions(spark, rows)
    found = attack_window(tx).collect()
    # equal rates share a rank; more transactions come first, then the earlier name of the time window
    assert [(r.risk_rank, r.merchant_category) for r in found] == [(1, "c500"), (1, "c200"), (1, "dark"), (4, "none")]
    named = {r.merchant_category: r for r in found}
    assert named["c500"].sample_reliability == "🔴High confidence"
    assert named["c200"].sample_reliability == "🟠Moderate confidence"
    assert (named["dark"].time_window, named["dark"].day_type, named["dark"].auth_strength) == (
        "Evening (18-23h)", "Weekday", "Has 2FA",
    )
    assert named["none"].avg_fraud_amount is None and named["none"].total_fraud_loss == 0.0
    assert attack_window(tx, min_txns=1, top=1).collect()[0].sample_reliability == "🟢Low confidence"


# --- Q9 ---


def test_drift(spark):
    rows = []
    for name, n in (("nine", 9), ("ten", 10), ("eleven", 11)):
        # equal times: the transaction id decides
        rows += [{"account_id": name, "velocity_1h": 1 if i < n // 2 else 3, "is_foreign_txn": i == n - 1} for i in range(n)]
        rows += [fraud(name, ts=frames.after(1)), {"account_id": name, "ts": frames.after(2), "velocity_1h": 99}]
    rows += [{"account_id": "clean"}] * 12
    found = by(precrime_drift(frames.transactions(spark, rows)), "account_id")
    assert set(found) == {"ten", "eleven"}
    assert found["ten"].velocity_drift == 2.0 and found["ten"].foreign_pct_drift == 20.0
    assert found["eleven"].velocity_drift == 2.0 and found["eleven"].foreign_pct_drift == 16.67
    assert found["ten"].drift_signals_positive == 2 and found["ten"].pre_crime_verdict == fv.DRIFT_NONE


# --- Q10 ---


def test_only_the_nearest_below_the_median_qualifies(spark):
    pairs = spark.createDataFrame(
        [
            ("a", 1, "x", 2, 1.0), ("b", 1, "x", 2, 1.0), ("c", 1, "x", 2, 5.0), ("d", 1, "x", 2, 9.0),  # two share rank 1
            ("a", 1, "y", 2, 3.0), ("b", 1, "y", 2, 3.0),  # all equal: none below the median
            ("a", 2, "x", 3, 0.5), ("b", 2, "x", 3, 0.7), ("c", 2, "x", 3, None),
        ],
        "pattern_a string, year_a int, pattern_b string, year_b int, behavioural_distance double",
    )
    rows = judge_matches(qualified_matches(pairs)).collect()
    assert [(r.pattern_a, r.year_b, r.times_flagged_as_predecessor, r.years_flagged) for r in rows] == [
        ("a", 2, 2, "2, 3"), ("a", 3, 2, "2, 3"), ("b", 2, 1, "2"),
    ]
    assert [r.signal_strength_verdict for r in rows] == [fv.REPEAT_DONOR, fv.REPEAT_DONOR, fv.SINGLE_MATCH]
    assert rows[0].median_distance_in_cohort == 3.0


def test_evolution_without_spread_has_no_matches(spark):
    tx = frames.transactions(spark, [fraud(fraud_pattern=p, ts=frames.after(d)) for p in "abc" for d in (0, 365)])
    assert pattern_evolution(tx).collect() == []


# --- derived tables and summaries ---


def test_hourly_rollup_counts_monday_as_day_zero(spark):
    (row,) = hourly_rollup(frames.transactions(spark, [fraud(), {"is_fraud": None}])).collect()
    assert (row.transaction_count, row.fraud_count, row.fraud_rate, row.day_of_week) == (2, 1, 0.5, 1)  # a Tuesday
    cells = by(results.heatmap(hourly_rollup(frames.transactions(spark, [fraud()]))).filter("txn > 0"), "day")
    assert cells[1].hour == 12 and cells[1].rate == 100.0 and cells[1].intensity == 1.0


def test_summaries_of_empty_results(spark):
    lag = spark.createDataFrame(
        [],
        "ring_id string, preventable_loss_usd double, loss_within_5day_response_window double,"
        " loss_after_response_window_missed double",
    )
    (row,) = results.lag_kpis(lag).collect()
    assert (row.rings, row.preventable, row.within_pct, row.avg_per_ring) == (0, 0.0, None, None)


def test_missing_scores_count_as_zero(spark):
    identity = spark.createDataFrame(
        [(80.0, fv.SYNTHETIC_CUTS[0][1], 1), (10.0, fv.SYNTHETIC_OK, 0), (None, fv.SYNTHETIC_IMMATURE, 0)],
        "synthetic_id_suspicion_score double, synthetic_id_verdict string, is_fraudster int",
    )
    (row,) = results.precision_kpis(identity).collect()
    assert (row.accounts, row.flagged, row.flagged_pct, row.precision_pct, row.avg_score) == (3, 2, 66.7, 50.0, 30.0)


def test_the_verdict_query_joins_its_transactions_once(spark, small):
    """Eight investigations read one stored table; none goes back to the line items, and only the top windows are sorted."""
    plan = registry.queries()["sca_verdict_tier"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and plan.count("Sort [") == 1


def test_the_verdict_query_counts_what_shuffles_most_beforehand(spark, small):
    """Identities and drift are counted before the query runs; their shuffles are gone by then."""
    plan = registry.queries()["sca_verdict_tier"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "first_fraud_ts" not in plan and "synthetic_id" not in plan


def test_stored_transactions_hold_every_row_in_one_share(spark, tmp_path):
    """Keys that are NULL or come twice, on either side of the joins; an order without customer is a share's as well."""
    at = dt.datetime(1996, 3, 2)
    lines = [(o, 1 + o % 3, o % 5, n, 7.0, 10.5, "A", at) for o in range(60) for n in (1, 2)]
    lines += [lines[0], lines[0], (None, 1, 1, 1, 1.0, 1.0, "N", at), (3, None, 1, 1, 1.0, 1.0, "N", at)]
    lines += [(4, 1, None, None, None, None, None, None), (99, 1, 1, 1, 1.0, 1.0, "N", at)]
    orders = [(o, o % 7 if o % 11 else None) for o in range(60)] + [(5, 2), (5, 3), (None, 1)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                            " l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"),
        "orders": (orders, "o_orderkey long, o_custkey long"),
        "part": ([(1, "a"), (2, "b"), (2, "c"), (3, None), (None, "d")], "p_partkey long, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = StarTables(spark, str(tmp_path))
    kept = plain.with_stored_transactions()
    wanted = Counter(plain.transactions.collect())
    assert sum(wanted.values()) > len(lines) and Counter(kept.transactions.collect()) == wanted
    for tables in (plain, kept):
        shares = [Counter(x.transactions.collect()) for x in tables.shares_of_accounts()]
        assert len(shares) == SHARES and sum(shares, Counter()) == wanted
        accounts = [{r.account_id for r in x} for x in shares]
        assert sum(map(len, accounts)) == len(set().union(*accounts)) and None in set().union(*accounts)


def test_parts_stored_in_turn_leave_no_shuffle(spark):
    """Each part's shuffle is removed before the next part is asked for; the settings are as before."""
    before = {key: spark.conf.get(key) for key in (session.CLEANUP_CONF, session.WRITERS_CONF)}
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    first = shuffles()

    def parts():
        for i in range(3):
            until = time.time() + 10  # files are removed in the background
            while shuffles() - first and time.time() < until:
                time.sleep(0.1)
            assert not shuffles() - first
            yield spark.range(1000).selectExpr("id % 7 AS k", f"{i} AS part").groupBy("k", "part").count()

    found = session.stored_in_turn(parts(), "turns", "part", compression="zstd")
    assert before == {key: spark.conf.get(key) for key in before}
    assert [tuple(r) for r in found.groupBy("part").agg(F.sum("count")).orderBy("part").collect()] == [(i, 1000) for i in range(3)]
