"""The ten investigations and the derived tables in SQL."""

from __future__ import annotations

from oracle.base import avg, big, case, dbl, div, over, pct, rnd
from tamarack import fixed_values as fv

FRAUD_YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)

PATTERN_STATS = f"""
    SELECT fraud_pattern, COUNT(*) AS transaction_count,
      {rnd('100.0::DOUBLE * COUNT(*) / (SUM(COUNT(*)) OVER ())', 2)} AS fraud_share_pct,
      {rnd(avg('amount'), 2)} AS avg_amount,
      {rnd('QUANTILE_CONT(CAST(amount AS DOUBLE), 0.5)', 2)} AS median_amount,
      {rnd(pct('hour_of_day < 6'), 2)} AS pct_night_0_5,
      {rnd(pct('is_foreign_txn'), 2)} AS pct_foreign,
      {rnd(pct('NOT card_present'), 2)} AS pct_card_not_present,
      {rnd(avg('velocity_1h'), 4)} AS avg_velocity_1h,
      {rnd(avg('ip_risk_score'), 2)} AS avg_ip_risk,
      {rnd(pct('NOT has_2fa'), 2)} AS pct_no_2fa
    FROM transactions WHERE is_fraud GROUP BY fraud_pattern"""

HOURLY = f"""
    SELECT DATE_TRUNC('hour', ts) AS hour, COUNT(*) AS transaction_count,
      COUNT(*) FILTER (WHERE is_fraud) AS fraud_count,
      {dbl('SUM(amount)')} AS total_amount,
      {rnd(avg('amount'), 2)} AS avg_amount, {rnd(avg('ip_risk_score'), 2)} AS avg_ip_risk,
      {rnd(div('COUNT(*) FILTER (WHERE is_fraud)', 'COUNT(*)'), 6)} AS fraud_rate,
      CAST(HOUR(DATE_TRUNC('hour', ts)) AS INT) AS hour_of_day,
      CAST(ISODOW(DATE_TRUNC('hour', ts)) - 1 AS INT) AS day_of_week,
      ISODOW(DATE_TRUNC('hour', ts)) > 5 AS is_weekend
    FROM transactions GROUP BY 1, 8, 9, 10"""

ACCOUNTS = f"""
    SELECT account_id, n AS total_transactions, {dbl('amt')} AS total_amount, {rnd(div('amt', 'n'), 2)} AS avg_amount,
      {dbl('mx')} AS max_amount, nf AS fraud_count, {dbl('amtf')} AS fraud_amount,
      {rnd(div('nf', 'n'), 6)} AS fraud_rate, {rnd(div('nfor', 'n'), 4)} AS pct_foreign,
      {rnd(div('vel', 'n'), 4)} AS avg_velocity, nc AS unique_countries, ncat AS unique_categories,
      {rnd(div('ip', 'n'), 2)} AS avg_ip_risk
    FROM fx_account_agg"""

_gap = "resource_efficiency_gap"
Q1 = f"""
    SELECT *, {case([(f'{_gap} > {fv.EFFICIENCY_GAP}', fv.UNDER_POLICED),
                     (f'{_gap} < -{fv.EFFICIENCY_GAP}', fv.OVER_POLICED)], fv.BALANCED)} AS control_efficiency_verdict
    FROM (SELECT *, {rnd('share_of_fraud_loss - share_of_fraud_volume', 2)} AS {_gap} FROM (
      SELECT t.fraud_pattern, t.c AS total_fraud_txns, {dbl('t.loss')} AS total_loss,
        {rnd(div('t.loss', 't.c'), 2)} AS avg_loss_per_attack,
        {rnd(div('100 * t.c', '(SELECT SUM(c) FROM per_pattern)'), 2)} AS share_of_fraud_volume,
        {rnd(div('100 * t.loss', '(SELECT SUM(loss) FROM per_pattern)'), 2)} AS share_of_fraud_loss,
        p.avg_velocity_1h AS attack_speed, p.pct_card_not_present, p.pct_foreign
      FROM per_pattern t JOIN pattern_stats p USING (fraud_pattern)))"""
PER_PATTERN = "SELECT fraud_pattern, COUNT(*) AS c, SUM(amount) AS loss FROM transactions WHERE is_fraud GROUP BY ALL"

YEARLY = f"""
    SELECT fraud_pattern, CAST(YEAR(ts) AS INT) AS year, {dbl('COUNT(*)')} AS attacks,
      {rnd(avg('amount'), 2)} AS avg_attack_size, {rnd(avg('velocity_1h'), 2)} AS avg_velocity,
      {rnd(avg('ip_risk_score'), 2)} AS avg_ip_risk,
      {rnd(avg('amount_vs_avg_ratio'), 3)} AS behavioural_disguise_score,
      {rnd(pct('has_2fa'), 1)} AS pct_bypassing_2fa, {rnd(pct('device_known'), 1)} AS pct_using_known_device
    FROM transactions WHERE is_fraud GROUP BY ALL"""
METRIC_ROWS = f"SELECT * FROM yearly UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(fv.YOY_METRICS)}))"
YOY = f"""
    SELECT fraud_pattern, metric, year, value, before AS prev_value,
      {rnd('(value - before) / NULLIF(before, 0) * 100', 1)} AS pct_change
    FROM (SELECT *, FIRST_VALUE(value) OVER (PARTITION BY fraud_pattern, metric ORDER BY year
                                             ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before FROM metric_rows)"""


def _reading(change: str) -> str:
    rules = [(f"{change} IS NULL", fv.READING_UNKNOWN)]
    for metric, (up, down) in fv.READINGS.items():
        rules.append((f"metric = '{metric}' AND {change} > 0", up))
        rules.append((f"metric = '{metric}' AND {change} < 0", down))
    return case(rules, fv.READING_FLAT)


_avg = "avg_pct_change"
Q2 = f"""
    SELECT *, {case([(f'{_avg} IS NULL', fv.TREND_UNKNOWN), (f'{_avg} > 0', fv.TREND_UP),
                     (f'{_avg} < 0', fv.TREND_DOWN)], fv.TREND_FLAT)} AS avg_change_trend,
      {_reading(_avg)} AS business_interpretation
    FROM (SELECT fraud_pattern, metric,
            {', '.join(f'MIN(value) FILTER (WHERE year = {y}) AS y_{y}' for y in FRAUD_YEARS)},
            {rnd('AVG(pct_change)', 1)} AS {_avg}
          FROM yoy GROUP BY fraud_pattern, metric)"""
YOY_CTES = (("yearly", YEARLY), ("metric_rows", METRIC_ROWS), ("yoy", YOY))

IDENTITY = f"""
    SELECT account_id, account_type, home_country, account_age_days,
      {rnd(div('unique_countries', 'account_age_days') + ' * 365', 2)} AS countries_per_year,
      {rnd(div('unique_categories', 'avg_monthly_txns'), 2)} AS category_diversity_ratio,
      {dbl('pct_foreign')} AS foreign_txn_pct, {dbl('avg_ip_risk')} AS avg_ip_risk,
      {dbl('avg_velocity')} AS avg_velocity,
      {rnd(div('avg_txn_amount', 'credit_limit') + ' * 100', 2)} AS avg_credit_utilization_pct, is_fraudster
    FROM account_profiles"""


def z_of(metric: str, cohort: str) -> str:
    return f"({metric} - AVG({metric}) OVER {cohort}) / NULLIF(STDDEV_SAMP({metric}) OVER {cohort}, 0)"


_points = " + ".join(
    f"CASE WHEN z_{m} > {fv.Z_CLIP} THEN 1.0::DOUBLE WHEN z_{m} > 0 THEN z_{m} / {fv.Z_CLIP} ELSE 0 END * {w}"
    for m, w in fv.SYNTHETIC_WEIGHTS.items()
)
IDENTITY_Z = f"""
    SELECT *, {', '.join(f'{z_of(m, "kind")} AS z_{m}' for m in fv.SYNTHETIC_WEIGHTS)}
    FROM identity WHERE account_age_days >= {fv.MIN_AGE_DAYS} WINDOW kind AS (PARTITION BY account_type)"""
_id_columns = f"account_id, account_type, home_country, account_age_days, {', '.join(fv.SYNTHETIC_WEIGHTS)}"
_score = "synthetic_id_suspicion_score"
Q3 = f"""
    SELECT {_id_columns}, {_score},
      {case([(f'{_score} >= {cut}', text) for cut, text in fv.SYNTHETIC_CUTS], fv.SYNTHETIC_OK)} AS synthetic_id_verdict,
      is_fraudster
    FROM (SELECT *, {rnd(_points, 1)} AS {_score} FROM identity_z)
    UNION ALL
    SELECT {_id_columns}, NULL, '{fv.SYNTHETIC_IMMATURE}', is_fraudster
    FROM identity WHERE account_age_days < {fv.MIN_AGE_DAYS}"""
IDENTITY_CTES = (("identity", IDENTITY), ("identity_z", IDENTITY_Z))

_bands = " OR ".join(f"(amount >= {lo} AND amount <= {hi})" for lo, hi in fv.STRUCTURING_BANDS)
BEHAVIOUR = f"""
    SELECT account_id, {rnd(avg('amount', 'is_foreign_txn'), 2)} AS avg_foreign_amount,
      COUNT(*) FILTER (WHERE is_foreign_txn) AS foreign_txn_count,
      {rnd(avg('velocity_1h'), 2)} AS avg_velocity, MAX(velocity_1h) AS peak_velocity,
      {rnd(pct('hour_of_day <= 5'), 1)} AS pct_night_activity,
      COUNT(*) FILTER (WHERE {_bands}) AS structuring_txn_count,
      COUNT(*) AS total_txns, {dbl('SUM(amount)')} AS total_volume,
      COUNT(DISTINCT merchant_country) AS countries_touched
    FROM transactions GROUP BY account_id"""
_rules = " + ".join(
    f"IF({name} > {cap}, {points}, {name} * {rate}::DOUBLE)" for name, (cap, points, rate) in fv.MULE_RULES.items()
)
_mule = "mule_suspicion_score"
Q4 = f"""
    SELECT b.account_id, account_type, home_country, total_txns, total_volume, foreign_txn_count, b.avg_velocity,
      peak_velocity, pct_night_activity, structuring_txn_count, countries_touched, {_mule},
      {dbl('risk_score')} AS risk_score, is_fraudster,
      {case([(f'structuring_txn_count > 0 AND peak_velocity > {fv.BURST_VELOCITY}', fv.MULE_BURST),
             *[(f'{_mule} >= {cut}', text) for cut, text in fv.MULE_CUTS]], fv.MULE_NORMAL)} AS aml_verdict
    FROM (SELECT *, {rnd(f'{_rules} + IF(structuring_txn_count > 0, {fv.STRUCTURING_POINTS}, 0)', 1)} AS {_mule}
          FROM behaviour) b
    JOIN account_profiles a ON a.account_id = b.account_id WHERE {_mule} > {fv.MULE_MIN_SCORE}"""

MEMBERS = """
    SELECT ring_id, account_id, first_fraud_date
    FROM (SELECT ring_id, account_a AS account_id FROM network_edges WHERE both_fraud
          UNION SELECT ring_id, account_b FROM network_edges WHERE both_fraud) m
    JOIN (SELECT account_id, MIN(ts) AS first_fraud_date FROM transactions WHERE is_fraud GROUP BY account_id) f
      USING (account_id)"""
SEEDS = """
    SELECT ring_id, account_id AS seed_account, first_fraud_date AS seed_fraud_date FROM members
    QUALIFY ROW_NUMBER() OVER (PARTITION BY ring_id ORDER BY first_fraud_date, account_id) = 1"""
RING_CTES = (("members", MEMBERS), ("seeds", SEEDS))
DAYS = "(EPOCH_US({b}) - EPOCH_US({a})) / 86400000000.0::DOUBLE"
_d = DAYS.format(a="seed_fraud_date", b="first_fraud_date")
Q5 = f"""
    SELECT ring_id, seed_account, CAST(seed_fraud_date AS DATE) AS ring_detected_date,
      COUNT(*) AS connected_accounts, CAST(MIN(first_fraud_date) AS DATE) AS first_infected_date,
      CAST(MAX(first_fraud_date) AS DATE) AS last_infected_date,
      {rnd(f'MIN({_d})', 1)} AS first_replication_speed_days, {rnd(f'MAX({_d})', 1)} AS quarantine_window_days,
      {rnd(f'AVG({_d})', 1)} AS avg_days_to_spread,
      {case([(f'MIN({_d}) < {cut}', text) for cut, text in fv.RESPONSE_CUTS], fv.RESPONSE_STANDARD)} AS response_priority
    FROM members JOIN seeds USING (ring_id) WHERE account_id <> seed_account
    GROUP BY ring_id, seed_account, seed_fraud_date"""

SEGMENTS = f"""
    SELECT account_type, COUNT(DISTINCT account_id) AS total_accounts, COUNT(*) AS total_txns,
      COUNT(*) FILTER (WHERE is_fraud) AS fraud_txns,
      {dbl('SUM(amount) FILTER (WHERE is_fraud)')} AS fraud_loss, {dbl('SUM(amount)')} AS total_volume,
      {rnd(avg('credit_limit'), 2)} AS avg_credit_limit, {rnd(avg('risk_score'), 2)} AS avg_risk_score
    FROM transactions JOIN account_profiles USING (account_id) GROUP BY account_type"""
_i, _b = "implied_fraud_tax_per_txn", "blended_portfolio_fraud_tax_per_txn"
Q6 = f"""
    SELECT account_type, total_accounts, total_txns, fraud_txns,
      {rnd(div('100 * fraud_txns', 'total_txns'), 2)} AS fraud_rate_pct, fraud_loss,
      {rnd('100 * fraud_loss / all_loss', 2)} AS share_of_total_fraud_loss,
      {rnd('fraud_loss / total_accounts', 2)} AS fraud_cost_per_account, avg_risk_score, {_i}, {_b},
      {rnd(f'{_b} - {_i}', 4)} AS subsidy_gap_per_txn,
      {rnd(f'({_b} - {_i}) * total_txns', 2)} AS net_dollar_subsidy_effect,
      {case([(f'{_i} < {_b} AND avg_risk_score < {fv.RISK_CUT}', fv.SUBSIDISING),
             (f'{_i} > {_b} AND avg_risk_score >= {fv.RISK_CUT}', fv.SUBSIDISED)],
            fv.FAIRLY_PRICED)} AS cross_subsidy_verdict
    FROM (SELECT *, {rnd('fraud_loss / total_txns', 4)} AS {_i}, {rnd('all_loss / all_txns', 4)} AS {_b}
          FROM (SELECT *, SUM(fraud_loss) OVER () AS all_loss, SUM(total_txns) OVER () AS all_txns FROM segments))"""

WINDOW_DIMENSIONS = "time_window, day_type, device_type, txn_geography, auth_strength, merchant_category"
WINDOWS = f"""
    SELECT {case([(f'hour_of_day >= {lo} AND hour_of_day <= {hi}', n) for lo, hi, n in fv.TIME_WINDOWS],
                 fv.TIME_WINDOW_REST)} AS time_window,
      IF(is_weekend, '{fv.WEEKEND}', '{fv.WEEKDAY}') AS day_type, device_type,
      IF(is_foreign_txn, '{fv.FOREIGN}', '{fv.DOMESTIC}') AS txn_geography,
      IF(NOT has_2fa, '{fv.NO_2FA}', '{fv.HAS_2FA}') AS auth_strength, merchant_category,
      COUNT(*) AS total_txns, COUNT(*) FILTER (WHERE is_fraud) AS fraud_txns,
      {rnd(pct('is_fraud'), 2)} AS fraud_success_rate_pct,
      {rnd(avg('amount', 'is_fraud'), 2)} AS avg_fraud_amount,
      {dbl('COALESCE(SUM(amount) FILTER (WHERE is_fraud), 0)')} AS total_fraud_loss
    FROM transactions GROUP BY ALL HAVING COUNT(*) >= {fv.WINDOW_MIN_TXNS}"""
Q7 = f"""
    SELECT CAST(RANK() OVER (ORDER BY fraud_success_rate_pct DESC) AS INT) AS risk_rank, {WINDOW_DIMENSIONS},
      total_txns, fraud_txns, fraud_success_rate_pct,
      {case([(f'total_txns >= {cut}', text) for cut, text in fv.RELIABILITY_CUTS], fv.RELIABILITY_LOW)}
        AS sample_reliability,
      avg_fraud_amount, total_fraud_loss
    FROM windows ORDER BY risk_rank, total_txns DESC, {WINDOW_DIMENSIONS} LIMIT {fv.WINDOW_TOP}"""

_late = f"ts > seed_fraud_date + INTERVAL {fv.RESPONSE_WINDOW_DAYS} DAY"
Q8 = f"""
    SELECT ring_id, seed_account, CAST(seed_fraud_date AS DATE) AS ring_detected_date,
      COUNT(DISTINCT account_id) AS downstream_accounts_activated, COUNT(*) AS downstream_fraud_txns,
      {dbl('SUM(amount)')} AS preventable_loss_usd,
      {dbl(f'COALESCE(SUM(amount) FILTER (WHERE NOT ({_late})), 0)')} AS loss_within_5day_response_window,
      {dbl(f'COALESCE(SUM(amount) FILTER (WHERE {_late}), 0)')} AS loss_after_response_window_missed
    FROM members JOIN seeds USING (ring_id)
    JOIN (SELECT account_id, ts, amount FROM transactions WHERE is_fraud) USING (account_id)
    WHERE account_id <> seed_account AND ts > seed_fraud_date
    GROUP BY ring_id, seed_account, seed_fraud_date"""

HISTORY = """
    SELECT account_id, transaction_id, ts, ip_risk_score, velocity_1h, is_foreign_txn, amount_vs_avg_ratio,
      ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY ts, transaction_id) AS rn,
      COUNT(*) OVER (PARTITION BY account_id) AS group_rows
    FROM transactions t
    JOIN (SELECT account_id, MIN(ts) AS first_ts FROM transactions WHERE is_fraud GROUP BY account_id)
      USING (account_id)
    WHERE NOT is_fraud AND ts < first_ts"""


def _drift(x: str, scale: int = 1) -> str:
    return rnd(f"({avg(x, 'rn > group_rows / 2.0')} - {avg(x, 'rn <= group_rows / 2.0')}) * {scale}", 2)


DRIFTS = f"""
    SELECT account_id, {_drift('ip_risk_score')} AS ip_drift, {_drift('velocity_1h')} AS velocity_drift,
      {_drift('CAST(is_foreign_txn AS INT)', 100)} AS foreign_pct_drift,
      {_drift('amount_vs_avg_ratio')} AS spend_ratio_drift
    FROM history WHERE group_rows >= {fv.MIN_PRE_TXNS} GROUP BY account_id"""
Q9 = f"""
    SELECT *, CAST((ip_drift > 0)::INT + (velocity_drift > 0)::INT + (foreign_pct_drift > 0)::INT
                   + (spend_ratio_drift > 0)::INT AS INT) AS drift_signals_positive,
      {case([('ip_drift > 0 AND velocity_drift > 0 AND GREATEST(foreign_pct_drift, spend_ratio_drift) > 0',
              fv.DRIFT_FOUND)], fv.DRIFT_NONE)} AS pre_crime_verdict
    FROM drifts"""

FINGERPRINT_METRICS = ("avg_vel", "avg_ip", "pct_foreign", "pct_cnp", "pct_no_2fa")
FINGERPRINTS = f"""
    SELECT fraud_pattern, CAST(YEAR(ts) AS INT) AS year, {avg('velocity_1h')} AS avg_vel,
      {avg('ip_risk_score')} AS avg_ip, {pct('is_foreign_txn')} AS pct_foreign,
      {pct('NOT card_present')} AS pct_cnp, {pct('NOT has_2fa')} AS pct_no_2fa
    FROM transactions WHERE is_fraud GROUP BY ALL"""
STANDARDISED = f"""
    SELECT fraud_pattern, year,
      [{', '.join(z_of(m, 'everything') for m in FINGERPRINT_METRICS)}] AS z
    FROM fingerprints WINDOW everything AS ()"""
PAIRS = f"""
    SELECT a.fraud_pattern AS pattern_a, a.year AS year_a, b.fraud_pattern AS pattern_b, b.year AS year_b,
      {rnd('LIST_DISTANCE(a.z, b.z)', 3)} AS behavioural_distance
    FROM standardised a JOIN standardised b ON b.year - a.year = 1 AND b.fraud_pattern <> a.fraud_pattern"""
MATCHES = """
    SELECT p.*, cohort_median FROM pairs p
    JOIN (SELECT pattern_b, year_b, MEDIAN(behavioural_distance) AS cohort_median,
            MIN(behavioural_distance) AS nearest FROM pairs GROUP BY pattern_b, year_b)
      USING (pattern_b, year_b)
    WHERE behavioural_distance = nearest AND nearest < cohort_median"""
Q10 = f"""
    SELECT pattern_a, year_a, pattern_b, year_b, behavioural_distance,
      {rnd('cohort_median', 2)} AS median_distance_in_cohort,
      COUNT(*) OVER donor AS times_flagged_as_predecessor,
      (SELECT STRING_AGG(CAST(x.year_b AS VARCHAR), ', ' ORDER BY x.year_b) FROM matches x
       WHERE x.pattern_a = m.pattern_a AND x.pattern_b = m.pattern_b) AS years_flagged,
      IF(COUNT(*) OVER donor >= {fv.REPEAT_TIMES}, '{fv.REPEAT_DONOR}', '{fv.SINGLE_MATCH}') AS signal_strength_verdict
    FROM matches m WINDOW donor AS (PARTITION BY pattern_a, pattern_b)"""
PAIR_CTES = (("fingerprints", FINGERPRINTS), ("standardised", STANDARDISED), ("pairs", PAIRS))

# name -> (CTEs it reads, query): also the raw material of the summaries
CASES = {
    "q01": ((("pattern_stats", PATTERN_STATS), ("per_pattern", PER_PATTERN)), Q1),
    "q02": (YOY_CTES, Q2),
    "q03": (IDENTITY_CTES, Q3),
    "q04": ((("behaviour", BEHAVIOUR),), Q4),
    "q05": (RING_CTES, Q5),
    "q06": ((("segments", SEGMENTS),), Q6),
    "q07": ((("windows", WINDOWS),), Q7),
    "q08": (RING_CTES, Q8),
    "q09": ((("history", HISTORY), ("drifts", DRIFTS)), Q9),
    "q10": ((*PAIR_CTES, ("matches", MATCHES)), Q10),
}


def case_sql(name: str) -> str:
    ctes, query = CASES[name]
    return over(query, *ctes)


def from_case(query: str, *names: str) -> str:
    """``query`` over the results of cases, each available under its name."""
    ctes: dict[str, str] = {}
    for name in names:
        ctes.update(CASES[name][0])
        ctes[name] = CASES[name][1]
    return over(query, *ctes.items())


def case_oracles() -> dict[str, str]:
    return {
        "q01_resource_efficiency": case_sql("q01"),
        "q02_yoy_evolution": case_sql("q02"),
        "q03_synthetic_identity": case_sql("q03"),
        "q04_money_mule": case_sql("q04"),
        "q05_ring_contagion": case_sql("q05"),
        "q06_cross_subsidy": case_sql("q06"),
        "q07_attack_window": case_sql("q07"),
        "q08_response_lag": case_sql("q08"),
        "q09_precrime_drift": case_sql("q09"),
        "q10_pattern_evolution": case_sql("q10"),
        "der_pattern_profile": over(PATTERN_STATS),
        "der_hourly_rollup": over(HOURLY),
        "der_account_profile": over(ACCOUNTS),
    }
