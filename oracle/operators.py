"""Single operators and summaries in SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from oracle import cases as cs
from oracle.base import avg, big, case, dbl, div, lit, over, pct, rnd
from tamarack import fixed_values as fv

_METRICS = list(fv.SYNTHETIC_WEIGHTS)
_DECIMALS = ("amount", "ip_risk_score", "amount_vs_avg_ratio")
_FLAGS = ("is_weekend", "card_present", "device_known", "is_foreign_txn", "has_2fa", "is_fraud")


def tier(verdict: str) -> str:
    rules = [(" OR ".join(f"STRPOS({verdict}, '{m}') > 0" for m in marks), name) for marks, name in fv.TIER_MARKS]
    rules += [
        (" OR ".join(f"STARTS_WITH(UPPER({verdict}), '{w}')" for w in words), name) for words, name in fv.TIER_WORDS
    ]
    return case(rules, fv.NEUTRAL_TIER)


def stripped(text: str) -> str:
    return f"TRIM(REGEXP_REPLACE({text}, '{fv.PICTOGRAPHS}', '', 'g'))"


def shown(column: str) -> str:
    """Mean over all rows, missing numbers as zero."""
    return f"(CAST(SUM(CAST(COALESCE({column}, 0) AS DECIMAL(28,4))) AS DOUBLE) / COUNT(*))"


def money(column: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({column} AS DECIMAL(28,2))), 0) AS DOUBLE)"


def _unique(name: str, table: str, key: str) -> str:
    return f"SELECT {lit(name)} AS rule, {big(f'COUNT(*) - COUNT(DISTINCT {key})')} AS violations FROM {table}"


def _known(name: str, table: str, column: str, parent: str, key: str) -> str:
    return (
        f"SELECT {lit(name)}, {big('COUNT(*)')} FROM {table} x WHERE {column} IS NOT NULL"
        f" AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = x.{column})"
    )


def _holds(name: str, table: str, condition: str) -> str:
    return f"SELECT {lit(name)}, {big(f'COUNT(*) FILTER (WHERE NOT ({condition}))')} FROM {table}"


AUDIT = " UNION ALL ".join(
    [
        _unique("account_profiles.account_id is unique", "account_profiles", "account_id"),
        _unique("transactions.transaction_id is unique", "transactions", "transaction_id"),
        _unique("time_series_stats.hour is unique", "hourly", "hour"),
        _unique("part.p_partkey is unique", "part", "p_partkey"),
        _unique("lineitem.line is unique", "lineitem", "(l_orderkey, l_linenumber)"),
        _holds("network_edges.account_a is present", "network_edges", "account_a IS NOT NULL"),
        _holds("network_edges.account_b is present", "network_edges", "account_b IS NOT NULL"),
        _known("transactions.account_id is known", "transactions", "account_id", "account_profiles", "account_id"),
        _known("network_edges.account_a is known", "network_edges", "account_a", "account_profiles", "account_id"),
        _known("network_edges.account_b is known", "network_edges", "account_b", "account_profiles", "account_id"),
        _known(
            "transactions.fraud_pattern is known", "transactions", "fraud_pattern",
            "(SELECT 'pattern_' || (p_partkey % 7) AS fraud_pattern FROM part)", "fraud_pattern",
        ),
        _holds("transactions.ts is present", "transactions", "ts IS NOT NULL"),
        _holds("transactions.hour_of_day is an hour", "transactions", "hour_of_day BETWEEN 0 AND 23"),
        _holds("transactions.day_of_week is a weekday", "transactions", "day_of_week BETWEEN 0 AND 6"),
        _holds("time_series_stats.hour_of_day is an hour", "hourly", "hour_of_day BETWEEN 0 AND 23"),
        _holds("time_series_stats.day_of_week is a weekday", "hourly", "day_of_week BETWEEN 0 AND 6"),
    ]
)

HEAT = f"""SELECT day_of_week AS day, hour_of_day AS hour, {big('SUM(transaction_count)')} AS txn,
      {big('SUM(fraud_count)')} AS fraud, {rnd(div('100 * SUM(fraud_count)', 'SUM(transaction_count)'), 3)} AS rate
    FROM hourly GROUP BY ALL"""
_hourly = ("hourly", cs.HOURLY)
_pattern_stats = ("pattern_stats", cs.PATTERN_STATS)
_windows_all = cs.WINDOWS.replace(f"COUNT(*) >= {fv.WINDOW_MIN_TXNS}", "COUNT(*) >= 1")
_z = ", ".join("{}" for _ in _METRICS)
_pairs_of_rings = """SELECT ring_id, account_id, first_fraud_date, seed_account, seed_fraud_date
    FROM members JOIN seeds USING (ring_id) WHERE account_id <> seed_account"""
_days = cs.DAYS.format(a="seed_fraud_date", b="first_fraud_date")


def operator_oracles() -> dict[str, str]:
    accounts_by_limit = f"SELECT account_id, {dbl('credit_limit')} AS credit_limit FROM account_profiles"
    return {
        "audit_constraints": over(AUDIT, _hourly),
        "src_csv_roundtrip": over(
            """SELECT *, CASE CAST(account_id[4:] AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
              WHEN 2 THEN ' a "quoted", part ' ELSE 'line one' || CHR(10) || 'line two' END AS note FROM accounts""",
            ("accounts", cs.ACCOUNTS),
        ),
        "src_csv_column_list": over(
            f"""SELECT * REPLACE ({', '.join(f'{dbl(x)} AS {x}' for x in _DECIMALS)}),
              CAST(NULL AS SMALLINT) AS mcc_code, CAST(NULL AS INT) AS time_since_last_s,
              CAST(NULL AS INT) AS account_age_days, CAST(NULL AS DOUBLE) AS credit_limit FROM transactions"""
        ),
        "src_csv_inferred": cs.case_sql("q02"),
        "src_json_array": over(HEAT, _hourly),
        "src_flags": over(
            f"SELECT {', '.join(f'CAST({f} AS INT) AS {f}' for f in _FLAGS)}, COUNT(*) AS n"
            " FROM transactions GROUP BY ALL"
        ),
        "fil_flag": over("SELECT transaction_id, account_id FROM transactions WHERE is_fraud AND has_2fa = FALSE"),
        "fil_not_null": over(
            "SELECT transaction_id, fraud_pattern FROM transactions WHERE fraud_pattern IS NOT NULL"
        ),
        "fil_structuring_bands": over(
            f"SELECT transaction_id, {dbl('amount')} AS amount FROM transactions, "
            f"(VALUES {', '.join(f'({lo}, {hi})' for lo, hi in fv.STRUCTURING_BANDS)}) band(lo, hi)"
            " WHERE amount BETWEEN lo AND hi"
        ),
        "fil_having_floor": over("SELECT * FROM windows", ("windows", cs.WINDOWS)),
        "fil_dimension": cs.from_case("SELECT * FROM q10 WHERE pattern_a = 'pattern_3'", "q10"),
        "fil_text_search": cs.from_case(
            "SELECT * FROM q04 WHERE account_id ILIKE '%acc00003%' OR home_country ILIKE '%acc00003%'", "q04"
        ),
        "fil_equals_all": cs.from_case("SELECT * FROM q09 WHERE drift_signals_positive = 3", "q09"),
        "prj_labels": over(
            f"""SELECT transaction_id,
              CASE hour_of_day // 6 WHEN 0 THEN 'Night (0-5h)' WHEN 1 THEN 'Morning (6-11h)'
                WHEN 2 THEN 'Afternoon (12-17h)' ELSE 'Evening (18-23h)' END AS time_window,
              IF(day_of_week > 4, '{fv.WEEKEND}', '{fv.WEEKDAY}') AS day_type,
              IF(is_foreign_txn, '{fv.FOREIGN}', '{fv.DOMESTIC}') AS txn_geography,
              IF(has_2fa, '{fv.HAS_2FA}', '{fv.NO_2FA}') AS auth_strength FROM transactions"""
        ),
        "prj_interpret": over(
            f"SELECT fraud_pattern, metric, year, {cs._reading('pct_change')} AS reading FROM yoy", *cs.YOY_CTES
        ),
        "join_dimension": over(
            "SELECT fraud_pattern, transaction_id, p.avg_velocity_1h, p.pct_foreign"
            " FROM transactions JOIN pattern_stats p USING (fraud_pattern) WHERE is_fraud",
            _pattern_stats,
        ),
        "join_accounts": over(
            "SELECT account_id, transaction_id, account_type, home_country"
            " FROM account_profiles JOIN transactions USING (account_id)"
        ),
        "join_first_event": over("SELECT * FROM members", *cs.RING_CTES),
        "join_ring_pairs": over(_pairs_of_rings, *cs.RING_CTES),
        "join_later_events": over(
            f"""SELECT ring_id, account_id, COUNT(t.ts) AS later_txns, {dbl('COALESCE(SUM(t.amount), 0)')} AS later_loss
            FROM ring_pairs LEFT JOIN (SELECT account_id, ts, amount FROM transactions WHERE is_fraud) t
              USING (account_id) WHERE t.ts > seed_fraud_date GROUP BY ring_id, account_id
            UNION ALL
            SELECT ring_id, account_id, 0, 0 FROM ring_pairs r WHERE NOT EXISTS (SELECT 1 FROM transactions x
              WHERE x.is_fraud AND x.account_id = r.account_id AND x.ts > r.seed_fraud_date)""",
            *cs.RING_CTES,
            ("ring_pairs", _pairs_of_rings),
        ),
        "join_cross_totals": over(
            f"""SELECT account_type, total_txns, {big('(SELECT SUM(total_txns) FROM segments)')} AS all_txns,
              {dbl('(SELECT SUM(CAST(fraud_loss AS DECIMAL(28,2))) FROM segments)')} AS all_loss FROM segments""",
            ("segments", cs.SEGMENTS),
        ),
        "join_year_offset": over("SELECT * FROM pairs", *cs.PAIR_CTES),
        "agg_conditional": over(
            f"""SELECT merchant_category, COUNT(*) AS txns, COUNT(fraud_pattern) AS patterned,
              COUNT(*) FILTER (WHERE is_foreign_txn) AS foreign_txns,
              {dbl('COALESCE(SUM(amount) FILTER (WHERE is_fraud), 0)')} AS fraud_loss,
              {rnd(avg('amount', 'is_fraud'), 2)} AS avg_fraud_amount, {rnd(pct('NOT has_2fa'), 2)} AS pct_no_2fa,
              {rnd(pct('hour_of_day < 6'), 1)} AS pct_night
            FROM transactions GROUP BY merchant_category"""
        ),
        "agg_count_distinct_mix": over(
            f"""SELECT device_type, COUNT(*) AS txns, COUNT(DISTINCT account_id) AS accounts,
              {dbl('SUM(amount)')} AS volume, {dbl('MIN(amount)')} AS least, {dbl('MAX(amount)')} AS most
            FROM transactions GROUP BY device_type"""
        ),
        "agg_deviation": over(
            "SELECT account_type, "
            + ", ".join(
                f"{rnd(f'AVG({m})', 6)} AS mean_{m}, {rnd(f'NULLIF(STDDEV_SAMP({m}), 0)', 6)} AS sd_{m}"
                for m in _METRICS
            )
            + " FROM identity GROUP BY account_type",
            ("identity", cs.IDENTITY),
        ),
        "agg_median": over(
            f"SELECT merchant_category, {rnd('MEDIAN(CAST(amount AS DOUBLE))', 3)} AS median_amount"
            " FROM transactions GROUP BY merchant_category"
        ),
        "agg_listagg_ordered": over(
            "SELECT fraud_pattern, STRING_AGG(CAST(y AS VARCHAR), ', ' ORDER BY y) AS years FROM"
            " (SELECT DISTINCT fraud_pattern, YEAR(ts) AS y FROM transactions WHERE is_fraud) GROUP BY fraud_pattern"
        ),
        "agg_global": over(
            f"""SELECT COUNT(*) AS txns, COUNT(*) FILTER (WHERE is_fraud) AS frauds, {dbl('SUM(amount)')} AS volume,
              MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM transactions"""
        ),
        "agg_distinct": over("SELECT account_id, device_type FROM transactions GROUP BY ALL"),
        "win_share_of_total": over(
            f"""SELECT account_id, {dbl('SUM(amount)')} AS volume,
              {rnd(div('100 * SUM(amount)', 'SUM(SUM(amount)) OVER ()'), 6)} AS volume_share_pct
            FROM transactions GROUP BY account_id"""
        ),
        "win_previous_value": over("SELECT * FROM yoy", *cs.YOY_CTES),
        "win_first_per_group": over("SELECT * FROM seeds", *cs.RING_CTES),
        "win_sequence": over(
            f"""SELECT account_id, IF(rn * 2 <= group_rows, 'early', 'late') AS phase, group_rows, COUNT(*) AS txns,
              MAX(rn) AS last_rn, {dbl('SUM(amount)')} AS volume
            FROM (SELECT account_id, amount, COUNT(*) OVER a AS group_rows,
                    ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY ts, transaction_id) AS rn
                  FROM transactions WINDOW a AS (PARTITION BY account_id)) GROUP BY ALL"""
        ),
        "win_clean_history": over(
            f"SELECT account_id, transaction_id, rn, group_rows FROM history WHERE group_rows >= {fv.MIN_PRE_TXNS}",
            ("history", cs.HISTORY),
        ),
        "win_rank_global": over(
            f"""SELECT {cs.WINDOW_DIMENSIONS}, fraud_success_rate_pct,
              RANK() OVER (ORDER BY fraud_success_rate_pct DESC) AS risk_rank FROM windows""",
            ("windows", _windows_all),
        ),
        "win_rank_in_group": over(
            f"""SELECT pairs.*, CAST(RANK() OVER (PARTITION BY pattern_b, year_b ORDER BY behavioural_distance) AS INT)
                AS nearness,
              {rnd('MEDIAN(behavioural_distance) OVER (PARTITION BY pattern_b, year_b)', 4)} AS cohort_median
            FROM pairs""",
            *cs.PAIR_CTES,
        ),
        "srt_custom_order": over(
            f"SELECT *, CAST(LIST_POSITION([{', '.join(lit(m) for m in fv.YOY_METRICS)}], metric) AS INT) AS position"
            " FROM metric_rows",
            *cs.YOY_CTES[:2],
        ),
        "srt_top_k": over(
            f"SELECT transaction_id, {dbl('amount')} AS amount FROM transactions"
            f" ORDER BY 2 DESC, 1 LIMIT {fv.WINDOW_TOP}"
        ),
        "srt_page": over(f"{accounts_by_limit} ORDER BY 2 DESC, 1 LIMIT {fv.PAGE_SIZE} OFFSET {3 * fv.PAGE_SIZE}"),
        "srt_page_deep": over(
            f"""SELECT account_id, credit_limit FROM (
              SELECT *, ROW_NUMBER() OVER (ORDER BY credit_limit DESC, account_id) AS rn, COUNT(*) OVER () AS n
              FROM ({accounts_by_limit})) WHERE (rn - 1) // {fv.PAGE_SIZE} = (n - 1) // {fv.PAGE_SIZE}"""
        ),
        "srt_table_view": cs.from_case(
            f"""SELECT * FROM (SELECT *, COUNT(*) OVER () AS rows_found FROM q03
                WHERE synthetic_id_verdict = '{fv.SYNTHETIC_OK}' AND (account_id ILIKE '%acc%' OR home_country ILIKE '%acc%'))
            ORDER BY synthetic_id_suspicion_score DESC NULLS LAST, account_id
            LIMIT {fv.PAGE_SIZE} OFFSET {fv.PAGE_SIZE}""",
            "q03",
        ),
        "srt_table_view_text": cs.from_case(
            f"""SELECT * FROM (SELECT *, COUNT(*) OVER () AS rows_found FROM q03)
            ORDER BY account_type DESC NULLS LAST, account_id LIMIT {fv.PAGE_SIZE} OFFSET {2 * fv.PAGE_SIZE}""",
            "q03",
        ),
        "set_union_all_nulls": over(
            f"""SELECT account_id, account_age_days,
              IF(account_age_days >= {fv.MIN_AGE_DAYS}, countries_per_year, NULL) AS countries_per_year FROM identity""",
            ("identity", cs.IDENTITY),
        ),
        "set_union_distinct": over(
            "SELECT ring_id, account_a AS account_id FROM network_edges WHERE both_fraud"
            " UNION SELECT ring_id, account_b FROM network_edges WHERE both_fraud"
        ),
        "set_ring_members": over(
            "SELECT DISTINCT ring_id, UNNEST([account_a, account_b]) AS account_id FROM network_edges WHERE both_fraud"
        ),
        "set_unpivot": over("SELECT * FROM metric_rows", *cs.YOY_CTES[:2]),
        "set_pivot_years": over(
            "SELECT fraud_pattern, metric, "
            + ", ".join(f"MAX(CASE WHEN year = {y} THEN value END) AS y_{y}" for y in cs.FRAUD_YEARS)
            + " FROM metric_rows GROUP BY fraud_pattern, metric",
            *cs.YOY_CTES[:2],
        ),
        "sca_zscore": over(
            f"SELECT account_id, {', '.join(f'{rnd(f'z_{m}', 4)} AS z_{m}' for m in _METRICS)} FROM identity_z",
            *cs.IDENTITY_CTES,
        ),
        "sca_clip": over(
            "SELECT account_id, "
            + ", ".join(
                f"{rnd(f'CASE WHEN z_{m} > {fv.Z_CLIP} THEN {fv.Z_CLIP} WHEN z_{m} > 0 THEN z_{m} ELSE 0 END', 4)} AS {m}"
                for m in _METRICS
            )
            + " FROM identity_z",
            *cs.IDENTITY_CTES,
        ),
        "sca_ratios": over("SELECT * FROM identity", ("identity", cs.IDENTITY)),
        "sca_capped_points": over(
            "SELECT account_id, "
            + ", ".join(
                f"{rnd(f'IF({n} > {cap}, {points}, {n} * {rate}::DOUBLE)', 2)} AS points_{n}"
                for n, (cap, points, rate) in fv.MULE_RULES.items()
            )
            + " FROM behaviour",
            ("behaviour", cs.BEHAVIOUR),
        ),
        "sca_days_between": over(
            f"""SELECT ring_id, account_id, {rnd(_days, 5)} AS days,
              seed_fraud_date + INTERVAL {fv.RESPONSE_WINDOW_DAYS} DAY AS deadline,
              CAST(first_fraud_date AS DATE) AS first_day FROM ({_pairs_of_rings})""",
            *cs.RING_CTES,
        ),
        "sca_title_case": (
            "SELECT doc_id, ARRAY_TO_STRING(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(REPLACE(COALESCE(text, ''), '_', ' '),"
            r" '\w+|\W+'), lambda p:"
            f" TRANSLATE(p[1], '{ascii_lowercase}', '{ascii_uppercase}') || p[2:]), '') AS titled FROM documents"
        ),
        "sca_strip_pictographs": cs.from_case(
            f"SELECT account_id, {stripped('synthetic_id_verdict')} AS label FROM q03", "q03"
        ),
        "sca_verdict_tier": cs.from_case(
            f"""SELECT verdict, COUNT(*) AS n, {tier('verdict')} AS tier FROM (
              SELECT control_efficiency_verdict AS verdict FROM q01 UNION ALL
              SELECT synthetic_id_verdict FROM q03 UNION ALL SELECT aml_verdict FROM q04 UNION ALL
              SELECT response_priority FROM q05 UNION ALL SELECT cross_subsidy_verdict FROM q06 UNION ALL
              SELECT sample_reliability FROM q07 UNION ALL SELECT pre_crime_verdict FROM q09 UNION ALL
              SELECT signal_strength_verdict FROM q10 UNION ALL SELECT {stripped('response_priority')} FROM q05)
            GROUP BY verdict""",
            "q01", "q03", "q04", "q05", "q06", "q07", "q09", "q10",
        ),
    }


def _verdicts(name: str, column: str) -> str:
    return cs.from_case(
        f"""SELECT {column} AS verdict, COUNT(*) AS n, {rnd('100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER ()', 1)} AS pct,
          {tier(column)} AS tier FROM {name} GROUP BY {column}""",
        name,
    )


def _portfolio(where: str) -> str:
    return cs.from_case(
        f"""SELECT {money('total_loss')} AS total_loss, {big('COALESCE(SUM(total_fraud_txns), 0)')} AS total_fraud_txns,
          (SELECT COUNT(*) FROM q05) AS ring_count,
          (SELECT COALESCE({rnd(shown('avg_days_to_spread'), 1)}, 0) FROM q05) AS avg_days_to_spread,
          (SELECT {money('loss_after_response_window_missed')} FROM q08) AS loss_to_response_lag
        FROM q01 {where}""",
        "q01", "q05", "q08",
    )


def result_oracles() -> dict[str, str]:
    flagged = f"({tier('synthetic_id_verdict')}) <> 'good'"
    mule_flagged = f"({tier('aml_verdict')}) <> 'good'"
    width = fv.HISTOGRAM_BIN
    bins = ", ".join(f"({i * width})" for i in range(fv.HISTOGRAM_BINS))
    in_bin = (
        f"synthetic_id_suspicion_score >= b AND (synthetic_id_suspicion_score < b + {width}"
        f" OR b = {(fv.HISTOGRAM_BINS - 1) * width})"
    )
    return {
        "res_portfolio_kpis": _portfolio(""),
        "res_portfolio_kpis_filtered": _portfolio("WHERE fraud_pattern = 'pattern_2'"),
        "res_loss_share": cs.from_case(
            f"""SELECT fraud_pattern, total_loss,
              {rnd('100 * total_loss / SUM(total_loss) OVER ()', 2)} AS loss_share_pct FROM q01""",
            "q01",
        ),
        "res_heatmap": over(
            f"""SELECT CAST(d AS INT) AS day, CAST(h AS INT) AS hour, COALESCE(txn, 0) AS txn, COALESCE(fraud, 0) AS fraud,
              COALESCE(rate, 0) AS rate,
              {rnd('COALESCE(COALESCE(rate, 0) / NULLIF((SELECT MAX(rate) FROM heat), 0), 0)', 4)} AS intensity
            FROM (SELECT * FROM RANGE(7) a(d), RANGE(24) b(h)) LEFT JOIN heat ON day = d AND hour = h""",
            _hourly,
            ("heat", HEAT),
        ),
        "res_metric_trend": cs.from_case(
            f"SELECT fraud_pattern, {', '.join(f'y_{y}' for y in cs.FRAUD_YEARS)} FROM q02 WHERE metric = 'avg_ip_risk'",
            "q02",
        ),
        "res_metric_names": cs.from_case("SELECT DISTINCT metric FROM q02", "q02"),
        "res_verdicts_identity": _verdicts("q03", "synthetic_id_verdict"),
        "res_verdicts_mule": _verdicts("q04", "aml_verdict"),
        "res_verdicts_rings": _verdicts("q05", "response_priority"),
        "res_precision": cs.from_case(
            f"""SELECT COUNT(*) AS accounts, COUNT(*) FILTER (WHERE {flagged}) AS flagged,
              {rnd(pct(flagged), 1)} AS flagged_pct,
              COUNT(*) FILTER (WHERE {flagged} AND is_fraudster = 1) AS confirmed_fraudsters,
              {rnd(div(f'100 * COUNT(*) FILTER (WHERE {flagged} AND is_fraudster = 1)',
                       f'COUNT(*) FILTER (WHERE {flagged})'), 1)} AS precision_pct,
              {rnd(shown('synthetic_id_suspicion_score'), 1)} AS avg_score FROM q03""",
            "q03",
        ),
        "res_score_histogram": cs.from_case(
            f"""SELECT CAST(b AS INT) AS bin_start, COUNT(*) FILTER (WHERE is_fraudster = 1) AS fraudsters,
              COUNT(*) FILTER (WHERE is_fraudster = 0) AS legitimate
            FROM (VALUES {bins}) bins(b) LEFT JOIN q03 ON {in_bin} GROUP BY b""",
            "q03",
        ),
        "res_mule_kpis": cs.from_case(
            f"""SELECT COUNT(*) AS accounts, COUNT(*) FILTER (WHERE {mule_flagged}) AS flagged,
              {rnd(pct(mule_flagged), 1)} AS flagged_pct,
              COUNT(*) FILTER (WHERE structuring_txn_count > 0) AS structuring_accounts,
              {rnd(shown('mule_suspicion_score'), 1)} AS avg_score FROM q04""",
            "q04",
        ),
        "res_mule_by_type": cs.from_case(
            f"SELECT account_type, {rnd(shown('mule_suspicion_score'), 2)} AS avg_mule_score FROM q04 GROUP BY 1", "q04"
        ),
        "res_ring_kpis": cs.from_case(
            f"""SELECT COUNT(*) AS rings, {rnd(shown('connected_accounts'), 1)} AS avg_ring_size,
              {rnd(shown('avg_days_to_spread'), 1)} AS avg_days_to_spread,
              COUNT(*) FILTER (WHERE response_priority LIKE '%CRITICAL%') AS critical_rings,
              MIN(first_replication_speed_days) AS fastest_replication_days FROM q05""",
            "q05",
        ),
        "res_ring_points": cs.from_case(
            f"SELECT ring_id, connected_accounts, avg_days_to_spread, {tier('response_priority')} AS tier FROM q05", "q05"
        ),
        "res_lag_kpis": cs.from_case(
            f"""SELECT rings, preventable, within_window, after_window,
              {rnd(div('100 * within_window', 'preventable'), 1)} AS within_pct,
              {rnd(div('100 * after_window', 'preventable'), 1)} AS after_pct,
              {rnd(div('preventable', 'rings'), 2)} AS avg_per_ring
            FROM (SELECT COUNT(*) AS rings, {money('preventable_loss_usd')} AS preventable,
              {money('loss_within_5day_response_window')} AS within_window,
              {money('loss_after_response_window_missed')} AS after_window FROM q08)""",
            "q08",
        ),
        "res_top_rings": cs.from_case(
            f"""SELECT ring_id, preventable_loss_usd, loss_within_5day_response_window,
              loss_after_response_window_missed FROM q08
            ORDER BY preventable_loss_usd DESC, ring_id LIMIT {fv.TOP_RINGS}""",
            "q08",
        ),
        "res_drift_kpis": cs.from_case(
            f"""SELECT COUNT(*) AS accounts, {rnd(shown('drift_signals_positive'), 2)} AS avg_signals,
              COUNT(*) FILTER (WHERE drift_signals_positive = 4) AS all_four_positive,
              {rnd(shown('ip_drift'), 1)} AS avg_ip_drift FROM q09""",
            "q09",
        ),
        "res_drift_histogram": cs.from_case(
            """SELECT s AS signals, COUNT(account_id) AS accounts
            FROM (VALUES (1), (2), (3), (4)) v(s) LEFT JOIN q09 ON drift_signals_positive = s GROUP BY s""",
            "q09",
        ),
        "res_drift_points": cs.from_case(
            """SELECT account_id, ip_drift, velocity_drift, drift_signals_positive = 4 AS all_four_positive FROM q09""",
            "q09",
        ),
        "res_predecessor_totals": cs.from_case(
            f"SELECT pattern_a, {big('SUM(times_flagged_as_predecessor)')} AS times_flagged FROM q10 GROUP BY 1", "q10"
        ),
        "res_transition_points": cs.from_case(
            f"""SELECT pattern_a, year_a, pattern_b, year_b, behavioural_distance, median_distance_in_cohort,
              {tier('signal_strength_verdict')} AS tier FROM q10""",
            "q10",
        ),
    }


def oracles() -> dict[str, str]:
    return {**cs.case_oracles(), **operator_oracles(), **result_oracles()}
