"""The fixed values, pinned as literals: SQL and code both read them, so neither would notice a wrong one."""

from tamarack import fixed_values as fv


def test_thresholds():
    assert fv.EFFICIENCY_GAP == 5 and fv.YEARS == (2022, 2023, 2024)
    assert (fv.MIN_AGE_DAYS, fv.Z_CLIP, sum(fv.SYNTHETIC_WEIGHTS.values())) == (30, 3, 100)
    assert [cut for cut, _ in fv.SYNTHETIC_CUTS] == [75, 50, 25]
    assert fv.STRUCTURING_BANDS == ((990, 999), (4990, 4999), (9990, 9999)) and fv.NIGHT_HOURS == (0, 5)
    assert fv.MULE_RULES == {
        "foreign_txn_count": (10, 30, 3.0),
        "peak_velocity": (8, 25, 3.0),
        "pct_night_activity": (40, 25, 0.6),
    }
    assert (fv.STRUCTURING_POINTS, fv.MULE_MIN_SCORE, fv.BURST_VELOCITY) == (20, 20, 8)
    assert [cut for cut, _ in fv.MULE_CUTS] == [60, 40]
    assert [cut for cut, _ in fv.RESPONSE_CUTS] == [10, 50] and fv.RISK_CUT == 30
    assert (fv.WINDOW_MIN_TXNS, fv.WINDOW_TOP) == (200, 25) and [cut for cut, _ in fv.RELIABILITY_CUTS] == [500, 200]
    assert fv.RESPONSE_WINDOW_DAYS == 5 and fv.MIN_PRE_TXNS == 10 and fv.REPEAT_TIMES == 2
    assert (fv.HISTOGRAM_BIN, fv.HISTOGRAM_BINS, fv.PAGE_SIZE, fv.TOP_RINGS) == (10, 10, 25, 20)


def test_weights_and_metrics():
    assert fv.SYNTHETIC_WEIGHTS == {
        "countries_per_year": 20,
        "category_diversity_ratio": 20,
        "foreign_txn_pct": 20,
        "avg_ip_risk": 20,
        "avg_velocity": 10,
        "avg_credit_utilization_pct": 10,
    }
    assert tuple(fv.READINGS) == fv.YOY_METRICS == (
        "attacks", "avg_attack_size", "avg_velocity", "avg_ip_risk", "behavioural_disguise_score",
        "pct_bypassing_2fa", "pct_using_known_device",
    )


def test_texts():
    assert (fv.UNDER_POLICED, fv.OVER_POLICED, fv.BALANCED) == (
        "🔴 UNDER-POLICED — Bleeding silently", "🟡 OVER-POLICED — Wasting resources", "🟢 Balanced"
    )
    assert [t for _, t in fv.SYNTHETIC_CUTS] == ["🔴 Likely Synthetic Identity", "🟠 Suspicious — Review Required", "🟡 Elevated — Monitor"]
    assert (fv.SYNTHETIC_OK, fv.SYNTHETIC_IMMATURE) == ("🟢 Likely Legitimate", "⚪ Insufficient history (<30 days) — monitor only")
    assert (fv.MULE_BURST, *[t for _, t in fv.MULE_CUTS], fv.MULE_NORMAL) == (
        "🔴 Structuring + Burst — AML Escalate", "🔴 High Probability Mule Account", "🟠 Suspicious — SAR Filing Candidate", "🟢 Normal"
    )
    assert [*[t for _, t in fv.RESPONSE_CUTS], fv.RESPONSE_STANDARD] == [
        "🔴CRITICAL - manual response too slow, auto-suppress", "🟠HIGH - fast-track manual review", "🟢STANDARD - manual quarantine feasible"
    ]
    assert [*[t for _, t in fv.RELIABILITY_CUTS], fv.RELIABILITY_LOW] == ["🔴High confidence", "🟠Moderate confidence", "🟢Low confidence"]
    assert (fv.SUBSIDISING, fv.SUBSIDISED, fv.FAIRLY_PRICED) == (
        "🟢 SUBSIDISING — pays more than its own risk warrants under flat pricing",
        "🔴 SUBSIDISED — pays less than its own risk costs under flat pricing",
        "🟡 Roughly priced in line with its own risk",
    )
    assert (fv.DRIFT_FOUND, fv.DRIFT_NONE) == ("🔴 Pre-crime drift detected — escalate for early review", "🟢 No clear drift")
    assert (fv.REPEAT_DONOR, fv.SINGLE_MATCH) == (
        "🔴 REPEAT DONOR — recurring signal, worth investigating", "🟡 Single-year match — treat as noise until repeated"
    )
    assert [*fv.TIME_WINDOWS, fv.TIME_WINDOW_REST] == [
        (0, 5, "Night (0-5h)"), (6, 11, "Morning (6-11h)"), (12, 17, "Afternoon (12-17h)"), "Evening (18-23h)"
    ]
