"""Fixed values.

Texts, thresholds, weights and word lists whose value decides whether a result
is right. They are stated here once: rules in the order in which they are
tested, metrics in the order of ``YOY_METRICS``.
"""

# --- Q1 control efficiency ---------------------------------------------------
EFFICIENCY_GAP = 5
UNDER_POLICED = "🔴 UNDER-POLICED — Bleeding silently"
OVER_POLICED = "🟡 OVER-POLICED — Wasting resources"
BALANCED = "🟢 Balanced"

# --- Q2 yearly evolution -----------------------------------------------------
YEARS = (2022, 2023, 2024)
YOY_METRICS = (
    "attacks",
    "avg_attack_size",
    "avg_velocity",
    "avg_ip_risk",
    "behavioural_disguise_score",
    "pct_bypassing_2fa",
    "pct_using_known_device",
)
TREND_UNKNOWN = "Not enough data"
TREND_UP = "Increasing YoY"
TREND_DOWN = "Decreasing YoY"
TREND_FLAT = "No change YoY"
READING_UNKNOWN = "Not enough data to assess trend"
READING_FLAT = "No change"
# metric -> (reading when it rises, reading when it falls)
READINGS = {
    "attacks": (
        "📈 Attack volume growing",
        "Attack volume shrinking",
    ),
    "avg_attack_size": (
        "💰 Attacks growing larger in value",
        "Attacks shrinking in value",
    ),
    "avg_velocity": (
        "⚡ Attacks executing faster (more transactions packed into each 1h window)",
        "Attack speed slowing down",
    ),
    "avg_ip_risk": (
        "Fraud IPs looking more suspicious (easier to catch)",
        "🕵️ Fraud IPs blending in with normal traffic (harder to catch)",
    ),
    "behavioural_disguise_score": (
        "🎭 Drifting further from customer's normal spend (worth checking which direction — 1.0 is the true camouflage point)",
        "🎭 Moving toward customer's normal spend (check if approaching 1.0 = better disguise)",
    ),
    "pct_bypassing_2fa": (
        "🔓 More fraud getting past 2FA — auth control being compromised",
        "2FA increasingly stopping fraud",
    ),
    "pct_using_known_device": (
        "📱 More fraud from recognized/trusted devices — device hijacking escalating",
        "Less fraud from recognized devices",
    ),
}

# --- Q3 synthetic identity ---------------------------------------------------
MIN_AGE_DAYS = 30
Z_CLIP = 3
# metric -> points at the clip
SYNTHETIC_WEIGHTS = {
    "countries_per_year": 20,
    "category_diversity_ratio": 20,
    "foreign_txn_pct": 20,
    "avg_ip_risk": 20,
    "avg_velocity": 10,
    "avg_credit_utilization_pct": 10,
}
# (score from which the verdict holds, verdict)
SYNTHETIC_CUTS = (
    (75, "🔴 Likely Synthetic Identity"),
    (50, "🟠 Suspicious — Review Required"),
    (25, "🟡 Elevated — Monitor"),
)
SYNTHETIC_OK = "🟢 Likely Legitimate"
SYNTHETIC_IMMATURE = "⚪ Insufficient history (<30 days) — monitor only"

# --- Q4 money mule -----------------------------------------------------------
STRUCTURING_BANDS = ((990, 999), (4990, 4999), (9990, 9999))
NIGHT_HOURS = (0, 5)
# signal -> (cap, points above the cap, points per unit up to it)
MULE_RULES = {
    "foreign_txn_count": (10, 30, 3.0),
    "peak_velocity": (8, 25, 3.0),
    "pct_night_activity": (40, 25, 0.6),
}
STRUCTURING_POINTS = 20
MULE_MIN_SCORE = 20
BURST_VELOCITY = 8
MULE_BURST = "🔴 Structuring + Burst — AML Escalate"
# (score from which the verdict holds, verdict)
MULE_CUTS = (
    (60, "🔴 High Probability Mule Account"),
    (40, "🟠 Suspicious — SAR Filing Candidate"),
)
MULE_NORMAL = "🟢 Normal"

# --- Q5 ring contagion -------------------------------------------------------
# (days below which the priority holds, priority)
RESPONSE_CUTS = (
    (10, "🔴CRITICAL - manual response too slow, auto-suppress"),
    (50, "🟠HIGH - fast-track manual review"),
)
RESPONSE_STANDARD = "🟢STANDARD - manual quarantine feasible"

# --- Q6 cross-subsidy --------------------------------------------------------
RISK_CUT = 30
SUBSIDISING = "🟢 SUBSIDISING — pays more than its own risk warrants under flat pricing"
SUBSIDISED = "🔴 SUBSIDISED — pays less than its own risk costs under flat pricing"
FAIRLY_PRICED = "🟡 Roughly priced in line with its own risk"

# --- Q7 attack window --------------------------------------------------------
WINDOW_MIN_TXNS = 200
WINDOW_TOP = 25
# (first hour, last hour, name)
TIME_WINDOWS = (
    (0, 5, "Night (0-5h)"),
    (6, 11, "Morning (6-11h)"),
    (12, 17, "Afternoon (12-17h)"),
)
TIME_WINDOW_REST = "Evening (18-23h)"
WEEKEND, WEEKDAY = "Weekend", "Weekday"
FOREIGN, DOMESTIC = "Foreign", "Domestic"
NO_2FA, HAS_2FA = "No 2FA", "Has 2FA"
# (transactions from which the label holds, label)
RELIABILITY_CUTS = (
    (500, "🔴High confidence"),
    (200, "🟠Moderate confidence"),
)
RELIABILITY_LOW = "🟢Low confidence"

# --- Q8 response lag ---------------------------------------------------------
RESPONSE_WINDOW_DAYS = 5

# --- Q9 pre-crime drift ------------------------------------------------------
MIN_PRE_TXNS = 10
DRIFT_FOUND = "🔴 Pre-crime drift detected — escalate for early review"
DRIFT_NONE = "🟢 No clear drift"

# --- Q10 pattern evolution ---------------------------------------------------
REPEAT_TIMES = 2
REPEAT_DONOR = "🔴 REPEAT DONOR — recurring signal, worth investigating"
SINGLE_MATCH = "🟡 Single-year match — treat as noise until repeated"

# --- result summaries --------------------------------------------------------
NEUTRAL_TIER = "neutral"
# (marks, tier): the first mark found anywhere in the verdict decides
TIER_MARKS = (
    (("🔴",), "critical"),
    (("🟠",), "watch"),
    (("🟡",), "caution"),
    (("🟢", "💚"), "good"),
)
# (first words, tier): for verdicts written without a mark
TIER_WORDS = (
    (("CRITICAL",), "critical"),
    (("HIGH",), "watch"),
    (("STANDARD", "LOW"), "good"),
)
PICTOGRAPHS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
HISTOGRAM_BIN = 10
HISTOGRAM_BINS = 10
PAGE_SIZE = 25
TOP_RINGS = 20
NO_FILTER = "all"
NO_COLUMN_FILTER = "__all__"
