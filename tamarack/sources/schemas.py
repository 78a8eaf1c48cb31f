"""Declared schemas of the five tables.

``timestamp`` of the transactions is named ``ts``. Flags that arrive as 0/1
numbers are read with that type and made integers by ``normalise_flags``.
"""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, FLAG, INT, SMALL, TIME = T.StringType(), T.BooleanType(), T.IntegerType(), T.ShortType(), T.TimestampNTZType()


def dec(precision: int, scale: int) -> T.DecimalType:
    return T.DecimalType(precision, scale)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ACCOUNT_PROFILES = _schema(
    account_id=TEXT,
    account_age_days=INT,
    credit_limit=dec(12, 2),
    home_country=TEXT,
    risk_score=dec(6, 2),
    is_high_risk=dec(3, 1),
    avg_txn_amount=dec(12, 2),
    avg_monthly_txns=dec(10, 2),
    has_2fa=dec(3, 1),
    account_type=TEXT,
    total_transactions=dec(12, 2),
    total_amount=dec(14, 2),
    avg_amount=dec(12, 2),
    max_amount=dec(12, 2),
    fraud_count=dec(10, 2),
    fraud_amount=dec(14, 2),
    pct_foreign=dec(6, 4),
    avg_velocity=dec(8, 4),
    unique_countries=dec(6, 2),
    unique_categories=dec(6, 2),
    avg_ip_risk=dec(6, 2),
    fraud_rate=dec(8, 6),
    is_fraudster=dec(3, 1),
)
ACCOUNT_FLAGS = ("is_high_risk", "has_2fa", "is_fraudster")

FRAUD_PATTERNS = _schema(
    fraud_pattern=TEXT,
    description=TEXT,
    transaction_count=INT,
    fraud_share_pct=dec(6, 2),
    avg_amount=dec(12, 2),
    median_amount=dec(12, 2),
    pct_night_0_5=dec(6, 2),
    pct_foreign=dec(6, 2),
    pct_card_not_present=dec(6, 2),
    avg_velocity_1h=dec(8, 4),
    avg_ip_risk=dec(6, 2),
    pct_no_2fa=dec(6, 2),
)

# the edge file has no id column; the id is a serial number that nothing reads
NETWORK_EDGES = _schema(
    account_a=TEXT, account_b=TEXT, shared_type=TEXT, connection_count=INT, ring_id=TEXT, both_fraud=FLAG
)

TIME_SERIES_STATS = _schema(
    hour=TIME,
    transaction_count=INT,
    fraud_count=INT,
    total_amount=dec(14, 2),
    avg_amount=dec(12, 2),
    avg_ip_risk=dec(6, 2),
    fraud_rate=dec(8, 6),
    hour_of_day=SMALL,
    day_of_week=SMALL,
    is_weekend=FLAG,
)

TRANSACTIONS = _schema(
    transaction_id=TEXT,
    account_id=TEXT,
    ts=TIME,
    hour_of_day=SMALL,
    day_of_week=SMALL,
    is_weekend=FLAG,
    amount=dec(12, 2),
    merchant_category=TEXT,
    mcc_code=SMALL,
    merchant_country=TEXT,
    card_present=FLAG,
    device_type=TEXT,
    device_known=FLAG,
    ip_risk_score=dec(6, 2),
    is_foreign_txn=FLAG,
    time_since_last_s=INT,
    velocity_1h=INT,
    amount_vs_avg_ratio=dec(10, 4),
    account_age_days=INT,
    has_2fa=FLAG,
    credit_limit=dec(12, 2),
    is_fraud=FLAG,
    fraud_pattern=TEXT,
)

HEATMAP = _schema(day=INT, hour=INT, txn=T.LongType(), fraud=T.LongType(), rate=T.DoubleType())
