"""Small hand-made tables in the shape of the fraud tables."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from tamarack.sources import schemas

START = dt.datetime(2022, 3, 1, 12, 0, 0)
DEFAULTS = {
    "hour_of_day": 12,
    "day_of_week": 1,
    "is_weekend": False,
    "amount": "10.00",
    "merchant_category": "travel",
    "merchant_country": "US",
    "card_present": True,
    "device_type": "web",
    "device_known": True,
    "ip_risk_score": "10.00",
    "is_foreign_txn": False,
    "velocity_1h": 1,
    "amount_vs_avg_ratio": "1.0000",
    "has_2fa": True,
    "is_fraud": False,
}


def _rows(schema, defaults, rows):
    def typed(field, value):
        return Decimal(str(value)) if isinstance(field.dataType, T.DecimalType) and value is not None else value

    return [tuple(typed(f, {**defaults, **row}.get(f.name)) for f in schema) for row in rows]


def transactions(spark, rows):
    numbered = [{"transaction_id": f"T{i:05d}", "ts": START, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(_rows(schemas.TRANSACTIONS, DEFAULTS, numbered), schemas.TRANSACTIONS)


def accounts(spark, rows):
    return spark.createDataFrame(_rows(schemas.ACCOUNT_PROFILES, {}, rows), schemas.ACCOUNT_PROFILES)


def edges(spark, pairs):
    """(account_a, account_b, ring) or (…, both_fraud)"""
    rows = [(p[0], p[1], "device", 1, p[2], p[3] if len(p) > 3 else True) for p in pairs]
    return spark.createDataFrame(rows, schemas.NETWORK_EDGES)


def after(days=0, **delta):
    return START + dt.timedelta(days=days, **delta)
