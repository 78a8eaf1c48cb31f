"""Column functions at their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack import fixed_values as fv
from tamarack import functions as fn


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def num(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(
    "x, digits, expected",
    [(161 / 40, 2, 4.03), (2.675, 2, 2.68), (-0.125, 2, -0.13), (0.35, 1, 0.4), (1.005, 2, 1.01), (None, 2, None)],
)
def test_round_is_half_away_from_zero_on_the_exact_value(spark, x, digits, expected):
    assert value(spark, fn.round_exact(num(x), digits)) == expected


def test_division_by_zero_or_null_is_null(spark):
    assert value(spark, fn.safe_div(num(1), num(0))) is None
    assert value(spark, fn.safe_div(num(1), num(None))) is None
    assert value(spark, fn.per_year(num(2), num(0))) is None
    assert value(spark, fn.per_year(num(2), num(73))) == 10.0


def test_pct_change(spark):
    assert value(spark, fn.pct_change(num(110), num(100))) == pytest.approx(10)
    assert value(spark, fn.pct_change(num(110), num(0))) is None
    assert value(spark, fn.pct_change(num(110), num(None))) is None


@pytest.mark.parametrize("z, expected", [(-1, 0.0), (1.5, 1.5), (9, 3.0), (None, 0.0)])
def test_clip_treats_null_as_unremarkable(spark, z, expected):
    assert value(spark, fn.clip(num(z), 0, 3)) == expected


def test_weighted_clip_score_reaches_the_weights_at_the_clip(spark):
    zs = {m: num(5) for m in fv.SYNTHETIC_WEIGHTS}
    assert value(spark, fn.weighted_clip_score(zs, fv.SYNTHETIC_WEIGHTS, 3)) == pytest.approx(100)
    zs["avg_velocity"] = num(1.5)
    assert value(spark, fn.weighted_clip_score(zs, fv.SYNTHETIC_WEIGHTS, 3)) == pytest.approx(95)


@pytest.mark.parametrize("x, expected", [(10, 30.0), (11, 30.0), (9, 27.0), (None, None)])
def test_capped(spark, x, expected):
    assert value(spark, fn.capped(num(x), *fv.MULE_RULES["foreign_txn_count"])) == expected


def test_euclid_and_positive_count(spark):
    assert value(spark, fn.euclid([num(0), num(1)], [num(3), num(5)])) == 5.0
    assert value(spark, fn.positive_count(num(1), num(0), num(-1), num(None), num(0.1))) == 2


def test_aggregate_means(spark):
    df = spark.createDataFrame([(True, 2), (False, 5), (None, 7), (True, None)], "flag boolean, x int")
    row = df.agg(
        fn.mean(F.col("x")).alias("mean"),
        fn.mean_if(F.col("flag"), F.col("x")).alias("mean_if"),
        fn.mean_if(F.col("x") > 100, F.col("x")).alias("none"),
        fn.sum_if(F.col("x") > 100, F.col("x")).alias("sum_none"),
        fn.pct_true(F.col("flag")).alias("pct"),
        fn.pct_true(~F.col("flag")).alias("pct_not"),
        fn.sd_or_null(F.col("x")).alias("sd"),
    ).first()
    assert row.mean == pytest.approx(14 / 3) and row.mean_if == 2 and row.none is None and row.sum_none == 0
    assert row.pct == pytest.approx(200 / 3) and row.pct_not == pytest.approx(100 / 3)
    assert row.sd == pytest.approx(2.5166115)


def test_deviation_of_constant_or_single_value_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 4.0)], "k string, x double")
    assert {r.k: r.sd for r in df.groupBy("k").agg(fn.sd_or_null(F.col("x")).alias("sd")).collect()} == {
        "a": None,
        "b": None,
    }


@pytest.mark.parametrize(
    "hour, name",
    [(0, "Night (0-5h)"), (5, "Night (0-5h)"), (6, "Morning (6-11h)"), (17, "Afternoon (12-17h)"),
     (18, "Evening (18-23h)"), (None, "Evening (18-23h)")],
)
def test_time_window(spark, hour, name):
    assert value(spark, fn.time_window(F.lit(hour).cast("int"))) == name


def test_unknown_flag_takes_the_second_label(spark):
    unknown = F.lit(None).cast("boolean")
    assert value(spark, fn.label_flag(~unknown, fv.NO_2FA, fv.HAS_2FA)) == "Has 2FA"


@pytest.mark.parametrize(
    "verdict, tier",
    [("🔴 x", "critical"), ("a 🟠", "watch"), ("🟡", "caution"), ("🟢 y", "good"), ("💚 y", "good"),
     ("CRITICAL - z", "critical"), ("High confidence", "watch"), ("Standard", "good"), ("low", "good"),
     ("Moderate confidence", "neutral"), ("", "neutral"), (None, "neutral"), (fv.SYNTHETIC_IMMATURE, "neutral"),
     ("🟢 then 🔴", "critical")],
)
def test_verdict_tier(spark, verdict, tier):
    assert value(spark, fn.verdict_tier(F.lit(verdict).cast("string"))) == tier


@pytest.mark.parametrize(
    "text, expected",
    [("card_not_present", "Card Not Present"), ("atm_FRAUD", "Atm FRAUD"), ("don't a-b", "Don'T A-B"), (None, ""),
     ("2fa ém", "2fa éM"), ("  x", "  X")],
)
def test_title_case(spark, text, expected):
    assert value(spark, fn.title_case(F.lit(text).cast("string"))) == expected


def test_strip_pictographs(spark):
    assert value(spark, fn.strip_pictographs(F.lit("🔴 Structuring + Burst — AML Escalate"))) == (
        "Structuring + Burst — AML Escalate"
    )
    assert value(spark, fn.strip_pictographs(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("change, reading", [(1.0, 0), (-1.0, 1)])
def test_interpretations(spark, change, reading):
    for metric, texts in fv.READINGS.items():
        assert value(spark, fn.interpret(F.lit(metric), num(change))) == texts[reading]
    assert value(spark, fn.interpret(F.lit("other"), num(change))) == "No change"
    assert value(spark, fn.interpret(F.lit("attacks"), num(0))) == "No change"
    assert value(spark, fn.interpret(F.lit("attacks"), num(None))) == "Not enough data to assess trend"


def test_times_do_not_depend_on_the_session_zone(spark):
    a, b = dt.datetime(2022, 3, 26, 12), dt.datetime(2022, 3, 27, 15, 0, 0, 500000)
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    columns = [
        fn.days_between(F.col("a"), F.col("b")).alias("days"),
        fn.micros(F.col("a")).alias("micros"),
        fn.plus_days(F.col("a"), 5).alias("later"),
        fn.year_of(F.col("b")).alias("year"),
        fn.hour_start(F.expr("TIMESTAMP_NTZ'2022-03-27 02:30:00'")).alias("hour"),  # an hour Berlin skipped
    ]
    expected = df.select(columns).first()
    assert expected.days == pytest.approx(1.125 + 0.5 / 86400) and expected.later == dt.datetime(2022, 3, 31, 12)
    assert expected.micros == int((a - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 and expected.year == 2022
    assert expected.hour == dt.datetime(2022, 3, 27, 2)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # the clock changed in between
    try:
        assert df.select(columns).first() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
