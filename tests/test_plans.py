"""What the physical plans must and must not contain."""

import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tamarack import registry
from tamarack.operators import ranking, rings
from tamarack.operators.medians import exact_median
from tamarack.operators.timeline import totals_after
from tamarack.plans.derived import account_totals
from tamarack.plans.pattern_evolution import pattern_evolution
from tamarack.plans.precrime_drift import precrime_drift
from tamarack.plans.resource_efficiency import resource_efficiency
from tamarack.plans.response_lag import response_lag
from tamarack.plans.ring_contagion import contagion_speed, ring_contagion
from tamarack.plans.synthetic_identity import synthetic_identity
from tamarack.plans.yoy_evolution import yoy_evolution
from tamarack.session import stored
from tests import frames


def executed_plan(df):
    """Final adaptive plan without the initial plans beside it."""
    df.collect()
    kept, hide = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if hide is None and "== Initial Plan ==" in line:
            hide = depth
        elif hide is not None and line.strip() and depth < hide:
            hide = None
        if hide is None:
            kept.append(line)
    return "\n".join(kept)


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Transactions as a parquet table, as they would lie on a cluster."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        fraud = i > 1200 and rng.random() < 0.2
        rows.append(
            {
                "account_id": f"A{rng.randrange(40)}",
                "ts": frames.after(i // 3),
                "is_fraud": fraud,
                "fraud_pattern": f"p{rng.randrange(4)}" if fraud else None,
                "velocity_1h": rng.randrange(9),
                "ip_risk_score": rng.randrange(100),
                "is_foreign_txn": rng.random() < 0.5,
                "card_present": rng.random() < 0.5,
                "has_2fa": rng.random() < 0.5,
            }
        )
    path = str(tmp_path_factory.mktemp("tx") / "transactions")
    frames.transactions(spark, rows).write.parquet(path)
    return path


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_rows_and_no_products(spark, small, name):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filter_and_columns_reach_the_scan(spark, lake):
    tx = spark.read.parquet(lake)
    patterns = spark.createDataFrame(
        [("p0", 1.0, 2.0, 3.0)],
        "fraud_pattern string, avg_velocity_1h double, pct_card_not_present double, pct_foreign double",
    )
    plan = executed_plan(resource_efficiency(tx, patterns))
    scans = re.findall(r"FileScan parquet \[(.*?)\].*?PushedFilters: \[(.*?)\]", plan)
    assert len(scans) == 1, "the totals must reuse the shuffle of the rows"
    columns, pushed = scans[0]
    assert {c.split("#")[0] for c in columns.split(",")} == {"amount", "is_fraud", "fraud_pattern"}
    assert "EqualTo(is_fraud,true)" in pushed and "IsNotNull(fraud_pattern)" in pushed
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("build, scans", [(yoy_evolution, 1), (pattern_evolution, 1), (precrime_drift, 3), (account_totals, 1)])
def test_scans_of_the_transactions(spark, lake, build, scans):
    plan = executed_plan(build(spark.read.parquet(lake)))
    assert "ResultQueryStage" in plan and len(re.findall("FileScan parquet", plan)) <= scans


def test_account_totals_shuffle_once(spark, lake):
    """The distinct values travel with the sums; what one shuffle has dealt is not dealt again."""
    plan = account_totals(spark.read.parquet(lake))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_medians_read_their_input_once(spark, lake):
    plan = executed_plan(exact_median(spark.read.parquet(lake), ["fraud_pattern"], "amount", "median"))
    assert len(re.findall("FileScan parquet", plan)) == 1 and "ReusedExchange" in plan


def jobs_of(spark, build):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    build()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


@pytest.mark.parametrize("name", ["synthetic_identity", "ring_contagion", "response_lag", "precrime_drift", "page"])
def test_building_a_query_starts_no_job(spark, lake, name):
    tx = spark.read.parquet(lake)
    edges = frames.edges(spark, [("A1", "A2", "R")])
    builds = {
        "synthetic_identity": lambda: synthetic_identity(frames.accounts(spark, [{"account_id": "A1", "account_age_days": 99}])),
        "ring_contagion": lambda: ring_contagion(tx, edges),
        "response_lag": lambda: response_lag(tx, edges),
        "precrime_drift": lambda: precrime_drift(tx),
        "page": lambda: ranking.page(tx, [("amount", "desc"), ("transaction_id",)], 7),
    }
    assert jobs_of(spark, lambda: tx.count()) > 0
    assert jobs_of(spark, builds[name]) == 0


def test_an_account_with_all_its_fraud_on_one_day_is_divided(spark):
    """A third of all fraud is one account's, on one day; no window holds it together."""
    at = F.expr("timestampadd(SECOND, CAST(id % 86400 AS INT), TIMESTAMP_NTZ'2022-03-01 00:00:00')")
    key = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("A"), F.col("id") % 500))
    events = spark.range(30_000).select(key.alias("key"), at.alias("ts"), F.lit(1).cast("bigint").alias("n"))
    marks = events.filter("id % 10 = 0").select("key", "ts", F.lit("m").alias("mark"))
    with settings(spark, spark__sql__shuffle__partitions="64", spark__sql__adaptive__coalescePartitions__enabled="false"):
        plan = executed_plan(totals_after(events, marks, "key", "ts", {"n": "later"}))
        assert re.search(r"hashpartitioning\(key#\d+, _minute#\d+, 64\)", plan)
        by_minute = events.withColumn("_minute", F.date_trunc("minute", "ts")).repartition(64, "key", "_minute")
        assert by_minute.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2_000


def test_a_hot_ring_is_divided_where_members_meet_their_seed(spark):
    """A third of the members belong to one ring; adaptive execution splits its partition."""
    members = stored(
        spark.range(30000).select(
            F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("R"), F.col("id") % 5000)).alias("ring_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("account_id"),
            F.timestamp_add("MINUTE", F.col("id"), F.expr("TIMESTAMP_NTZ'2022-01-01 00:00:00'")).alias(
                "first_fraud_date"
            ),
        ),
        "members",
    )
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__shuffle__partitions="16",
    ):
        pairs = rings.ring_pairs(members.repartition(8))
        assert pairs.count() == 30000 - 1 - 5000
        plan = executed_plan(pairs.groupBy("account_id").count())
    assert "skew=true" in plan


def test_contagion_never_joins_members_with_their_ring(spark):
    """Each task passes on at most two rows per ring, and sums the rest."""
    rows = [("R", a, frames.after(i)) for i, a in enumerate("ABC")]
    members = spark.createDataFrame(rows, "ring_id string, account_id string, first_fraud_date timestamp_ntz")
    plan = contagion_speed(members)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan and plan.count("Join") == 1
