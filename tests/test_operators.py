"""Operators against brute force, with groups made hot by small limits."""

import datetime as dt
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamarack.operators import filters, joins, medians, quality, ranking, reshape, rings, sequences, timeline, totals
from tests import frames

T0 = dt.datetime(2022, 1, 1)


def random_events(seed, n=600, keys=6, span=40 * 24 * 60):
    """Events with ties in time; a third of them belong to one key."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 1 / 3 else f"k{rng.randrange(keys)}", T0 + dt.timedelta(minutes=rng.randrange(span)), i, rng.randrange(1, 50))
        for i in range(n)
    ]


EVENTS = "key string, ts timestamp_ntz, id int, x int"


# --- filters ---


def test_flags_drop_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    assert [r.id for r in filters.where_flag(df, "f").collect()] == [1]
    assert [r.id for r in filters.where_flag(df, "f", False).collect()] == [2]


def test_structuring_bands_include_their_ends(spark):
    amounts = ["989.99", "990.00", "999.00", "999.01", "4990.00", "9999.00", "9999.01"]
    df = spark.createDataFrame([(a,) for a in amounts], "a string").withColumn("a", F.col("a").cast("decimal(12,2)"))
    found = df.filter(filters.in_bands(F.col("a"), ((990, 999), (4990, 4999), (9990, 9999)))).collect()
    assert [str(r.a) for r in found] == ["990.00", "999.00", "4990.00", "9999.00"]


def test_search_and_filters(spark):
    df = spark.createDataFrame([("ACC1", None, 1), ("acc2", "US", 2), (None, "usa", 3)], "a string, b string, n int")
    assert {r.n for r in filters.text_search(df, ["a", "b"], "aCC").collect()} == {1, 2}
    assert {r.n for r in filters.text_search(df, ["a", "b"], "us").collect()} == {2, 3}
    assert filters.text_search(df, ["a"], "").count() == 3
    assert {r.n for r in filters.equals_all(df, {"n": "2", "b": "__all__"}).collect()} == {2}
    assert filters.dimension_filter(df, "b", "all").count() == 3
    assert {r.n for r in filters.dimension_filter(df, "b", "US").collect()} == {2}


# --- totals ---


def test_totals_beside_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "k string, x int")
    rows = {r.k: r for r in totals.with_totals(df, {"s": F.sum("x"), "n": F.count("x")}).collect()}
    assert all(r.s == 4 and r.n == 2 for r in rows.values()) and set(rows) == {"a", "b", "c"}
    shares = {r.k: r.p for r in totals.share_of_total(df, "x", "p").collect()}
    assert shares == {"a": 25.0, "b": 75.0, "c": None}


def test_share_of_zero_total_is_null(spark):
    df = spark.createDataFrame([("a", 0)], "k string, x int")
    assert totals.share_of_total(df, "x", "p").first().p is None


# --- joins ---


@pytest.mark.parametrize("how", ["inner", "left"])
def test_divisible_join(spark, how):
    rows = spark.createDataFrame([(f"k{i % 7}" if i % 3 else "hot", i) for i in range(300)] + [(None, -1)], "key string, id int")
    stats = spark.createDataFrame([("hot", 1.0), *[(f"k{i}", float(i)) for i in range(5)]], "key string, m double")
    plain = rows.join(stats, "key", how)
    assert sorted(map(str, joins.divisible_join(rows, stats, ["key"], how).collect())) == sorted(map(str, plain.collect()))


# --- sequences ---


def brute_sequence(events):
    groups = defaultdict(list)
    for e in events:
        groups[e[0]].append(e)
    return {
        e[2]: (i + 1, len(g)) for g in groups.values() for i, e in enumerate(sorted(g, key=lambda e: (e[1], e[2])))
    }


@pytest.mark.parametrize("hot", ["hot", None])
def test_sequence(spark, hot):
    """A third of the rows belong to one key, which may be NULL."""
    events = [(hot if e[0] == "hot" else e[0], *e[1:]) for e in random_events(7)]
    df = spark.createDataFrame(events, EVENTS)
    numbered = sequences.sequence(df, "key", "ts", "id")
    assert {r.id: (r.rn, r.group_rows) for r in numbered.collect()} == brute_sequence(events)


def test_first_per_group_settles_ties(spark):
    rows = [("r", T0, "b"), ("r", T0, "a"), ("s", T0 + dt.timedelta(1), "z"), ("s", T0 + dt.timedelta(2), "c")]
    df = spark.createDataFrame(rows, "ring string, ts timestamp_ntz, account string")
    first = sequences.first_per_group(df, ["ring"], ["ts", "account"])
    assert {(r.ring, r.account) for r in first.collect()} == {("r", "a"), ("s", "z")}


def test_odd_history_has_the_larger_late_half(spark):
    df = spark.range(1, 12).withColumn("p", sequences.half_split(F.col("id"), F.lit(11)))
    assert Counter(r.p for r in df.collect()) == {"early": 5, "late": 6}


# --- ranks, top-k, pages ---


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_global_rank(spark, buckets):
    rng = random.Random(buckets)
    values = [None if i % 50 == 0 else round(rng.choice([5.0, rng.uniform(-3, 9)]), 1) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    found = {r.id: r.rank for r in ranking.rank_global(df, "v", "rank", buckets).collect()}
    nulls = values.count(None)
    for i, v in enumerate(values):
        assert found[i] == (1 if v is None else 1 + nulls + sum(1 for w in values if w is not None and w > v))


@pytest.mark.parametrize("direction, nulls", [("desc", None), ("asc", None), ("desc", "last"), ("asc", "first")])
def test_pages(spark, direction, nulls):
    df = spark.range(237).withColumn("g", F.when(F.col("id") % 5 > 0, F.col("id") % 3)).repartition(8)
    keys = [("g", direction, nulls), ("id",)]
    whole = [(r.g, r.id) for r in ranking.order(df, keys).collect()]
    for number in (0, 1, 4, 9, 99):
        start = min(number, 9) * 25
        got = [(r.g, r.id) for r in ranking.page(df, keys, number, 25).collect()]
        assert got == whole[start : start + 25], number


def test_page_of_nothing_is_empty(spark):
    assert ranking.page(spark.range(0), [("id",)], 3).collect() == []


def test_table_view(spark):
    df = spark.createDataFrame(
        [("a1", 2.0, "x"), ("a2", None, "x"), ("a3", 9.0, "x"), ("b1", 1.0, "x"), ("a4", 5.0, "y")],
        "id string, score double, verdict string",
    )
    view = ranking.table_view(df, "id", "A", ["id"], {"verdict": "x"}, ("score", "desc"), 0, 2)
    assert [(r.id, r.rows_found) for r in view.collect()] == [("a3", 3), ("a1", 3)]
    up = ranking.table_view(df, "id", sort=("score", "asc"), size=None)
    assert [r.id for r in up.collect()] == ["a2", "b1", "a1", "a4", "a3"]


def test_null_order_and_custom_order(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in ranking.order(df, [("x", "asc")]).collect()] == [1, 2, None]
    assert [r.x for r in ranking.order(df, [("x", "desc")]).collect()] == [None, 2, 1]
    assert [r.x for r in ranking.order(df, [("x", "desc", "last")]).collect()] == [2, 1, None]
    names = spark.createDataFrame([("c",), ("a",), ("z",)], "m string")
    ordered = names.orderBy(ranking.custom_order(F.col("m"), ["c", "a"]).asc_nulls_last())
    assert [r.m for r in ordered.collect()] == ["c", "a", "z"]
    assert [r.x for r in ranking.top_k(df, [("x", "desc", "last")], 2).collect()] == [2, 1]


# --- medians ---


@pytest.mark.parametrize("seed", range(3))
def test_exact_median(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key, n in (("one", 1), ("two", 2), ("odd", 101), ("even", 240), ("negative", 51)):
        for _ in range(n):
            v = rng.choice([rng.randrange(0, 200), rng.randrange(0, 10**9)])
            rows.append((key, -v if key == "negative" and rng.random() < 0.7 else v))
    df = spark.createDataFrame([*rows, ("one", None)], "key string, cents bigint")
    df = df.withColumn("amount", (F.col("cents") / 100).cast("decimal(12,2)"))
    groups = defaultdict(list)
    for key, v in rows:
        groups[key].append(v / 100)
    found = {r.key: r.m for r in medians.exact_median(df, ["key"], "amount", "m").collect()}
    assert found == pytest.approx({k: statistics.median(v) for k, v in groups.items()}, abs=1e-9)


# --- time line ---


@pytest.mark.parametrize("seed", range(3))
def test_totals_after(spark, seed):
    events = random_events(seed, 400)
    rng = random.Random(seed + 100)
    marks = [(e[0], e[1] + dt.timedelta(minutes=rng.choice([0, 0, 1, -1, 7200])), f"m{i}") for i, e in enumerate(events[:150])]
    marks += [("nobody", T0, "alone"), ("hot", T0 - dt.timedelta(9), "before"), ("hot", T0 + dt.timedelta(99), "past")]
    found = timeline.totals_after(
        spark.createDataFrame(events, EVENTS),
        spark.createDataFrame(marks, "key string, ts timestamp_ntz, mark string"),
        "key", "ts", {"x": "later_x"},
    )
    expected = {m: sum(e[3] for e in events if e[0] == key and e[1] > ts) for key, ts, m in marks}
    rows = found.collect()
    assert len(rows) == len(marks) and {r.mark: r.later_x for r in rows} == expected


# --- rings ---


def test_ring_members_seed_and_pairs(spark):
    edges = frames.edges(
        spark,
        [("A", "B", "R1"), ("B", "A", "R1"), ("A", "C", "R1"), ("D", "E", "R2", False), ("A", "F", None), ("A", "G", "R3")],
    )
    assert {(r.ring_id, r.account_id) for r in rings.ring_members(edges).collect()} == {
        ("R1", "A"), ("R1", "B"), ("R1", "C"), (None, "A"), (None, "F"), ("R3", "A"), ("R3", "G"),
    }
    tx = frames.transactions(
        spark,
        [{"account_id": a, "is_fraud": True, "ts": frames.after(d)} for a, d in (("A", 2), ("A", 5), ("B", 2), ("C", 1), ("F", 0))],
    )
    members = rings.ring_first_events(tx, edges)
    seeds = rings.ring_seeds(members)
    assert {(r.ring_id, r.seed_account) for r in seeds.collect()} == {("R1", "C"), ("R3", "A")}
    pairs = rings.ring_pairs(members).collect()
    assert {(r.ring_id, r.account_id, r.seed_account) for r in pairs} == {("R1", "A", "C"), ("R1", "B", "C")}


# --- reshaping, audit ---


def test_unpivot_pivot_and_unions(spark):
    df = spark.createDataFrame([("p", 2022, 1, None), ("p", 2024, 3, 4.5)], "p string, year int, a int, b double")
    rows = reshape.unpivot_metrics(df, ["p", "year"], ["a", "b"])
    assert {(r.year, r.metric, r.value) for r in rows.collect()} == {
        (2022, "a", 1.0), (2022, "b", None), (2024, "a", 3.0), (2024, "b", 4.5),
    }
    wide = rows.groupBy("metric").agg(*reshape.pivot_years(F.col("value"), F.col("year"), (2022, 2023, 2024)))
    assert {tuple(r) for r in wide.collect()} == {("a", 1.0, None, 3.0), ("b", None, None, 4.5)}
    half = df.select("p", "a")
    assert {r.b for r in reshape.union_all_nulls(df.select("p", "a", "b"), half).collect()} == {None, 4.5}
    assert reshape.union_distinct(half, half).count() == 2


def test_audit_finds_each_kind_of_violation(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    child = spark.createDataFrame(
        [(1, "a", 5), (1, "x", 24), (2, "x", None), (None, None, -1), (3, "b", 0)], "k int, parent string, hour int"
    )
    found = quality.audit(
        [
            quality.PrimaryKey("key", child, "k"),
            quality.ForeignKey("parent", child, "parent", parent, "id"),
            quality.Check("hour.range", child, "hour BETWEEN 0 AND 23"),
            quality.not_null("hour present", child, "hour"),
        ]
    )
    assert {r.rule: r.violations for r in found.collect()} == {
        "key": 2, "parent": 2, "hour.range": 2, "hour present": 1,
    }


def test_audit_reads_each_table_once_and_reports_empty_tables(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), (None,)], "id string").write.parquet(f"{tmp_path}/t")
    table, none = spark.read.parquet(f"{tmp_path}/t"), spark.createDataFrame([], "id string")
    rules = [
        quality.PrimaryKey("t.id", table, "id"),
        quality.not_null("t.id present", table, "id"),
        quality.ForeignKey("t.id in none", table, "id", none, "id"),
        quality.ForeignKey("none.id in t", none, "id", table, "id"),
        quality.PrimaryKey("none.id", none, "id"),
    ]
    found = quality.audit(rules)
    assert {r.rule: r.violations for r in found.collect()} == {
        "t.id": 2, "t.id present": 1, "t.id in none": 2, "none.id in t": 0, "none.id": 0,
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


# --- ranges and refinement without a look at every cut or value ---


@pytest.mark.parametrize("many", [0, 1, 2, 3, 7, 8, 20])
def test_ranges_are_found_by_halving(spark, many):
    cuts = [3 * i for i in range(many)]
    df = spark.range(-2, 70).withColumn("cuts", F.lit(cuts) if cuts else F.expr("array()").cast("array<int>"))
    for most in {many, many + 5}:
        found = df.select("id", ranking._range_of(F.col("cuts"), most, lambda cut: cut < F.col("id")).alias("at")).collect()
        assert all(r.at == sum(c < r.id for c in cuts) for r in found)


def test_no_row_is_held_against_every_cut(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS v")
    for made in (ranking.rank_global(df, "v", "rank"), ranking.page(df, [("v", "desc"), ("id",)], 5)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "size(filter(" not in plan and "aggregate(" in plan


def test_a_narrow_middle_cell_is_divided(spark):
    values = spark.range(200_001).selectExpr("struct('a' AS k) AS _group", "struct(1L AS c) AS _cell", "CAST(10000 + id / 100 AS DECIMAL(12,2)) AS v", "1L AS _n")
    ends = values.agg(F.min("v"), F.max("v")).first()
    placed = values.selectExpr("*", "0L AS _before", "100000L AS _lo", "100000L AS _hi", f"{ends[0]}BD AS _least", f"{ends[1]}BD AS _most")
    once = medians._refined(placed, "v")
    assert 0 < once.count() <= 200_001 // medians.PARTS + 2
    assert 0 < medians._refined(once, "v").count() <= 2
    df = values.selectExpr("_group.k", "v").union(spark.createDataFrame([("b", None), (None, 1), (None, 2)], "k string, v long").selectExpr("k", "CAST(v AS DECIMAL(12,2))"))
    assert {r.k: r.m for r in medians.exact_median(df, ["k"], "v", "m").collect()} == {"a": 11000.0, None: 1.5}


def test_a_table_view_computes_its_rows_once(spark):
    """Every row bumps a counter when it is made; the count, the cuts and the page read the stored rows."""
    made = spark.sparkContext.accumulator(0)

    def marked(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(marked, "id long").select(F.concat(F.lit("a"), "id").alias("id"), F.col("id").alias("score"))
    view = ranking.table_view(df, "id", "a", ["id"], {}, ("score", "desc"), 1, 10)
    assert [(r.score, r.rows_found) for r in view.collect()] == [(i, 100) for i in range(89, 79, -1)]
    assert made.value == 100
