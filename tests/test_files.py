"""CSV in and out: what a bulk load must refuse and what must survive a round trip."""

import pytest
from pyspark.sql import functions as F

from tamarack.operators.medians import exact_median
from tamarack.sources import files

SCHEMA = "id int, n int, note string, flag boolean"


def typed(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_a_bad_row_fails_the_load_even_in_a_column_not_read(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,n,note,flag\n1,2,a,true\n2,zz,b,false\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        files.load_csv(spark, str(tmp_path / "in.csv"), typed(spark), str(tmp_path / "table")).select("id")


def test_null_and_empty_text_differ(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,n,note,flag\n1,,,\n2,5,"",TRUE\n3,6," a ""b"", c",false\n')
    found = files.load_csv(spark, str(tmp_path / "in.csv"), typed(spark), str(tmp_path / "table"))
    assert sorted(map(tuple, found.collect())) == [(1, None, None, None), (2, 5, "", True), (3, 6, ' a "b", c', False)]


def test_round_trip(spark, tmp_path):
    notes = [None, "", " ", "a,b", 'say "x"', "line\nbreak", "'", "NULL", "é漢", "\\", '""', "#x", " both "]
    rows = [(i, None if i % 3 else i, note, None if i % 2 else True) for i, note in enumerate(notes)]
    df = spark.createDataFrame(rows, SCHEMA)
    files.write_result(df, str(tmp_path / "csv"), "csv")
    found = files.load_csv(spark, str(tmp_path / "csv"), df.schema, str(tmp_path / "table"), multi_line=True)
    assert sorted(map(tuple, found.collect())) == rows


def test_missing_columns_are_null(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,note\n1,x\n")
    found = files.load_csv(spark, str(tmp_path / "in.csv"), typed(spark), str(tmp_path / "table"), ["id", "note"])
    assert [tuple(r) for r in found.collect()] == [(1, None, "x", None)]


def test_the_median_of_the_null_group(spark):
    df = spark.range(9).select(F.when(F.col("id") > 2, F.lit("k")).alias("key"), F.col("id").alias("x"))
    assert {r.key: r.m for r in exact_median(df, ["key"], "x", "m").collect()} == {None: 1.0, "k": 5.5}


def test_spellings_of_booleans(spark, tmp_path):
    spelt = {"t": True, "TRUE": True, "yes": True, "1": True, "On": True, "f": False, "no": False, "0": False, "OFF": False, "": None}
    (tmp_path / "in.csv").write_text("id,flag\n" + "".join(f"{i},{s}\n" for i, s in enumerate(spelt)))
    found = files.load_csv(spark, str(tmp_path / "in.csv"), typed(spark), str(tmp_path / "table"), ["id", "flag"])
    assert [r.flag for r in sorted(found.collect())] == list(spelt.values())
    (tmp_path / "bad.csv").write_text("id,flag\n1,maybe\n")
    with pytest.raises(Exception, match="Malformed"):
        files.load_csv(spark, str(tmp_path / "bad.csv"), typed(spark), str(tmp_path / "other"), ["id", "flag"])


def test_violations_are_counted_while_the_rows_are_written(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,n,note,flag\n1,24,a,1\n,5,,0\n3,,b,\n4,-1,c,t\n")
    found: dict[str, int] = {}
    checks = {"id is present": "id IS NOT NULL", "n is an hour": "n BETWEEN 0 AND 23", "flag is present": "flag IS NOT NULL"}
    table = files.load_csv(spark, str(tmp_path / "in.csv"), typed(spark), str(tmp_path / "table"), violations=found, checks=checks)
    assert found == {"id is present": 1, "n is an hour": 2, "flag is present": 1} and table.count() == 4
