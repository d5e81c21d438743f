"""Per-record rules on order lines."""

from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import rowchecks
from plumbline.rules import RuleSet
from plumbline.streaming.source import decode

LINES = RuleSet.from_dict({"topic": "lines", "rules": [
    {"name": "quantity_sold", "type": "range", "column": "l_quantity", "min": 1.0, "max": 50.0, "severity": "critical"},
    {"name": "discount_share", "type": "range", "column": "l_discount", "min": 0.0, "max": 0.1},
    {"name": "flag_given", "type": "not_null", "column": "l_returnflag", "severity": "critical"},
    {"name": "ship_mode_word", "type": "regex", "column": "l_shipmode", "pattern": "^[A-Z ]+$"},
]})
SCHEMA = "id string, l_returnflag string, l_quantity double, l_discount double, l_shipmode string"
FINE = ("17", "N", 24.0, 0.05, "REG AIR")


def broken(spark, *records, schema=SCHEMA, rules=LINES, **options):
    return rowchecks.violations(spark.createDataFrame(list(records), schema), rules, **options)


def names(found):
    return [r["rule_name"] for r in rows(found)]


def test_a_violation_says_what_broke(spark):
    assert names(broken(spark, FINE)) == []
    (v,) = rows(broken(spark, ("18", "R", 51.0, 0.0, "AIR")))
    assert {k: v[k] for k in ("type", "topic", "rule_name", "severity", "record_id", "value", "expected", "z_score")} == {
        "type": "violation", "topic": "lines", "rule_name": "quantity_sold", "severity": "critical", "record_id": "18",
        "value": "51.0", "expected": "[1.0, 50.0]", "z_score": None}


def test_ranges_hold_their_ends_and_pass_nulls_and_nan(spark):
    edges = [("1", "A", 1.0, 0.1, None), ("2", "A", 50.0, 0.0, None), ("3", "A", None, None, None), ("4", "A", float("nan"), 0.0, None)]
    assert names(broken(spark, *edges)) == []


def test_absence_takes_three_forms(spark):
    """Null, empty, and no such column."""
    assert names(broken(spark, ("1", None, 2.0, 0.0, None), ("2", "", 2.0, 0.0, None))) == ["flag_given", "flag_given"]
    assert names(broken(spark, ("3",), schema="id string")) == ["flag_given"]


def test_rules_keep_their_order_within_a_record(spark):
    df = spark.createDataFrame([("1", None, 0.0, 0.7, "truck!"), FINE], SCHEMA)
    listed = {r["id"]: [v["rule_name"] for v in r["violations"]] for r in rows(rowchecks.with_violations(df, LINES))}
    assert listed["1"] == [r.name for r in LINES.rules] and not listed.get("17")


def test_texts_that_are_numbers(spark):
    floor = RuleSet.from_dict({"topic": "t", "rules": [{"name": "r", "type": "range", "column": "x", "min": 5}]})
    fine, low, words = ["7", "\t8 ", "5e0", "inf", "nan"], ["4.9", "-6"], ["", "six", "6_0", "7.0f"]
    found = {v["value"]: v["expected"] for v in rows(broken(spark, *[(x, x) for x in fine + low + words], schema="id string, x string", rules=floor))}
    assert found == {**dict.fromkeys(low, "[5.0, None]"), **dict.fromkeys(words, "numeric value")}


def test_record_ids_and_times(spark):
    found = broken(spark, (0, "o-9"), (3, "o-8"), (None, None), schema="id long, record_id string")
    assert [v["record_id"] for v in rows(found)] == ["o-9", "3", ""]
    shipped = datetime(1996, 3, 13, 8, 30)
    (v,) = rows(broken(spark, ("1", shipped), schema="id string, shipped timestamp", time_column="shipped"))
    assert v["timestamp"] == shipped


def test_records_are_split_and_sent_whole(spark):
    df = spark.createDataFrame([FINE, ("20", "", 60.0, 0.0, "rail")], SCHEMA)
    clean, flagged = rowchecks.quarantine(df, LINES)
    assert [r["id"] for r in rows(clean)] == ["17"] and [r["id"] for r in rows(flagged)] == ["20"]
    (sent,) = rows(rowchecks.violation_messages(df, LINES))
    assert sent["key"] == "20" and sent["value"].count("rule_name") == 3


def test_lines_that_are_no_records_are_kept_apart(spark):
    lines = ['{"id": "a", "x": 2}', '{"id": "b", "x": "two"}', "null?", '{"id": ', '"text"']
    good, bad = decode(spark.createDataFrame([(x,) for x in lines], "raw string"),
                       T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.DoubleType())]))
    assert sorted((r["id"], r["x"]) for r in rows(good)) == [("a", "2"), ("b", "two")]
    assert bad.count() == 3


def test_rules_share_one_scan_of_their_columns(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([FINE], SCHEMA).withColumn("l_comment", F.lit("unread")).write.parquet(path)
    plan = rowchecks.violations(spark.read.parquet(path), LINES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "l_comment" not in plan and "Exchange" not in plan
