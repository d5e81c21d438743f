"""Frames the queries start from, and the same frames as SQL.

The test tables hold no bad values, so bad ones are put in by a rule on the key,
alike on both sides. Nothing is left out: every frame has all rows of its table.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.check import CheckPlan, compile_rules
from plumbline.rules import RuleSet
from plumbline.session import prepare, ship_package
from plumbline.sources.tables import scan_parquet

TOPIC = "events"

RULES = {
    "topic": TOPIC,
    "rules": [
        {"name": "device_present", "type": "not_null", "column": "device_id", "severity": "critical"},
        {"name": "speed_in_range", "type": "range", "column": "speed", "min": 0.0, "max": 200.0},
        {"name": "known_type", "type": "regex", "column": "event_type",
         "pattern": "^(click|view|purchase)$", "severity": "info"},
    ],
}

NULL_RATE = {"name": "reading_gaps", "type": "null_rate", "column": "reading", "threshold": 0.2,
             "window_size": 50, "severity": "critical"}
STATISTICAL = {"name": "value_jump", "type": "statistical", "column": "value",
               "z_score_threshold": 3.0, "min_samples": 100}


def rule_set(*extra: dict) -> RuleSet:
    return RuleSet.from_dict({"topic": TOPIC, "rules": [*RULES["rules"], *extra]})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(prepare(spark), Path(__file__).resolve().parent)
    return scan_parquet(spark, folder, name)


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as device records with missing, empty and unusable values."""
    events = table(spark, folder, "events")
    key = F.col("event_id")
    device = F.concat(F.lit("device-"), F.col("user_id").cast("string"))
    return events.select(
        "event_id",
        key.cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, F.lit("")).otherwise(device).alias("device_id"),
        F.when(key % 19 == 0, F.lit("n/a")).when(key % 23 == 0, F.lit(None))
        .otherwise(F.col("value").cast("string")).alias("speed"),
        F.when((key % 11 == 0) | (key % 500 < 40), F.lit(None)).otherwise(F.col("value")).alias("reading"),
    )


FEED = """feed AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, ts, user_id, event_type, value, props,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ''
         ELSE 'device-' || CAST(user_id AS VARCHAR) END AS device_id,
    CASE WHEN event_id % 19 = 0 THEN 'n/a' WHEN event_id % 23 = 0 THEN NULL
         ELSE CAST(value AS VARCHAR) END AS speed,
    CASE WHEN event_id % 11 = 0 OR event_id % 500 < 40 THEN NULL ELSE value END AS reading
  FROM events)"""


def _violation_sql(rule: str, column: str, value: str, expected: str, severity: str, where: str) -> str:
    return f"""SELECT 'violation' AS type, '{TOPIC}' AS topic, '{rule}' AS rule_name,
    '{column}' AS "column", {value} AS value, {expected} AS expected, '{severity}' AS severity,
    CAST(NULL AS DOUBLE) AS z_score, epoch_us(ts) AS at_us, id AS record_id
  FROM feed WHERE {where}"""


NOT_NULL_FOUND = _violation_sql(
    "device_present", "device_id", "device_id", "'non-null value'", "critical",
    "device_id IS NULL OR device_id = ''")
RANGE_FOUND = _violation_sql(
    "speed_in_range", "speed", "speed",
    "CASE WHEN TRY_CAST(speed AS DOUBLE) IS NULL THEN 'numeric value' ELSE '[0.0, 200.0]' END", "warning",
    "speed IS NOT NULL AND (TRY_CAST(speed AS DOUBLE) IS NULL OR TRY_CAST(speed AS DOUBLE) < 0"
    " OR TRY_CAST(speed AS DOUBLE) > 200)")
REGEX_FOUND = _violation_sql(
    "known_type", "event_type", "event_type", "'matches /^(click|view|purchase)$/'", "info",
    "NOT regexp_matches(event_type, '^(click|view|purchase)$')")
FOUND = f"""{FEED}, found AS (
  {NOT_NULL_FOUND}
  UNION ALL {RANGE_FOUND}
  UNION ALL {REGEX_FOUND})"""

COLUMNS = 'type, topic, rule_name, "column", value, expected, severity, z_score, at_us, record_id'


def settled(column: str, digits: int) -> Column:
    """Rounded for comparing; nudged first, as means of short decimals fall on exact ties."""
    return F.round(F.col(column) + 3 * 10.0 ** -(digits + 2), digits).alias(column)


def plan(*extra: dict, **options) -> CheckPlan:
    options = {"order": ["event_id"], "time_column": "ts", **options}
    return compile_rules(rule_set(*extra), **options)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """All per-record violations of the feed."""
    return plan().row_violations(feed(spark, folder))


def flat(violations: DataFrame) -> DataFrame:
    """Violations with their time as microseconds, the form both engines compare."""
    return violations.select(
        "type", "topic", "rule_name", "column", "value", "expected", "severity", "z_score",
        F.unix_micros("timestamp").alias("at_us"), "record_id",
    )
