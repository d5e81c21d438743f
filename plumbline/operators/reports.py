"""Read-side figures over stored violations and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import age_seconds, minute_floor, ratio
from plumbline.operators.rowchecks import of_topic

# How many rows each report shows.
RECENT = 200
TOP_RULES = 10
HISTORY = 30
FEED = 50
FEED_COLUMNS = ("timestamp", "topic", "rule_name", "column", "value", "expected", "severity")


def kpis(found: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: violations, critical ones, topics, age of the latest in seconds."""
    latest = found.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_distinct("topic").alias("topics"),
        F.max("timestamp").alias("_latest"),
    )
    age = age_seconds(F.col("_latest"), F.current_timestamp() if now is None else now)
    return latest.select("total", "critical", "topics", age.alias("last_seen_seconds"))


def timeline(found: DataFrame) -> DataFrame:
    """Violations per minute and severity."""
    return found.groupBy(minute_floor(F.col("timestamp")).alias("minute"), "severity").agg(
        F.count(F.lit(1)).alias("violations")
    )


def by_topic(found: DataFrame) -> DataFrame:
    counted = found.groupBy("topic").agg(F.count(F.lit(1)).alias("violations"))
    return counted.orderBy(F.col("violations").desc(), "topic")


def by_rule(found: DataFrame, top: int = TOP_RULES) -> DataFrame:
    """The rules broken most often; names settle ties."""
    counted = found.groupBy("rule_name").agg(F.count(F.lit(1)).alias("violations"))
    return counted.orderBy(F.col("violations").desc(), "rule_name").limit(top)


def recent(found: DataFrame, topic: str | None = None, limit: int = RECENT) -> DataFrame:
    """The latest violations, of one topic or all; record and rule settle ties."""
    return _newest(of_topic(found, topic)).limit(limit)


def feed(found: DataFrame, limit: int = FEED) -> DataFrame:
    return _newest(found).limit(limit).select(*[F.col(f"`{c}`") for c in FEED_COLUMNS])


def _newest(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("timestamp").desc(), "record_id", "rule_name")


def pass_rate_history(
    results: DataFrame, suite: str, column: str, expectation: str, limit: int = HISTORY
) -> DataFrame:
    """The latest pass rates of one expectation."""
    wanted = results.where(
        (F.col("suite_name") == suite) & (F.col("column_name") == column)
        & (F.col("expectation") == expectation)
    )
    shown = wanted.select("run_at", "pass_rate", "total_records", "failed_records")
    return shown.orderBy(F.col("run_at").desc()).limit(limit)


def quality_score(checked: DataFrame, bad: Column, *, by: list[Column]) -> DataFrame:
    """1 - share of bad records, per group; a topic and a time window as a rule."""
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(bad).alias("bad_records"),
        (1.0 - ratio(F.count_if(bad), F.count(F.lit(1)))).alias("score"),
    )
