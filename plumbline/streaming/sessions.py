"""Incidents, timelines and volumes of violation streams, in event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import rank_of_severity, severity_of_rank
from plumbline.operators.sessions import GAP_SECONDS, incident_key, incidents


def stream_incidents(
    found: DataFrame,
    rule_names: Sequence[str],
    *,
    gap_seconds: float = GAP_SECONDS,
    lateness: str = "0 seconds",
) -> DataFrame:
    """Closed incidents of a violation stream, without samples.

    A session closes once the watermark has passed its last violation by the
    gap. `session_window` joins events exactly the gap apart, so its gap is one
    microsecond shorter. Per rule one first-seen time is kept, so the state of
    an open incident is as small as the rule set.
    """
    gap = f"{int(gap_seconds * 1_000_000) - 1} microseconds"
    at = F.col("timestamp")
    first_seen = [
        F.min(F.when(F.col("rule_name") == name, F.struct(at, F.col("record_id")))).alias(f"_r{i}")
        for i, name in enumerate(rule_names)
    ]
    keyed = found.withWatermark("timestamp", lateness).withColumn(
        "topic", F.coalesce("topic", F.lit(""))
    ).withColumn("column", F.coalesce("column", F.lit("")))
    folded = keyed.groupBy(F.session_window("timestamp", gap), "topic", "column").agg(
        F.count(F.lit(1)).alias("violation_count"),
        F.max(at).alias("last_seen"),
        F.max(rank_of_severity(F.col("severity"))).alias("_rank"),
        *first_seen,
    )
    seen = F.array(*[
        F.when(F.col(f"_r{i}").isNotNull(), F.struct(F.col(f"_r{i}").alias("seen"), F.lit(name).alias("rule_name")))
        for i, name in enumerate(rule_names)
    ])
    in_order = F.transform(F.array_sort(F.array_compact(seen)), lambda s: s["rule_name"])
    start = F.col("session_window.start")
    return folded.select(
        incident_key(F.col("topic"), F.col("column"), F.unix_micros(start)).alias("incident_id"),
        "topic",
        "column",
        start.alias("first_seen"),
        "last_seen",
        "violation_count",
        severity_of_rank(F.col("_rank")).alias("severity"),
        in_order.alias("rule_names"),
    )


def flush_open(found: DataFrame, closed: DataFrame, *, gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """Incidents that `closed` does not hold yet, from all violations stored so far.

    At the end of input the last session of every key is still open in the stream.
    """
    whole = incidents(found, gap_seconds, samples=0)
    return whole.join(closed.select("incident_id"), "incident_id", "left_anti").drop("sample_violations")


def flush_timeline(found: DataFrame, closed: DataFrame, *, interval: str = "1 minute") -> DataFrame:
    """Intervals the stream has not given out at the end of input: those after the last one it has."""
    last = closed.agg(F.max("minute")).first()[0]
    rows = found if last is None else found.where(F.col("timestamp") > F.lit(last) + F.expr(f"INTERVAL {interval}") - F.expr("INTERVAL 1 MICROSECOND"))
    counted = rows.groupBy(F.window("timestamp", interval), "severity").agg(F.count(F.lit(1)).alias("violations"))
    return counted.select(F.col("window.start").alias("minute"), "severity", "violations")


def stream_timeline(found: DataFrame, *, interval: str = "1 minute", lateness: str = "0 seconds") -> DataFrame:
    """Violations per tumbling interval and severity, once the watermark has passed it."""
    counted = found.withWatermark("timestamp", lateness).groupBy(
        F.window("timestamp", interval), "severity"
    ).agg(F.count(F.lit(1)).alias("violations"))
    return counted.select(F.col("window.start").alias("minute"), "severity", "violations")
