"""Bursts of violations folded into incidents.

Violations of one (topic, column) belong to one incident as long as the quiet
time between neighbours stays below the gap; a pause of exactly the gap splits.

There are few (topic, column) pairs and any of them may hold most violations,
so raw violations never meet in one task: they are first summed per gap-wide
time bucket with map-side combine. Two violations in one bucket are closer than
the gap, so nothing is lost, and what is left grows with time, not with volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import rank_of_severity, severity_of_rank
from plumbline.operators.firsts import first_rows
from plumbline.operators.ordered import (
    BLOCK,
    ROWS_PER_TASK,
    block_count,
    number_rows,
    order_blocks,
)
from plumbline.schemas import VIOLATION
from plumbline.session import stable

# Default quiet time in seconds, samples kept per incident, id format.
GAP_SECONDS = 60.0
SAMPLES = 5
ID_FORMAT = "stream-%06d"

KEY = ["topic", "column"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name)


def _summed(found: DataFrame, gap_us: int) -> DataFrame:
    """Violations per (topic, column, time bucket, rule): count, span, worst severity, first seen."""
    at = F.unix_micros("timestamp")
    return (
        found.select(
            *[_text(k) for k in KEY],
            _text("rule_name"),
            _text("record_id"),
            at.alias("_at"),
            F.floor(at / gap_us).alias("_bucket"),
            rank_of_severity(F.col("severity")).alias("_rank"),
        )
        .groupBy(*KEY, "_bucket", "rule_name")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_at").alias("_first"),
            F.max("_at").alias("_last"),
            F.max("_rank").alias("_rank"),
            F.min(F.struct("_at", "record_id")).alias("_seen"),
        )
    )


def _with_session(summed: DataFrame, gap_us: int, rows_per_task: int) -> DataFrame:
    """Adds `_start`, the time the session of each row began."""

    def begins(earlier_last: Column) -> Column:
        pause = F.col("_first") - earlier_last
        return F.when(earlier_last.isNull() | (pause >= gap_us), F.col("_first"))

    by = ["_first", "rule_name"]
    # Buckets are sorted into blocks, and each block knows the latest end and the
    # latest start of the blocks before it.
    blocked = order_blocks(summed, KEY, by, block_count(summed, rows_per_task))
    window = Window.partitionBy(BLOCK, *KEY).orderBy(*by)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    until = window.rowsBetween(Window.unboundedPreceding, 0)
    earlier_blocks = Window.partitionBy(*KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, name: str, into: str) -> DataFrame:
        edges = rows.groupBy(BLOCK, *KEY).agg(F.max(name).alias("_edge"))
        return edges.select(BLOCK, *KEY, F.max("_edge").over(earlier_blocks).alias(into))

    ended = blocked.join(carried(blocked, "_last", "_ended"), [BLOCK, *KEY])
    flagged = ended.withColumn("_begin", begins(F.coalesce(
        F.greatest(F.max("_last").over(before), F.col("_ended")), F.col("_ended")
    )))
    begun = flagged.join(carried(flagged, "_begin", "_begun"), [BLOCK, *KEY])
    return begun.withColumn(
        "_start", F.coalesce(F.max("_begin").over(until), F.col("_begun"))
    ).select(*summed.columns, "_start")


def incidents(
    found: DataFrame,
    gap_seconds: float = GAP_SECONDS,
    *,
    samples: int = SAMPLES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per burst of violations, with its first `samples` violations.

    Rule names come in the order they were first seen. `incident_id` is derived
    from (topic, column, first_seen), so a re-run names incidents alike; see
    `numbered` for running numbers.
    """
    gap_us = int(gap_seconds * 1_000_000)
    # Cut here, so that neither counting the buckets nor taking samples runs the checks a second time.
    found = stable(found) if samples else found
    summed = stable(_summed(found, gap_us))
    sessions = _with_session(summed, gap_us, rows_per_task)
    session = [*KEY, "_start"]
    per_rule = sessions.groupBy(*session, "rule_name").agg(
        F.sum("_n").alias("_n"),
        F.max("_last").alias("_last"),
        F.max("_rank").alias("_rank"),
        F.min("_seen").alias("_seen"),
    )
    # One list entry per rule, so the list is as short as the rule set.
    rules = F.array_sort(F.collect_list(F.struct("_seen", "rule_name")))
    folded = per_rule.groupBy(*session).agg(
        F.sum("_n").alias("violation_count"),
        F.max("_last").alias("_last"),
        F.max("_rank").alias("_rank"),
        F.transform(rules, lambda r: r["rule_name"]).alias("rule_names"),
    )
    if samples:
        first = _first_violations(found, sessions, gap_us, samples)
        folded = folded.join(first, session, "left")
    else:
        folded = folded.withColumn("sample_violations", F.lit(None))
    return folded.select(
        incident_key(F.col("topic"), F.col("column"), F.col("_start")).alias("incident_id"),
        *KEY,
        F.timestamp_micros("_start").alias("first_seen"),
        F.timestamp_micros("_last").alias("last_seen"),
        "violation_count",
        severity_of_rank(F.col("_rank")).alias("severity"),
        "rule_names",
        "sample_violations",
    )


def incident_key(topic: Column, column: Column, start_us: Column) -> Column:
    return F.concat(
        F.lit("incident-"),
        F.substring(F.sha2(F.concat_ws("\u001f", topic, column, start_us.cast("string")), 256), 1, 16),
    )


def _first_violations(found: DataFrame, sessions: DataFrame, gap_us: int, samples: int) -> DataFrame:
    """The first `samples` violations of each session.

    Every bucket holds one at least, so they lie in the session's first `samples`
    buckets. Each bucket is first cut to its own first `samples`, per task and per
    salted part, so a burst is never shuffled by its bucket.
    """
    bucket, session = [*KEY, "_bucket"], [*KEY, "_start"]
    by = ["timestamp", "_id", "_rule"]
    leading = first_rows(sessions.select(*bucket, "_start").distinct(), session, ["_bucket"], samples)
    keyed = found.select(
        *[_text(k) for k in KEY],
        "timestamp",
        F.coalesce("record_id", F.lit("")).alias("_id"),
        F.coalesce("rule_name", F.lit("")).alias("_rule"),
        F.floor(F.unix_micros("timestamp") / gap_us).alias("_bucket"),
        F.struct(*[F.col(f"`{f.name}`") for f in VIOLATION]).alias("_violation"),
    )
    few = first_rows(keyed, bucket, by, samples)
    top = first_rows(few.join(leading, bucket), session, by, samples, rank="_rank")
    listed = F.array_sort(F.collect_list(F.struct("_rank", "_violation")))
    return top.groupBy(*session).agg(
        F.transform(listed, lambda s: s["_violation"]).alias("sample_violations")
    )


def numbered(folded: DataFrame, *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Incidents with running ids in the order they ended, numbered across all blocks."""
    by = ["last_seen", *KEY]
    blocks = block_count(folded, rows_per_task)
    ranked = number_rows(order_blocks(folded, [], by, blocks), "_number")
    return ranked.withColumn("incident_id", F.format_string(ID_FORMAT, F.col("_number") + 1)).drop("_number")


def cross_topic_incidents(
    folded: DataFrame, gap_seconds: float = GAP_SECONDS, *, least_topics: int = 2
) -> DataFrame:
    """Incidents of several topics that overlap or follow within the gap, as one.

    Incidents are intervals; a new group starts where none of the earlier ones
    reaches to within the gap. The input is already one row per burst, but it
    has no key to spread on, so it is first merged per gap-wide bucket.
    """
    gap_us = int(gap_seconds * 1_000_000)
    start, end = F.unix_micros("first_seen"), F.unix_micros("last_seen")
    buckets = (
        folded.select(start.alias("_first"), end.alias("_last"))
        .groupBy(F.floor(F.col("_first") / gap_us).alias("_bucket"))
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    )
    flat = buckets.select(
        F.lit("").alias("topic"), F.lit("").alias("column"), F.lit("").alias("rule_name"),
        "_bucket", "_first", "_last",
    )
    placed = _with_session(stable(flat), gap_us, ROWS_PER_TASK).select("_bucket", "_start")
    members = folded.withColumn("_bucket", F.floor(start / gap_us)).join(placed, "_bucket")
    return (
        members.groupBy("_start")
        .agg(
            F.max("last_seen").alias("last_seen"),
            F.count(F.lit(1)).alias("incident_count"),
            F.sum("violation_count").alias("violation_count"),
            F.array_sort(F.collect_set("topic")).alias("topics"),
            F.max(rank_of_severity(F.col("severity"))).alias("_rank"),
        )
        .where(F.size("topics") >= least_topics)
        .select(
            F.timestamp_micros("_start").alias("first_seen"),
            "last_seen",
            "incident_count",
            "violation_count",
            "topics",
            severity_of_rank(F.col("_rank")).alias("severity"),
        )
    )
