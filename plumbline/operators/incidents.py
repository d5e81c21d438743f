"""Pipeline incidents as an event log, folded to their current state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import ROWS_PER_TASK, block_count, previous_value

# Statuses an incident can move between.
TRANSITIONS: Mapping[str, tuple[str, ...]] = {
    "observing": ("tracing",),
    "tracing": ("diagnosing",),
    "diagnosing": ("fixing",),
    "fixing": ("sandbox",),
    "sandbox": ("pending_approval", "fixing", "escalated"),
    "pending_approval": ("resolved", "escalated"),
}
OPEN = "open"
PENDING = "pending_approval"
RESOLVED = "resolved"
ESCALATED = "escalated"
TESTS_REPORTED = 5

# Fields the first event of an incident settles; of all others the last event counts.
FIRST_FIELDS = ("table_name", "created_at")
LAST_FIELDS = ("anomaly_type", "root_cause", "root_cause_table", "status", "proposed_fix", "sandbox_result")


def current_state(events: DataFrame, *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per incident: first values of `FIRST_FIELDS`, last values of the rest.

    `resolved_at` is the time of the event that resolved it. Texts are folded by sorting, so events are dealt to tasks of
    bounded size first, in order of (incident, seq): what a task sorts does not grow with the log, an incident
    of very many events is spread over several, and most others meet whole ahead of the second shuffle.
    """
    dealt = events.repartitionByRange(block_count(events, rows_per_task), "incident_id", "seq")
    folded = dealt.groupBy("incident_id").agg(
        F.min_by(F.struct(*FIRST_FIELDS), "seq").alias("_first"),
        F.max_by(F.struct(*LAST_FIELDS), "seq").alias("_last"),
        F.max(F.when(F.col("status") == RESOLVED, F.col("created_at"))).alias("_resolved"),
        F.count(F.lit(1)).alias("events"),
    )
    resolved = F.when(F.col("_last.status") == RESOLVED, F.col("_resolved"))
    return folded.select(
        "incident_id",
        *[F.col(f"_first.{f}").alias(f) for f in FIRST_FIELDS],
        *[F.col(f"_last.{f}").alias(f) for f in LAST_FIELDS],
        resolved.alias("resolved_at"),
        "events",
    )


def is_legal(before: Column, after: Column) -> Column:
    """Whether a status may follow another; the first status of an incident may be any."""
    legal = before.isNull() | (before == after) | (before == OPEN)
    for status, following in TRANSITIONS.items():
        legal = legal | ((before == status) & after.isin(*following))
    return legal


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events whose status may not follow the one before."""
    steps = previous_value(
        events.select("incident_id", "seq", "status"), "status", "previous_status",
        keys=["incident_id"], order=["seq"],
    )
    return steps.where(~is_legal(F.col("previous_status"), F.col("status")))


def with_status(state: DataFrame, status: str | None = None, incident_id: str | None = None) -> DataFrame:
    if status is not None:
        state = state.where(F.col("status") == status)
    if incident_id is not None:
        state = state.where(F.col("incident_id") == incident_id)
    return state


def pending(state: DataFrame) -> DataFrame:
    """Incidents waiting for approval, newest first."""
    return with_status(state, PENDING).orderBy(F.col("created_at").desc(), "incident_id")


def decide(state: DataFrame, incident_id: str, *, approve: bool, seq: Column, at: Column) -> DataFrame:
    """The event that approves or rejects an incident."""
    return with_status(state, incident_id=incident_id).select(
        "incident_id", seq.cast("long").alias("seq"), "table_name", "anomaly_type", "root_cause",
        "root_cause_table", F.lit(RESOLVED if approve else ESCALATED).alias("status"),
        "proposed_fix", "sandbox_result", at.cast("timestamp").alias("created_at"),
    )


def observe(
    profile: DataFrame, table: str, tests: DataFrame | None = None, *, incident_id: str | None = None
) -> DataFrame:
    """One row: an incident with the profile of its table and its failing tests, ready to trace.

    Both parts are as small as the table is wide and the run had failures.
    """
    columns = profile.agg(
        F.max("row_count").alias("row_count"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("column_name", F.struct("null_count", "null_rate"))
        )))).alias("column_stats"),
    )
    failing = F.lit("[]")
    if tests is not None:
        listed = F.array_sort(F.collect_list(F.struct(*tests.columns)))
        failing = tests.agg(F.to_json(listed).alias("t")).select("t").scalar()
    return columns.select(
        (F.lit(incident_id) if incident_id else F.uuid()).alias("incident_id"),
        F.lit(table).alias("table_name"),
        failing.alias("failing_tests"),
        "row_count",
        "column_stats",
        F.lit("tracing").alias("status"),
    )


def report(
    observed: DataFrame,
    root_cause: DataFrame,
    edges: DataFrame,
    tests: DataFrame,
    anomaly: DataFrame | None = None,
    *,
    order: str = "unique_id",
) -> DataFrame:
    """The incident with its root cause, up to 5 tests, lineage edges and classification, as JSON."""
    shown = tests.orderBy(order).limit(TESTS_REPORTED)
    listed_tests = shown.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in tests.columns if c != order]))))
    listed_edges = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst"))))
    parts = {
        "failing_table": F.col("table_name"),
        "root_cause_table": root_cause.select("root_cause_table").scalar(),
        "root_cause_column": root_cause.select("root_cause_column").scalar(),
        "tests": listed_tests.scalar(),
        "row_count": F.col("row_count"),
        "column_stats": F.col("column_stats"),
        "edges": listed_edges.scalar(),
    }
    if anomaly is not None:
        parts["anomaly_type"] = anomaly.select("anomaly_type").scalar()
    return observed.select(
        "incident_id",
        F.to_json(F.struct(*[value.alias(name) for name, value in parts.items()])).alias("report"),
    )
