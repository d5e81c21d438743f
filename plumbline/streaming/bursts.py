"""Incidents of a violation stream with a side table of late rows, and an end of input.

`session_window` drops rows behind the watermark without a trace and never closes
the last session of a key. Here one operator per (topic, column) keeps its open
sessions in the state store, routes rows behind the watermark to the side before
they touch a session, and closes a session by an event-time timer. What ends an
input is a marker: a row that moves the watermark past everything open and belongs
to no session. Nothing is computed again from stored violations, and a late row
never opens a second incident of the same burst.

Rows reach the operator with an empty clock, as Spark itself drops rows whose
clock is behind the watermark; a second copy of each row carries the clock and
is dropped as soon as the watermark has seen it. A key's rows go through one
task, Arrow batch by Arrow batch, and fold into a few sessions; the number of open
sessions of a key is small, as quiet ones close.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.values import rank_of_severity, severity_of_rank
from plumbline.operators.sessions import GAP_SECONDS, incident_key

INCIDENT, LATE = "incident", "late"
#: Name under which the progress of a query counts late rows.
LATE_ROWS = "late_rows"
MARKER = "at timestamp"
_OPEN = "first_us long, last_us long, violations long, rank int, rules string"
_OUT = "part string, topic string, field string, first_us long, last_us long, violations long, rank int, rules string"


class Bursts(StatefulProcessor):
    """Open sessions of one (topic, column): merged with new rows, closed by the watermark."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        before, sessions = set(kept), kept
        for batch in rows:
            late = batch["at_us"].to_numpy() < behind
            if late.any():
                yield self._late(key, batch[late])
            if not late.all():
                sessions = self._merged(sessions + self._folded(batch[~late]))
        if set(sessions) != before:
            self.open.put(sessions)
            self._wake(sessions)

    def _wake(self, sessions: list[tuple]) -> None:
        """One timer, at the first close; what it wakes sets the next."""
        self.handle.registerTimer(-(-(min(s[1] for s in sessions) + self.gap) // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        sessions = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        closed = [s for s in sessions if s[1] + self.gap <= passed]
        if closed:
            left = [s for s in sessions if s[1] + self.gap > passed]
            if left:
                self.open.put(left)
                self._wake(left)
            else:
                self.open.clear()
            yield self._shaped(key, INCIDENT, closed)

    def _folded(self, batch: pd.DataFrame) -> list[tuple]:
        """Sessions among the rows of one batch, with the first time and record of each rule."""
        rows = batch.sort_values(["at_us", "record"], kind="stable")
        at = rows["at_us"].to_numpy()
        part = np.cumsum(np.diff(at, prepend=at[0]) >= self.gap)
        rows = rows.assign(session=part)
        firsts = rows.drop_duplicates(["session", "rule"])
        cuts = np.searchsorted(firsts["session"].to_numpy(), np.arange(part[-1] + 2))
        places = list(zip(firsts["rule"], zip(firsts["at_us"].tolist(), firsts["record"], strict=True), strict=True))
        lows = np.searchsorted(part, np.arange(part[-1] + 2))
        highest = np.maximum.reduceat(rows["rank"].to_numpy(), lows[:-1])
        return [
            (int(at[low]), int(at[high - 1]), int(high - low), int(rank), json.dumps(dict(places[a:b]), sort_keys=True))
            for low, high, rank, a, b in zip(lows[:-1], lows[1:], highest, cuts[:-1], cuts[1:], strict=True)
        ]

    def _merged(self, sessions: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for first, last, n, rank, rules in sorted(sessions):
            if out and first - out[-1][1] < self.gap:
                a, b, m, r, known = out[-1]
                seen = json.loads(known)
                for rule, place in json.loads(rules).items():
                    seen[rule] = min(seen.get(rule, place), place)
                out[-1] = (a, max(b, last), m + n, max(r, rank), json.dumps(seen, sort_keys=True))
            else:
                out.append((first, last, n, rank, rules))
        return out

    def _late(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        names = [json.dumps([rule, record]) for rule, record in zip(rows["rule"], rows["record"], strict=True)]
        return self._shaped(key, LATE, [(int(t), int(t), 1, int(r), n) for t, r, n in zip(rows["at_us"], rows["rank"], names, strict=True)])

    def _shaped(self, key: Any, part: str, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["first_us", "last_us", "violations", "rank", "rules"])
        out = out.assign(part=part, topic=key[0], field=key[1]).astype({"rank": np.int32})
        names = [c.split()[0] for c in _OUT.split(", ")]
        return out[names].astype({n: object for n in ("part", "topic", "field", "rules")})

    def close(self) -> None:
        pass


def markers(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of end-of-input markers of a folder; made if it is not there."""
    spark.createDataFrame([], MARKER).write.mode("append").parquet(folder)
    return spark.readStream.schema(MARKER).parquet(folder)


def end_input(spark: SparkSession, folder: str, at: str) -> None:
    """Say that nothing older than `at` follows; the next run of the query closes what is open before it."""
    spark.createDataFrame([(at,)], "at string").select(F.col("at").cast("timestamp")).write.mode("append").parquet(folder)


def stream_bursts(
    found: DataFrame, *, ends: DataFrame | None = None, gap_seconds: float = GAP_SECONDS, lateness: str = "0 seconds"
) -> DataFrame:
    """Closed incidents and late rows of a violation stream, told apart by `part`; see `closed` and `late_rows`.

    Late rows are counted in the query's progress under `LATE_ROWS`. Sessions join
    rows less than the gap apart. Start the query under `state_settings`.
    """
    rows = found.select(
        F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("column", F.lit("")).alias("field"),
        F.col("timestamp").alias("at"), rank_of_severity(F.col("severity")).alias("rank"),
        F.coalesce("rule_name", F.lit("")).alias("rule"), F.coalesce("record_id", F.lit("")).alias("record"),
    )
    copies = F.explode(F.when(F.col("field").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))))
    if ends is not None:
        rows = rows.unionByName(ends.select("at"), allowMissingColumns=True)
    ticked = rows.withColumn("tick", copies).withColumn("clock", F.when(F.col("tick"), F.col("at")))
    data = ticked.withWatermark("clock", lateness).where(F.col("clock").isNull())
    data = data.select("topic", "field", F.unix_micros("at").alias("at_us"), "rank", "rule", "record", "clock")
    out = data.groupBy("topic", "field").transformWithStateInPandas(
        Bursts(int(gap_seconds * 1_000_000)), T._parse_datatype_string(_OUT), "Append", "EventTime")
    return out.observe(LATE_ROWS, F.count_if(F.col("part") == LATE).alias("rows"))


def closed(out: DataFrame) -> DataFrame:
    """The incidents among the rows of `stream_bursts`."""
    places = F.from_json("rules", "map<string,array<string>>")
    in_order = F.array_sort(F.transform(F.map_entries(places), lambda e: F.struct(
        e["value"][0].cast("long").alias("at"), e["value"][1].alias("record"), e["key"].alias("rule"))))
    return out.where(F.col("part") == INCIDENT).select(
        incident_key(F.col("topic"), F.col("field"), F.col("first_us")).alias("incident_id"),
        "topic", F.col("field").alias("column"), F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"), F.col("violations").alias("violation_count"),
        severity_of_rank(F.col("rank")).alias("severity"), F.transform(in_order, lambda e: e["rule"]).alias("rule_names"),
    )


def late_rows(out: DataFrame) -> DataFrame:
    """The rows behind the watermark: topic, column, rule and record, severity, time."""
    told = F.from_json("rules", "array<string>")
    return out.where(F.col("part") == LATE).select(
        "topic", F.col("field").alias("column"), told[0].alias("rule_name"), told[1].alias("record_id"),
        severity_of_rank(F.col("rank")).alias("severity"), F.timestamp_micros("first_us").alias("timestamp"),
    )


def late_counts(progress: Sequence[Any]) -> dict[int, int]:
    """Late rows by micro-batch, from the progress of a query."""
    return {p.batchId: p.observedMetrics[LATE_ROWS].rows for p in progress if LATE_ROWS in p.observedMetrics}
