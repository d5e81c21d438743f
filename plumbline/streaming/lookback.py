"""Rules that look back, on Spark's own streaming state.

One operator serves all null-rate and statistical rules of a rule set. Series are dealt
to `SERIES_GROUPS` groups by a hash of their keys, and a group keeps in the state store,
per series and rule, a learned baseline or the null flags of its last rows. A micro-batch
then costs a call for each group it touches, not for each series, and the rules run over
all rows of a group at once. What a row breaks comes out as a number; texts are made from
it downstream.

A group goes through one task per micro-batch, as the rows of a series follow each other.
Its rows of one micro-batch are held and sorted there, so the trigger's limits bound
them. Without keys the whole topic is one series; give keys to spread it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.smoothing import Baseline, Moments
from plumbline.functions.values import column_or_null, finite, first_truthy, to_number, type_or_string
from plumbline.operators import baseline, ordered, rowchecks
from plumbline.rules import BASELINE_ALPHA, SMALLEST_WINDOW, NullRateRule, RuleSet, StatisticalRule

# Groups that series are dealt to; a group's state is read and written as one value.
SERIES_GROUPS = 512

# What is kept for a statistical rule: one entry a series in each.
LEARNED = ("n", "mean", "m2", "smooth_mean", "smooth_var", "warm")
RATE, SCORE, STATE = "rate", "score", "state"
_SERIES, _ID, _TIME = "series", "record", "at_us"
_RESULT = (
    "rule int, part string, record string, at_us long, number double, mean double, std double, z double,"
    " rate double, n long, warm boolean"
)


class SeriesRules:
    """All rules that look back, over one group of series at a time."""

    def __init__(
        self, rules: Sequence[NullRateRule | StatisticalRule], order: Sequence[str], *,
        snapshots: bool, ttl_ms: int | None = None, alpha: float = BASELINE_ALPHA,
    ):
        self.rules, self.order, self.snapshots = list(rules), list(order), snapshots
        self.ttl_ms, self.alpha = ttl_ms, alpha

    def state_schema(self) -> str:
        """Series of a group and when they were last seen; per rule their numbers, or their null flags end to end."""
        fields = [f"{_SERIES} array<string>", "seen array<long>"]
        for i, rule in enumerate(self.rules):
            if rule.kind == "null_rate":
                fields += [f"sizes{i} array<int>", f"flags{i} binary"]
            else:
                fields += [f"{name}{i} array<double>" for name in LEARNED]
        return ", ".join(fields)

    def __call__(self, key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        series, seen, kept = self._known(state, now)
        batch = pd.concat(list(frames), ignore_index=True).sort_values(self.order, kind="stable", na_position="first")
        code, names = pd.factorize(np.concatenate([series, batch[_SERIES].to_numpy(dtype=object)]))
        code, new = code[len(series):], len(names) - len(series)
        by_series = np.argsort(code, kind="stable")
        batch, code = batch.iloc[by_series], code[by_series]
        seen = np.concatenate([seen, np.zeros(new, dtype=np.int64)])
        seen[code] = now
        values = [names.tolist(), seen.tolist()]
        for i, rule in enumerate(self.rules):
            check = self._rates if rule.kind == "null_rate" else self._scores
            found, numbers = check(batch, code, i, rule, kept[i], new)
            values += numbers
            for part in found:
                if len(part):
                    part["rule"] = np.int32(i)
                    whole = part.reindex(columns=[c.split()[0] for c in _RESULT.split(", ")])
                    yield whole.astype({"part": object, _ID: object})
        state.update(tuple(values))
        if self.ttl_ms is not None:
            state.setTimeoutDuration(self.ttl_ms)

    def _known(self, state: GroupState, now: int) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
        """Series that are not forgotten, when they were seen, and per rule what is kept of them."""
        values = list(state.get) if state.exists else None
        series = np.array(values[0] if values else [], dtype=object)
        seen = np.array(values[1] if values else [], dtype=np.int64)
        alive = np.ones(len(series), dtype=bool) if self.ttl_ms is None else seen + self.ttl_ms > now
        kept, at = [], 2
        for rule in self.rules:
            if rule.kind == "null_rate":
                sizes = np.array(values[at] if values else [], dtype=np.int64)
                flags = np.frombuffer(bytes(values[at + 1]) if values else b"", dtype=np.uint8)
                kept.append([sizes[alive], flags[np.repeat(alive, sizes)]])
                at += 2
            else:
                kept.append([np.array(values[at + j] if values else [], dtype=float)[alive] for j in range(len(LEARNED))])
                at += len(LEARNED)
        return series[alive], seen[alive], kept

    def _rates(
        self, batch: pd.DataFrame, code: np.ndarray, i: int, rule: NullRateRule, kept: list[np.ndarray], new: int,
    ) -> tuple[list[pd.DataFrame], list[Any]]:
        sizes, tails = np.concatenate([kept[0], np.zeros(new, dtype=np.int64)]), kept[1]
        # Flags of each series end to end, those kept ahead of those that came.
        owner = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), code])
        place = np.argsort(owner, kind="stable")
        owner = owner[place]
        flags = np.concatenate([tails, batch[f"missing{i}"].to_numpy(dtype=bool).astype(np.uint8)])[place]
        whole = sizes + np.bincount(code, minlength=len(sizes))
        end = np.cumsum(whole)
        seen = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        came = place >= len(tails)
        last = np.flatnonzero(came) + 1
        first = np.maximum(last - rule.window_size, (end - whole)[owner[came]])
        rate, size = (seen[last] - seen[first]) / (last - first), last - first
        over = (size >= SMALLEST_WINDOW) & (rate > rule.threshold)
        stays = end[owner] - np.arange(len(flags)) <= rule.window_size - 1
        numbers = [np.minimum(whole, rule.window_size - 1).tolist(), flags[stays].tobytes()]
        return [self._found(batch, over, RATE, rate=rate[over])], numbers

    def _scores(
        self, batch: pd.DataFrame, code: np.ndarray, i: int, rule: StatisticalRule, kept: list[np.ndarray], new: int,
    ) -> tuple[list[pd.DataFrame], list[Any]]:
        fresh = Baseline.fresh()
        start = (0.0, 0.0, 0.0, fresh.mean, fresh.variance, 0.0)
        learned = [np.concatenate([old, np.full(new, first)]) for old, first in zip(kept, start)]
        x = batch[f"x{i}"].to_numpy(dtype=float)
        mean, var, usable = np.full(len(x), np.nan), np.full(len(x), np.nan), np.isfinite(x)
        bounds = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
        for low, high in zip(bounds[:-1], bounds[1:]):
            which, rows = code[low], low + np.flatnonzero(usable[low:high])
            n, own_mean, m2, smooth_mean, smooth_var, warm = (float(a[which]) for a in learned)
            state = Baseline(Moments(int(n), own_mean, m2), smooth_mean, smooth_var, bool(warm))
            fed = state.feed(x[rows], rule.min_samples, self.alpha)
            mean[rows], var[rows] = fed["mean"], fed["var"]
            m = state.moments
            for a, number in zip(learned, (m.n, m.mean, m.m2, state.mean, state.variance, state.warm)):
                a[which] = number
        std = np.where(var > 0, np.sqrt(np.maximum(var, 0)), 1.0)
        z = np.abs(x - mean) / std
        over = usable & (z > rule.z_score_threshold)
        found = [self._found(batch, over, SCORE, number=x[over], mean=mean[over], std=std[over], z=z[over])]
        if self.snapshots and len(x):
            variance = state.variance if state.warm else m.variance
            found.append(pd.DataFrame({
                "part": [STATE], "mean": [state.mean if state.warm else m.mean],
                "std": [variance**0.5 if variance > 0 else 1.0], "n": [m.n], "warm": [bool(state.warm)]}))
        return found, [a.tolist() for a in learned]

    def _found(self, batch: pd.DataFrame, over: np.ndarray, part: str, **numbers: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"part": part, _ID: batch[_ID].to_numpy()[over], _TIME: batch[_TIME].to_numpy()[over], **numbers})


def _signless(stream: DataFrame, key: str) -> Column:
    """A key as it is grouped by: zero has one sign."""
    floating = isinstance(stream.select(key).schema[0].dataType, (T.FloatType, T.DoubleType))
    return F.when(F.col(key) == 0, F.abs(key)).otherwise(F.col(key)) if floating else F.col(key)


def look_back_results(
    stream: DataFrame, rules: RuleSet, *, order: Sequence[str], keys: Sequence[str] = (),
    time_column: str | None = None, id_columns: Sequence[str] = rowchecks.ID_COLUMNS, ttl_seconds: float | None = None,
) -> DataFrame:
    """Rates over and scores beyond what the rules allow, as numbers; without keys also each batch's baselines.

    With `ttl_seconds` a series that is quiet for so long of processing time is forgotten.
    """
    schema, kinds = stream.schema, rules.of("null_rate", "statistical")
    columns = []
    for i, rule in enumerate(kinds):
        if rule.kind == "null_rate":
            columns.append(column_or_null(schema, rule.column).isNull().alias(f"missing{i}"))
        else:
            number = finite(to_number(column_or_null(schema, rule.column), type_or_string(schema, rule.column)))
            columns.append(number.cast("double").alias(f"x{i}"))
    named = F.struct(*[_signless(stream, k).alias(f"key{i}") for i, k in enumerate(keys)]) if keys else None
    series = F.to_json(named, {"ignoreNullFields": "false"}) if keys else F.lit(rules.topic)
    group = F.pmod(F.xxhash64(series), F.lit(SERIES_GROUPS)) if keys else F.lit(0).cast("long")
    # Names of the stream's own columns need not be names Python knows.
    slim = stream.select(
        group.alias("group"), series.alias(_SERIES), *[F.col(o).alias(f"order{i}") for i, o in enumerate(order)], *columns, first_truthy(schema, id_columns).alias(_ID),
        F.unix_micros(rowchecks.time_or_now(schema, time_column)).alias(_TIME),
    )
    each = SeriesRules(
        kinds, [f"order{i}" for i in range(len(order))], snapshots=not keys,
        ttl_ms=None if ttl_seconds is None else int(ttl_seconds * 1000))
    timeout = GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return slim.groupBy("group").applyInPandasWithState(each.__call__, _RESULT, each.state_schema(), "append", timeout)


def violations_of_results(results: DataFrame, rules: RuleSet) -> list[DataFrame]:
    """Violations of one micro-batch's results, rule by rule."""
    out = []
    for i, rule in enumerate(rules.of("null_rate", "statistical")):
        mine = results.where((F.col("rule") == i) & (F.col("part") != STATE))
        mine = mine.select("*", F.col(_ID).alias("_id"), F.timestamp_micros(_TIME).alias("_at"), F.col("number").alias(baseline.VALUE_COLUMN))
        if rule.kind == "null_rate":
            out.append(ordered.rate_violations(mine.withColumn("rows_in_window", F.lit(rule.window_size)), rules.topic, rule))
        else:
            out.append(baseline.violations_of_scores(mine, rules.topic, rule))
    return out


def snapshots_of_results(results: DataFrame, rules: RuleSet) -> DataFrame | None:
    """The baseline of every statistical rule after a micro-batch."""
    named = [F.when(F.col("rule") == i, F.lit(rule.name)) for i, rule in enumerate(rules.of("null_rate", "statistical"))]
    if not rules.statistical:
        return None
    return results.where(F.col("part") == STATE).select(
        F.lit(rules.topic).alias("topic"), F.coalesce(*named, F.lit(None)).alias("rule_name"),
        F.round("mean", 4).alias("mean_value"), F.round("std", 4).alias("std_value"),
        F.col("n").alias("sample_count"), F.col("warm").alias("warmed_up"), F.current_timestamp().alias("snapshot_at"),
    )
