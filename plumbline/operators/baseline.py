"""Learned baselines: each value scored against a mean and variance that follow the series.

The baseline is a fold over the rows of a series in order. To run it on many
tasks, the rows are cut into ordered blocks (`ordered.order_blocks`) and read twice:

1. each block sums up what it does to a baseline carried into it, for the first
   and the last series it holds only; series inside a block need no carry;
2. those few rows per block are folded along each series, which gives the
   baseline every block starts from, and the blocks are scored side by side.

Both reads stream Arrow batches; a task never holds more than one batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.smoothing import Baseline, Drift, Moments
from plumbline.functions.values import (
    column_or_null,
    finite,
    first_truthy,
    to_number,
    type_or_string,
)
from plumbline.operators.ordered import (
    BLOCK,
    POSITION,
    ROWS_PER_TASK,
    block_count,
    order_blocks,
)
from plumbline.operators.rowchecks import ID_COLUMNS, time_or_now, violation
from plumbline.rules import BASELINE_ALPHA, EXPECTED_Z_SCORE, StatisticalRule

VALUE = "_x"
# A packed baseline as text: null in all but a few rows, which Arrow moves far
# more cheaply as a string than as an array.
CARRIED = "_carried"

# What the scoring pass adds to each row with a usable value.
STATE_FIELDS = ("n", "run_mean", "run_var", "mean", "var", "mean_before", "var_before")

_EDGE_FIELDS = [
    T.StructField("_is_first", T.BooleanType()),
    T.StructField("_start", T.StringType()),
    T.StructField("_n", T.LongType()),
    T.StructField("_mean", T.DoubleType()),
    T.StructField("_m2", T.DoubleType()),
    T.StructField("_whole", T.ArrayType(T.DoubleType())),
    T.StructField("_head", T.ArrayType(T.DoubleType())),
    T.StructField("_after_head", T.ArrayType(T.DoubleType())),
]


def _series_starts(batch: pa.RecordBatch, keys: Sequence[str], previous: tuple | None) -> np.ndarray:
    """Row numbers at which the key differs from the row before; row 0 compares with `previous`."""
    rows = batch.num_rows
    changed = np.zeros(rows, dtype=bool)
    for key in keys:
        column = batch.column(key)
        left, right = column.slice(0, rows - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(left, right), False)
        one_null = pc.xor(pc.is_null(left), pc.is_null(right))
        changed[1:] |= pc.or_(differs, one_null).to_numpy(zero_copy_only=False)
    changed[0] = previous is None or previous != _key_at(batch, keys, 0)
    return np.flatnonzero(changed)


def _key_at(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(key)[row].as_py() for key in keys)


def _stretches(batch: pa.RecordBatch, keys: Sequence[str], previous: tuple | None):
    """(starts a series, from row, to row) for each run of equal keys in the batch."""
    starts = _series_starts(batch, keys, previous)
    bounds = starts if len(starts) and starts[0] == 0 else np.concatenate(([0], starts))
    fresh = set(starts.tolist())
    ends = np.append(bounds[1:], batch.num_rows)
    return [(int(a) in fresh, int(a), int(b)) for a, b in zip(bounds, ends, strict=True)]


class _Edge:
    """Running summary of one series inside one block."""

    def __init__(self, key: tuple, is_first: bool):
        self.key, self.is_first = key, is_first
        self.start: str | None = None
        self.moments = Moments()
        self.head: list[float] = []
        self.whole: Drift | None = None
        self.after_head: Drift | None = None

    def add(self, values: np.ndarray, min_samples: int, alpha: float) -> None:
        if len(values) == 0:
            return
        if self.whole is None:
            self.whole = Drift(float(values[0]))
            self.after_head = Drift(float(values[0]))
        self.moments = self.moments.extend(values)
        self.whole = self.whole.then(values, alpha)
        room = min_samples - len(self.head)
        if room > 0:
            self.head.extend(values[:room].tolist())
            values = values[room:]
        self.after_head = self.after_head.then(values, alpha)

    def summary(self) -> list:
        def packed(drift):
            return None if drift is None else list(vars(drift).values())

        m = self.moments
        return [
            self.is_first, self.start, m.n, m.mean, m.m2,
            packed(self.whole), self.head, packed(self.after_head),
        ]


def _summarise(keys: Sequence[str], min_samples: int, alpha: float):
    """Pass 1: a summary of the first and the last series of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = previous = batch = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = batch.column(VALUE).to_numpy(zero_copy_only=False)
            carried = batch.column(CARRIED)
            parts = _stretches(batch, keys, previous)
            for place, (fresh, a, b) in enumerate(parts):
                if first is None:
                    first = last = _Edge(_key_at(batch, keys, a), True)
                elif fresh:
                    if place < len(parts) - 1:
                        continue
                    last = _Edge(_key_at(batch, keys, a), False)
                if carried[a].is_valid:
                    last.start = carried[a].as_py()
                chunk = values[a:b]
                last.add(chunk[~np.isnan(chunk)], min_samples, alpha)
            previous = _key_at(batch, keys, batch.num_rows - 1)
            block = batch.column(BLOCK)[0].as_py()
        if first is None:
            return
        edges = [first] if first is last else [first, last]
        columns = {BLOCK: pa.array([block] * len(edges), pa.int32())}
        for i, key in enumerate(keys):
            columns[key] = pa.array([e.key[i] for e in edges], batch.schema.field(key).type)
        doubles = pa.list_(pa.float64())
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.float64(), pa.float64(), doubles, doubles, doubles]
        for field, kind, cells in zip(
            _EDGE_FIELDS, kinds, zip(*[e.summary() for e in edges], strict=True), strict=True
        ):
            columns[field.name] = pa.array(list(cells), kind)
        yield pa.RecordBatch.from_pydict(columns)

    return run


def _fold(min_samples: int, alpha: float):
    """The baseline each block starts from, folding one series' summaries in block order."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(BLOCK)
        state = Baseline.fresh()
        blocks, carried = [], []
        rows = zip(edges[BLOCK], *[edges[f.name] for f in _EDGE_FIELDS], strict=True)
        for block, is_first, start, n, mean, m2, whole, head, after_head in rows:
            if is_first and state.moments.n:
                blocks.append(block)
                carried.append(state.pack())
            if start is not None:
                state = Baseline.unpack(start)
            if n == 0:
                continue
            moments = state.moments.merge(Moments(int(n), mean, m2))
            if state.warm:
                state.mean, state.variance = Drift(*whole).apply(state.mean, state.variance)
            else:
                state.feed(np.asarray(head, dtype=np.float64), min_samples, alpha)
                if n > len(head):
                    state.mean, state.variance = Drift(*after_head).apply(state.mean, state.variance)
            state.moments = moments
        return pd.DataFrame({BLOCK: pd.Series(blocks, dtype="int32"), CARRIED: carried})

    return run


def _block_entries(blocked: DataFrame, keys: Sequence[str], min_samples: int, alpha: float) -> DataFrame:
    """(block, baseline it starts from) for blocks that begin inside a series."""
    schema = blocked.schema
    edge_schema = T.StructType([schema[BLOCK], *[schema[k] for k in keys], *_EDGE_FIELDS])
    slim = blocked.select(BLOCK, *keys, VALUE, CARRIED)
    edges = slim.mapInArrow(_summarise(keys, min_samples, alpha), edge_schema)
    # At most two rows per block from here on.
    series = Window.partitionBy(*keys)
    earlier = series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    chains = (
        edges.withColumn("_links", F.count(F.lit(1)).over(series))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where("_links > 1")
        .withColumn("_head", F.when(F.col("_before") < min_samples, F.col("_head")))
    )
    entry_schema = T.StructType(
        [schema[BLOCK], T.StructField(CARRIED, T.StringType())]
    )
    return chains.groupBy(*keys).applyInPandas(_fold(min_samples, alpha), entry_schema)


def _score(keys: Sequence[str], min_samples: int, alpha: float, kept: Sequence[str]):
    """Pass 2: the state at every row, starting from the carried baseline if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, previous, started = Baseline.fresh(), None, False
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            values = batch.column(VALUE).to_numpy(zero_copy_only=False)
            out = {name: np.full(rows, np.nan) for name in STATE_FIELDS}
            carried = batch.column(CARRIED)
            with_carry = set(np.flatnonzero(pc.is_valid(carried).to_numpy(zero_copy_only=False)).tolist())
            for fresh, a, b in _stretches(batch, keys, previous):
                if a in with_carry:
                    state = Baseline.unpack(carried[a].as_py())
                elif fresh or not started:
                    state = Baseline.fresh()
                started = True
                usable = np.flatnonzero(~np.isnan(values[a:b])) + a
                if len(usable) == 0:
                    continue
                fed = state.feed(values[usable], min_samples, alpha)
                for name in STATE_FIELDS:
                    out[name][usable] = fed[name]
            previous = _key_at(batch, keys, rows - 1)
            arrays = [batch.column(name) for name in kept]
            names = list(kept)
            for name in STATE_FIELDS:
                column = pa.array(out[name], from_pandas=True)
                arrays.append(column.cast(pa.int64()) if name == "n" else column)
                names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def learn_baseline(
    df: DataFrame,
    value: str,
    *,
    order: Sequence[str],
    keys: Sequence[str] = (),
    min_samples: int,
    alpha: float = BASELINE_ALPHA,
    carry: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """`df` with the baseline of its series after and before every row.

    Adds `n`, `run_mean`, `run_var` (all values so far) and `mean`, `var`,
    `mean_before`, `var_before` (smoothed; null until `min_samples` values were
    seen). Rows whose value is null or not finite get nulls and move nothing.
    `carry` (the keys and `_carried`, see `carry_over`) continues earlier series.
    """
    taken = sorted(set(df.columns) & set(STATE_FIELDS))
    if taken:
        raise ValueError(f"columns {', '.join(taken)} would be overwritten; rename them first")
    number = finite(to_number(F.col(f"`{value}`"), df.schema[value].dataType))
    marked = df.withColumn(VALUE, number).withColumn(CARRIED, F.lit(None).cast("string"))
    by = list(order)
    if carry is not None:
        # A carried baseline travels as a row ahead of its series; nulls sort first.
        starts = carry.select(*keys, CARRIED).withColumn("_ahead", F.lit(0))
        marked = marked.withColumn("_ahead", F.lit(1)).unionByName(starts, allowMissingColumns=True)
        by = ["_ahead", *by]
    blocked = order_blocks(marked, keys, by, block_count(marked, rows_per_task))
    # One entry per block at most, so the broadcast is bounded by the block count.
    entries = _block_entries(blocked, keys, min_samples, alpha).select(
        BLOCK, F.lit(0).cast("long").alias(POSITION), F.col(CARRIED).alias("_entry")
    )
    lined_up = blocked.join(F.broadcast(entries), [BLOCK, POSITION], "left").withColumn(
        CARRIED, F.coalesce("_entry", CARRIED)
    )
    kept = [*df.columns, *(["_ahead"] if carry is not None else [])]
    out_schema = T.StructType(
        [lined_up.schema[name] for name in kept]
        + [T.StructField(f, T.LongType() if f == "n" else T.DoubleType()) for f in STATE_FIELDS]
    )
    scored = lined_up.select(*kept, VALUE, CARRIED).mapInArrow(
        _score(keys, min_samples, alpha, kept), out_schema
    )
    return scored if carry is None else scored.where("_ahead = 1").drop("_ahead")


def spread_of(variance: Column) -> Column:
    """Standard deviation, 1.0 where the variance is not positive."""
    return F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0))


def z_scores(
    df: DataFrame,
    value: str,
    *,
    score: str = "after_update",
    **options,
) -> DataFrame:
    """`learn_baseline` plus `std` and `z`, the distance from the baseline in deviations.

    `after_update` scores a value against the baseline that already contains it,
    which bounds z by 1/sqrt(alpha); `before_update` leaves the value out.
    """
    if score not in ("after_update", "before_update"):
        raise ValueError(f"unknown score {score!r}")
    tail = "" if score == "after_update" else "_before"
    learned = learn_baseline(df, value, **options)
    number = to_number(F.col(f"`{value}`"), df.schema[value].dataType)
    spread = F.when(F.col(f"var{tail}").isNotNull(), spread_of(F.col(f"var{tail}")))
    return learned.withColumn("std", spread).withColumn(
        "z", F.abs(number - F.col(f"mean{tail}")) / F.col("std")
    )


def statistical_violations(
    df: DataFrame,
    topic: str,
    rule: StatisticalRule,
    *,
    order: Sequence[str],
    keys: Sequence[str] = (),
    time_column: str | None = None,
    id_columns: Sequence[str] = ID_COLUMNS,
    score: str = "after_update",
    carry: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """A violation at every record further from the baseline than the rule allows."""
    slim = statistical_input(df, rule, order=order, keys=keys, time_column=time_column,
                             id_columns=id_columns)
    scored = z_scores(slim, VALUE_COLUMN, score=score, order=order, keys=keys,
                      min_samples=rule.min_samples, carry=carry, rows_per_task=rows_per_task)
    return violations_of_scores(scored, topic, rule, score)


VALUE_COLUMN = "_value"


def statistical_input(df, rule, *, order, keys, time_column, id_columns) -> DataFrame:
    """Only what scoring needs: keys, order, the value as a number, record id and time."""
    schema = df.schema
    number = to_number(column_or_null(schema, rule.column), type_or_string(schema, rule.column))
    return df.select(
        *dict.fromkeys([*keys, *order]),
        number.alias(VALUE_COLUMN),
        first_truthy(schema, id_columns).alias("_id"),
        time_or_now(schema, time_column).alias("_at"),
    )


def violations_of_scores(
    scored: DataFrame, topic: str, rule: StatisticalRule, score: str = "after_update"
) -> DataFrame:
    mean = F.col("mean" if score == "after_update" else "mean_before")
    expected = F.format_string(
        EXPECTED_Z_SCORE.format(threshold=rule.z_score_threshold), mean, F.col("std"),
    )
    return scored.where(F.col("z") > F.lit(rule.z_score_threshold)).select(
        F.inline(F.array(violation(
            topic, rule, F.col(VALUE_COLUMN).cast("string"), expected,
            F.col("_id"), F.col("_at"), F.round("z", 3),
        )))
    )


def last_states(learned: DataFrame, *, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The baseline after the last usable value of every series."""
    state = F.struct("n", "run_mean", "run_var", "mean", "var")
    usable = learned.where(F.col("n").isNotNull())
    latest = F.max_by(state, F.struct(*order)).alias("_s")
    return usable.groupBy(*keys).agg(latest).where("_s is not null").select(*keys, "_s.*")


def carry_over(learned: DataFrame, *, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`carry` for the next run over the same series."""
    packed = F.concat_ws(
        ",",
        F.col("n").cast("double"),
        "run_mean",
        F.col("run_var") * F.col("n"),
        F.coalesce("mean", F.lit(0.0)),
        F.coalesce("var", F.lit(1.0)),
        F.col("mean").isNotNull().cast("double"),
    )
    return last_states(learned, order=order, keys=keys).select(*keys, packed.alias(CARRIED))


def baseline_snapshot(
    learned: DataFrame,
    topic: str,
    rule: StatisticalRule,
    *,
    order: Sequence[str],
    keys: Sequence[str] = (),
    at: Column | None = None,
) -> DataFrame:
    """Count, mean, deviation and warm-up state of each series, rounded to 4 digits."""
    warm = F.col("mean").isNotNull()
    return last_states(learned, order=order, keys=keys).select(
        F.lit(topic).alias("topic"),
        F.lit(rule.name).alias("rule_name"),
        *keys,
        F.round(F.coalesce("mean", "run_mean"), 4).alias("mean_value"),
        F.round(spread_of(F.coalesce("var", "run_var")), 4).alias("std_value"),
        F.col("n").alias("sample_count"),
        warm.alias("warmed_up"),
        (F.current_timestamp() if at is None else at).alias("snapshot_at"),
    )
