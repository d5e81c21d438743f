"""Row-ordered windows over series of any length.

A series without a key, or with one key holding much of the table, must not end
up in one task. `order_blocks` range-partitions the rows by (keys, order) into
blocks of similar size whatever the key spread, and cuts the lineage there, so
block numbers and row positions stay the same when a lost executor's work is redone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import column_or_null, first_truthy
from plumbline.operators.rowchecks import ID_COLUMNS, time_or_now, violation
from plumbline.rules import EXPECTED_NULL_RATE, SMALLEST_WINDOW, NullRateRule
from plumbline.session import stable

BLOCK = "_block"
POSITION = "_position"

# Rows of a block: what one task sorts and holds, whatever the size of the table.
ROWS_PER_TASK = 250_000


def block_count(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """As many blocks as the rows need; the plan is the same for one block and for many."""
    return max(1, -(-df.count() // rows_per_task))


def order_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int) -> DataFrame:
    """Rows sorted by (keys, order) across `blocks` partitions, with block and position.

    `order` must be total within a key. The last block may be empty.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(blocks, *by).sortWithinPartitions(*by)
    stamped = ranged.withColumn("_stamp", F.monotonically_increasing_id())
    return stable(
        stamped.select(
            *df.columns,
            F.shiftright("_stamp", 33).cast("int").alias(BLOCK),
            F.col("_stamp").bitwiseAND((1 << 33) - 1).alias(POSITION),
        )
    )


def number_rows(blocked: DataFrame, into: str) -> DataFrame:
    """A dense row number from 0 over all blocks: rows of earlier blocks plus the position."""
    sizes = blocked.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per block, so both the window and the broadcast are as small as the block count.
    offsets = sizes.select(BLOCK, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return blocked.join(F.broadcast(offsets), BLOCK).withColumn(
        into, F.col("_offset") + F.col(POSITION)
    ).drop("_offset", BLOCK, POSITION)


def previous_value(
    df: DataFrame,
    value: str,
    into: str,
    *,
    order: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The value of the row before, null for the first of a series.

    Inside a block it is a `lag`; the first row of a block takes it from the last
    row of the block before, if that is of the same series. One such row per block
    is broadcast.
    """
    blocked = order_blocks(df, keys, order, block_count(df, rows_per_task))
    inside = Window.partitionBy(BLOCK, *keys).orderBy(POSITION)
    last = F.struct(F.col(value).alias("value"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ends = blocked.groupBy(BLOCK).agg(F.max_by(last, POSITION).alias("_end"))
    ends = ends.select(BLOCK, F.lag("_end").over(Window.orderBy(BLOCK)).alias("_end"))
    same = F.col("_end").isNotNull() & (F.col(POSITION) == 0)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_end.k{i}"))
    lagged = blocked.withColumn(into, F.lag(value).over(inside)).join(F.broadcast(ends), BLOCK)
    return lagged.withColumn(into, F.when(same, F.col("_end.value")).otherwise(F.col(into))).select(*df.columns, into)


def rolling_rate(
    df: DataFrame,
    flag: Column,
    size: int,
    *,
    order: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
    rate: str = "rate",
    rows: str = "rows_in_window",
) -> DataFrame:
    """Share of rows with `flag` set among the last `size` rows, current one included.

    Running counts and one `lag` make the cost per row independent of `size`.
    Rows are numbered across blocks, cut into stretches, and each stretch gets the
    `size - 1` rows before it, so no task holds more than a stretch of a series.
    """
    marked = df.withColumn("_flag", F.coalesce(flag.cast("int"), F.lit(0)))
    blocks = block_count(marked, rows_per_task)
    numbered = number_rows(order_blocks(marked, keys, order, blocks), "_row")
    stretch = max(rows_per_task, size)
    home = F.floor(F.col("_row") / stretch)
    reaches_next = F.floor((F.col("_row") + size - 1) / stretch) > home
    spread = numbered.withColumn(
        "_home", F.explode(F.when(reaches_next, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("_stretch", home + F.col("_home"))
    rated = _rate_in_groups(spread, ["_stretch", *keys], ["_row"], size, rate, rows)
    return rated.where("_home = 0").drop("_flag", "_row", "_home", "_stretch")


def _rate_in_groups(df, keys, order, size, rate, rows) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    counted = df.withColumn("_flags", F.sum("_flag").over(running)).withColumn(
        rows, F.least(F.row_number().over(window), F.lit(size))
    )
    left_window = F.coalesce(F.lag("_flags", size).over(window), F.lit(0))
    return counted.withColumn(rate, (F.col("_flags") - left_window) / F.col(rows)).drop("_flags")


def null_rate_violations(
    df: DataFrame,
    topic: str,
    rule: NullRateRule,
    *,
    order: Sequence[str],
    keys: Sequence[str] = (),
    time_column: str | None = None,
    id_columns: Sequence[str] = ID_COLUMNS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """A violation at every record where the rolling null rate is over the threshold."""
    schema = df.schema
    slim = df.select(
        *dict.fromkeys([*keys, *order]),
        column_or_null(schema, rule.column).isNull().alias("_null"),
        first_truthy(schema, id_columns).alias("_id"),
        time_or_now(schema, time_column).alias("_at"),
    )
    rated = rolling_rate(
        slim, F.col("_null"), rule.window_size, order=order, keys=keys, rows_per_task=rows_per_task
    )
    return rate_violations(rated, topic, rule)


def rate_violations(rated: DataFrame, topic: str, rule: NullRateRule) -> DataFrame:
    over = rated.where(
        (F.col("rows_in_window") >= SMALLEST_WINDOW) & (F.col("rate") > F.lit(rule.threshold))
    )
    return over.select(
        F.inline(F.array(violation(
            topic,
            rule,
            F.round("rate", 4).cast("string"),
            F.lit(EXPECTED_NULL_RATE.format(threshold=rule.threshold)),
            F.col("_id"),
            F.col("_at"),
        )))
    )
