"""Table profiles, schema differences, and what kind of anomaly two profiles show."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import ratio

# Kinds of anomaly in the order they are looked for.
ANOMALY_TYPES = ("schema_drift", "volume_drop", "null_spike", "distribution_shift", "logic_error")


def profile_columns(
    df: DataFrame, table: str, columns: Sequence[str] | None = None, *, distinct: bool = False
) -> DataFrame:
    """Rows, nulls and null rate of every column, from one aggregate over one scan.

    `distinct` adds an approximate distinct count.
    """
    names = list(columns or df.columns)
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(names):
        aggregates.append(F.count_if(F.col(f"`{name}`").isNull()).alias(f"_n{i}"))
        if distinct:
            aggregates.append(F.approx_count_distinct(f"`{name}`").alias(f"_d{i}"))
    lines = []
    for i, name in enumerate(names):
        fields = [
            F.lit(table).alias("table_name"), F.lit(name).alias("column_name"),
            F.col("_rows").alias("row_count"), F.col(f"_n{i}").alias("null_count"),
            ratio(F.col(f"_n{i}"), F.col("_rows")).alias("null_rate"),
        ]
        if distinct:
            fields.append(F.col(f"_d{i}").alias("distinct_count"))
        lines.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*lines)))


def profile_tables(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [profile_columns(df, name, **options) for name, df in tables.items()]
    )


def null_rate(df: DataFrame, column: str) -> DataFrame:
    """Share of nulls in one column; 0.0 for an empty table or a missing column."""
    is_null = F.col(f"`{column}`").isNull() if column in df.columns else F.lit(False)
    return df.agg(F.coalesce(F.avg(is_null.cast("int")), F.lit(0.0)).alias("null_rate"))


def schema_frame(df: DataFrame) -> DataFrame:
    """(name, type) of a frame's columns."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string")


def observed_schema(df: DataFrame, json_column: str, by: Sequence[str] = ()) -> DataFrame:
    """(name, type) of the top-level fields that JSON documents in a column really have."""
    fields = F.map_entries(F.from_json(F.col(json_column), "map<string,variant>"))
    exploded = df.select(*by, F.explode(fields).alias("_f"))
    return exploded.select(
        *by, F.col("_f.key").alias("name"), F.schema_of_variant("_f.value").alias("type")
    ).distinct()


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two (name, type) frames."""
    old = before.select("name", F.col("type").alias("old_type"))
    new = after.select("name", F.col("type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return old.join(new, "name", "full").withColumn("change", change).where("change is not null")


@dataclass(frozen=True)
class AnomalyLimits:
    """When a difference counts: rows left, rise of the null rate, stability index."""

    rows_left: float = 0.5
    null_rate_rise: float = 0.05
    stability_index: float = 0.2


def stability_index(before: DataFrame, after: DataFrame, bin_of: Column) -> DataFrame:
    """Population stability index of two frames over the same bins.

    Shares of bins one side lacks count as half a row, so the index stays finite.
    """

    def counts(df, into):
        return df.where(bin_of.isNotNull()).groupBy(bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias(into))

    both = counts(before, "_old").join(counts(after, "_new"), "_bin", "full").fillna(0)
    totals = both.agg(F.sum("_old").alias("_olds"), F.sum("_new").alias("_news"))
    shares = both.withColumn("_t", totals.select(F.struct("_olds", "_news")).scalar())
    old = F.greatest(F.col("_old"), F.lit(0.5)) / F.greatest(F.col("_t._olds"), F.lit(1))
    new = F.greatest(F.col("_new"), F.lit(0.5)) / F.greatest(F.col("_t._news"), F.lit(1))
    return shares.agg(F.coalesce(F.sum((new - old) * F.log(new / old)), F.lit(0.0)).alias("stability_index"))


def equal_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0; values outside [low, high) fall into the outermost bins."""
    step = (high - low) / bins
    inside = F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), F.lit(bins - 1))
    return F.when(value.isNotNull(), inside)


def classify_anomaly(
    before: DataFrame,
    after: DataFrame,
    column: str,
    bin_of: Column,
    *,
    schema_changes: DataFrame | None = None,
    limits: AnomalyLimits = AnomalyLimits(),
) -> DataFrame:
    """One row: the first kind of anomaly that fits, how sure, and the figures behind it.

    `before` and `after` are two states of a table, `bin_of` bins its failing column.
    """
    changes = schema_diff(schema_frame(before), schema_frame(after)) if schema_changes is None else schema_changes

    def figures(df, prefix):
        missing = F.col(f"`{column}`").isNull() if column in df.columns else F.lit(True)
        return df.agg(
            F.count(F.lit(1)).alias(f"rows_{prefix}"),
            F.coalesce(F.avg(missing.cast("int")), F.lit(0.0)).alias(f"null_rate_{prefix}"),
        )

    old, new = figures(before, "before"), figures(after, "after")
    measured = new.select(
        "*",
        old.select(F.struct("*")).scalar().alias("_old"),
        changes.agg(F.count(F.lit(1))).scalar().alias("schema_changes"),
    ).select("_old.*", "rows_after", "null_rate_after", "schema_changes")
    if column in before.columns and column in after.columns:
        shift = stability_index(before, after, bin_of).scalar()
    else:
        shift = F.lit(0.0)
    measured = measured.withColumn("stability_index", shift)
    rows_left = F.col("rows_after") / F.greatest(F.col("rows_before"), F.lit(1))
    rise = F.col("null_rate_after") - F.col("null_rate_before")
    kinds = [
        (F.col("schema_changes") > 0, F.lit(1.0)),
        ((F.col("rows_before") > 0) & (rows_left < limits.rows_left), 1.0 - rows_left),
        (rise > limits.null_rate_rise, F.least(rise / limits.null_rate_rise / 2, F.lit(1.0))),
        (
            F.col("stability_index") > limits.stability_index,
            F.least(F.col("stability_index") / limits.stability_index / 2, F.lit(1.0)),
        ),
    ]
    kind, sure = F.lit(ANOMALY_TYPES[-1]), F.lit(0.0)
    for name, (applies, confidence) in reversed(list(zip(ANOMALY_TYPES, kinds))):
        kind = F.when(applies, F.lit(name)).otherwise(kind)
        sure = F.when(applies, confidence).otherwise(sure)
    return measured.select(kind.alias("anomaly_type"), sure.alias("confidence"), "*")
