"""Checks that need one record only: not-null, range, regex and user-made rule types.

All rules of a set run in one projection over one scan. Records that break no
rule are dropped by a plain filter before any violation struct is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import (
    NUMBER_PATTERN,
    column_or_null,
    first_truthy,
    java_pattern,
    to_number,
    type_or_string,
)
from plumbline.rules import (
    EXPECTED_NOT_NULL,
    EXPECTED_NUMBER,
    EXPECTED_PATTERN,
    EXPECTED_RANGE,
    NotNullRule,
    RangeRule,
    RegexRule,
    Rule,
    RuleSet,
)
from plumbline.schemas import VIOLATION

# Fixed value: columns tried in turn for the id of a record.
ID_COLUMNS = ("id", "record_id")


@dataclass(frozen=True)
class Finding:
    """What one rule says about one record. A null `broken` means it is not."""

    broken: Column
    expected: Column
    value: Column


RowCheck = Callable[[Rule, Column, T.DataType], Finding]


def _check_not_null(rule: NotNullRule, value: Column, data_type: T.DataType) -> Finding:
    broken = value.isNull()
    if isinstance(data_type, T.StringType):
        broken = broken | (value == "")
    return Finding(broken, F.lit(EXPECTED_NOT_NULL), value.cast("string"))


def _check_range(rule: RangeRule, value: Column, data_type: T.DataType) -> Finding:
    is_text = isinstance(data_type, T.StringType)
    # In text the pattern decides once what is a number; the bounds then need the cast only.
    number = F.trim(value).try_cast("double") if is_text else to_number(value, data_type)
    outside = []
    if rule.min is not None:
        outside.append(number < rule.min)
    if rule.max is not None:
        outside.append(number > rule.max)
    # NaN compares false with every bound, where Spark would sort it above all.
    beyond = _any(outside) & ~F.isnan(number)
    bounds = F.lit(EXPECTED_RANGE.format(min=rule.min, max=rule.max))
    if is_text:
        not_numeric = ~value.rlike(NUMBER_PATTERN)
    elif isinstance(data_type, (T.NumericType, T.BooleanType)):
        return Finding(beyond, bounds, value.cast("string"))
    else:
        not_numeric = F.lit(True)
    broken = F.when(value.isNull(), False).when(not_numeric, True).otherwise(beyond)
    expected = F.when(not_numeric, F.lit(EXPECTED_NUMBER)).otherwise(bounds)
    return Finding(broken, expected, value.cast("string"))


def _check_regex(rule: RegexRule, value: Column, data_type: T.DataType) -> Finding:
    text = value.cast("string")
    return Finding(
        ~text.rlike(java_pattern(rule.pattern)), F.lit(EXPECTED_PATTERN.format(pattern=rule.pattern)), text
    )


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


ROW_CHECKS: dict[str, RowCheck] = {
    NotNullRule.kind: _check_not_null,
    RangeRule.kind: _check_range,
    RegexRule.kind: _check_regex,
}


def register_row_check(kind: str, check: RowCheck) -> None:
    """Say how rules of a user-made `kind` are checked."""
    ROW_CHECKS[kind] = check


def finding(rule: Rule, schema: T.StructType) -> Finding:
    """The rule as columns; a column the frame lacks reads as null."""
    check = ROW_CHECKS.get(rule.kind)
    if check is None:
        raise ValueError(f"rule {rule.name!r}: no row check for type {rule.kind!r}")
    return check(rule, column_or_null(schema, rule.column), type_or_string(schema, rule.column))


def time_or_now(schema: T.StructType, time_column: str | None) -> Column:
    at = F.col(f"`{time_column}`") if time_column else F.current_timestamp()
    return at.cast("timestamp")


def violation(
    topic: Column | str,
    rule: Rule,
    value: Column,
    expected: Column,
    record_id: Column,
    at: Column,
    z_score: Column | None = None,
) -> Column:
    """One violation struct."""
    fields = {
        "type": F.lit("violation"),
        "topic": F.lit(topic) if isinstance(topic, str) else topic,
        "rule_name": F.lit(rule.name),
        "column": F.lit(rule.column),
        "value": value,
        "expected": expected,
        "severity": F.lit(rule.severity),
        "z_score": F.lit(None) if z_score is None else z_score,
        "timestamp": at,
        "record_id": record_id,
    }
    return F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in VIOLATION])


def violations(
    df: DataFrame,
    rules: RuleSet,
    *,
    time_column: str | None = None,
    id_columns: Sequence[str] = ID_COLUMNS,
) -> DataFrame:
    """One row per broken per-record rule, several per record where several break."""
    schema = df.schema
    found = [(rule, finding(rule, schema)) for rule in rules.per_record]
    if not found:
        return df.sparkSession.createDataFrame([], VIOLATION)
    record_id, at = first_truthy(schema, id_columns), time_or_now(schema, time_column)
    structs = [
        F.when(f.broken, violation(rules.topic, rule, f.value, f.expected, record_id, at))
        for rule, f in found
    ]
    return (
        df.where(_any([f.broken for _, f in found]))
        .select(F.inline(F.array(*structs)))
        .where(F.col("rule_name").isNotNull())
    )


def with_violations(
    df: DataFrame,
    rules: RuleSet,
    *,
    time_column: str | None = None,
    id_columns: Sequence[str] = ID_COLUMNS,
    into: str = "violations",
) -> DataFrame:
    """Every record with the array of its violations, in the order of the rules."""
    schema = df.schema
    record_id, at = first_truthy(schema, id_columns), time_or_now(schema, time_column)
    structs = []
    for rule in rules.per_record:
        f = finding(rule, schema)
        structs.append(
            F.when(f.broken, violation(rules.topic, rule, f.value, f.expected, record_id, at))
        )
    listed = F.array_compact(F.array(*structs)) if structs else F.array().cast(T.ArrayType(VIOLATION))
    return df.withColumn(into, listed)


def quarantine(df: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """Records that break no per-record rule, and those that break at least one."""
    flagged = _any([finding(rule, df.schema).broken for rule in rules.per_record])
    return df.where(~F.coalesce(flagged, F.lit(False))), df.where(flagged)


def violation_messages(df: DataFrame, rules: RuleSet, **options) -> DataFrame:
    """One JSON array of violations per offending record; clean records send nothing."""
    flagged = _any([finding(rule, df.schema).broken for rule in rules.per_record])
    listed = with_violations(df.where(flagged), rules, into="_violations", **options)
    return listed.select(
        F.element_at("_violations", 1)["record_id"].alias("key"),
        F.to_json("_violations").alias("value"),
    )


def of_topic(found: DataFrame, topic: str | None) -> DataFrame:
    """Violations of one topic, or all of them."""
    return found.where(F.col("topic") == topic) if topic else found


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"there is no column {name!r} among {', '.join(df.columns)}")
