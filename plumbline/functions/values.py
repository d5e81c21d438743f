"""Column helpers shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.rules import SEVERITIES

# Fixed value: what counts as a number in text (blanks around it, exponent, inf and nan allowed).
NUMBER_PATTERN = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def column_or_null(schema: T.StructType, name: str) -> Column:
    """The column, or a null string where the schema has none of that name."""
    return F.col(f"`{name}`") if name in schema.names else F.lit(None).cast("string")


def type_or_string(schema: T.StructType, name: str) -> T.DataType:
    return schema[name].dataType if name in schema.names else T.StringType()


def to_number(value: Column, data_type: T.DataType) -> Column:
    """Double, or null where the value is not a number."""
    if isinstance(data_type, T.StringType):
        return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def finite(number: Column) -> Column:
    """Null instead of NaN and the infinities."""
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def truthy_text(value: Column, data_type: T.DataType) -> Column:
    """Text of a value; null where it is empty, zero or false."""
    if isinstance(data_type, T.BooleanType):
        return F.when(value, value.cast("string"))
    if isinstance(data_type, T.NumericType):
        return F.when(value != 0, value.cast("string"))
    text = value.cast("string")
    return F.when(text != "", text)


def first_truthy(schema: T.StructType, names: tuple[str, ...] | list[str]) -> Column:
    """Text of the first column that holds something, else the empty string."""
    found = [truthy_text(F.col(f"`{n}`"), schema[n].dataType) for n in names if n in schema.names]
    return F.coalesce(*found, F.lit(""))


def rank_of_severity(severity: Column) -> Column:
    """Position in the rising order of severities; unknown ones rank lowest."""
    rank = F.lit(0)
    for position, name in enumerate(SEVERITIES):
        if position:
            rank = F.when(severity == name, position).otherwise(rank)
    return rank


def severity_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0.0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def clip(text: Column, width: int) -> Column:
    return F.substring(text, 1, width)


def ellipsize(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(clip(text, width), F.lit("…"))).otherwise(text)


def map_as_text(pairs: Column) -> Column:
    """`k=v; k=v` in the map's own order."""
    return F.array_join(
        F.transform(F.map_entries(pairs), lambda e: F.concat_ws("=", e["key"], e["value"])), "; "
    )


def minute_floor(at: Column) -> Column:
    return F.date_trunc("minute", at)


def age_seconds(at: Column, now: Column) -> Column:
    """Whole seconds between two timestamps, cut towards zero."""
    return ((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000).cast("long")


def last_name_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def first_name_part(name: Column, default: str) -> Column:
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", 1)).otherwise(F.lit(default))


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def java_pattern(pattern: str) -> str:
    """A Python pattern in the JVM's dialect.

    Named groups are renamed (Java allows no underscore in them), `\\Z` becomes
    `\\z`, and the flags make `\\w`, `\\d` Unicode-aware and `.`, `$` know only `\\n`.
    """
    names: dict[str, str] = {}

    def group(found: re.Match) -> str:
        alias = names.setdefault(found["name"], f"g{len(names) + 1}")
        return f"{found['lead']}(?<{alias}>"

    def back_reference(found: re.Match) -> str:
        return f"{found['lead']}\\k<{names.get(found['name'], found['name'])}>"

    unescaped = r"(?<!\\)(?P<lead>(?:\\\\)*)"
    spelled = re.sub(unescaped + r"\(\?P<(?P<name>\w+)>", group, pattern)
    spelled = re.sub(unescaped + r"\(\?P=(?P<name>\w+)\)", back_reference, spelled)
    spelled = re.sub(unescaped + r"\\Z", lambda m: m["lead"] + "\\z", spelled)
    return "(?dU)" + spelled
