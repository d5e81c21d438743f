"""Assertions on a table: each passes if no row, or no group of rows, breaks it.

Assertions about single rows share one aggregate; assertions about groups get
one each. A broken assertion shows a few of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.firsts import first_rows

# Rows shown per broken assertion, failures of one that could not run.
SAMPLES = 3
COULD_NOT_RUN = -1

DETAIL = (
    "name string, passed boolean, failures long, description string, "
    "sample_failures array<string>, error string"
)


@dataclass(frozen=True, kw_only=True)
class Assertion:
    name: str
    description: str = ""


@dataclass(frozen=True, kw_only=True)
class RowAssertion(Assertion):
    """Broken by every row `broken` holds for."""

    broken: Column


@dataclass(frozen=True, kw_only=True)
class GroupAssertion(Assertion):
    """Broken by every row of the frame `broken_rows` makes of the table."""

    broken_rows: Any


def not_null(column: str) -> RowAssertion:
    """NULL breaks it, the empty string does not."""
    return RowAssertion(
        name=f"not_null_{column}", broken=F.col(f"`{column}`").isNull(),
        description=f"{column} must not be null",
    )


def accepted_values(column: str, accepted: Sequence[Any]) -> RowAssertion:
    """Values compare as text; NULL is accepted."""
    broken = F.coalesce(~F.col(f"`{column}`").cast("string").isin([str(v) for v in accepted]), F.lit(False))
    return RowAssertion(
        name=f"accepted_values_{column}", broken=broken,
        description=f"{column} must hold accepted values only",
    )


def unique(column: str, *, nulls: str = "count") -> GroupAssertion:
    """Counts values that occur more than once; `nulls="ignore"` leaves NULL out."""
    if nulls not in ("count", "ignore"):
        raise ValueError(f"nulls must be 'count' or 'ignore', got {nulls!r}")

    def repeated(df: DataFrame) -> DataFrame:
        value = F.col(f"`{column}`")
        rows = df.where(value.isNotNull()) if nulls == "ignore" else df
        return rows.groupBy(value).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")

    return GroupAssertion(
        name=f"unique_{column}", broken_rows=repeated, description=f"{column} must not repeat"
    )


def row_count_positive() -> GroupAssertion:
    def empty(df: DataFrame) -> DataFrame:
        return df.limit(1).agg(F.count(F.lit(1)).alias("rows")).where("rows = 0")

    return GroupAssertion(
        name="row_count_positive", broken_rows=empty, description="there must be at least one row"
    )


def relationships(column: str, parent: DataFrame, parent_column: str) -> GroupAssertion:
    """Rows whose value the parent column lacks; NULL refers to nothing and passes."""

    def orphans(df: DataFrame) -> DataFrame:
        known = parent.select(F.col(f"`{parent_column}`").alias("_known"))
        referring = df.where(F.col(f"`{column}`").isNotNull())
        return referring.join(known, referring[f"`{column}`"] == known["_known"], "left_anti")

    return GroupAssertion(
        name=f"relationships_{column}", broken_rows=orphans,
        description=f"{column} must occur in {parent_column}",
    )


def _row_counts(df: DataFrame, rows: Sequence[RowAssertion]) -> DataFrame:
    counted = df.agg(*[F.count_if(a.broken).alias(f"_f{i}") for i, a in enumerate(rows)])
    lines = [
        F.struct(F.lit(a.name).alias("name"), F.col(f"_f{i}").alias("failures"),
                 F.lit(a.description).alias("description"))
        for i, a in enumerate(rows)
    ]
    return counted.select(F.inline(F.array(*lines)))


def _row_samples(
    df: DataFrame, rows: Sequence[RowAssertion], order: Sequence[str], samples: int
) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(a.broken, F.lit(a.name)) for a in rows]))
    any_broken = reduce(lambda x, y: x | y, [a.broken for a in rows])
    whole_row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # Rows are ordered by their order columns and a hash; only the few that stay are written as text.
    hit = df.where(any_broken).select(
        F.explode(names).alias("_assertion"), whole_row.alias("_whole"), F.xxhash64(F.to_json(whole_row)).alias("_tie"),
        *[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(order)],
    )
    by = [f"_by{i}" for i in range(len(order))]
    firsts = first_rows(hit, ["_assertion"], [*by, "_tie"], samples, rank="_rank")
    return _listed(firsts.select(F.col("_assertion").alias("name"), "_rank", F.to_json("_whole").alias("_row")))


def _listed(ranked: DataFrame) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("_rank", "_row")))
    return ranked.groupBy("name").agg(
        F.transform(in_order, lambda s: s["_row"]).alias("sample_failures")
    )


def _group_details(broken: DataFrame, assertion: GroupAssertion, samples: int) -> DataFrame:
    counted = broken.agg(F.count(F.lit(1)).alias("failures"))
    # Order by the row's own text: a fixed choice whatever the partitions.
    rows = broken.select(F.to_json(F.struct("*")).alias("_row")).orderBy("_row").limit(samples)
    listed = rows.agg(F.array_sort(F.collect_list("_row")).alias("_rows")).select("_rows").scalar()
    return counted.select(
        F.lit(assertion.name).alias("name"),
        "failures",
        F.lit(assertion.description).alias("description"),
        listed.alias("sample_failures"),
    )


def run_assertions(
    df: DataFrame, assertions: Sequence[Assertion], *, order: Sequence[str] | None = None, samples: int = SAMPLES
) -> DataFrame:
    """One row per assertion: passed, failures, up to `samples` of the failing rows as JSON.

    `order` says which failing rows come first; by default the first column.
    Assertions run here: what comes to the driver is one row per assertion. One that
    cannot be resolved against the table, or that fails while it runs, fails with -1.
    """
    order = list(order or df.columns[:1])
    by_row = [a for a in assertions if isinstance(a, RowAssertion)]
    found = _ran(df, by_row, order, samples) if by_row else []
    for assertion in assertions:
        if not isinstance(assertion, RowAssertion):
            found += _ran(df, [assertion], order, samples)
    return df.sparkSession.createDataFrame(found, DETAIL)


def _ran(df: DataFrame, assertions: Sequence[Assertion], order: Sequence[str], samples: int) -> list[tuple]:
    """Details of assertions that share a scan; one by one if they cannot run together."""
    try:
        if isinstance(assertions[0], RowAssertion):
            part = _row_counts(df, assertions).join(_row_samples(df, assertions, order, samples), "name", "left")
        else:
            part = _group_details(assertions[0].broken_rows(df), assertions[0], samples)
        rows = {r["name"]: r for r in part.collect()}
        return [
            (a.name, rows[a.name]["failures"] == 0, rows[a.name]["failures"], a.description,
             rows[a.name]["sample_failures"] or [], None)
            for a in assertions
        ]
    except PySparkException as problem:
        if len(assertions) > 1:
            return [line for a in assertions for line in _ran(df, [a], order, samples)]
        return [(assertions[0].name, False, COULD_NOT_RUN, assertions[0].description, [], first_line(problem))]


def first_line(problem: Exception) -> str:
    return (str(problem).splitlines() or [""])[0]


def assertion_rollup(details: DataFrame) -> DataFrame:
    """Tests run, passed and failed; no tests at all pass."""
    return details.agg(
        F.coalesce(F.every("passed"), F.lit(True)).alias("passed"),
        F.count(F.lit(1)).alias("tests_run"),
        F.count_if(F.col("passed")).alias("tests_passed"),
        F.count_if(~F.col("passed")).alias("tests_failed"),
    )


def derive_assertions(failing_tests: Sequence[Mapping[str, Any]]) -> list[Assertion]:
    """The assertions a fix must meet, from the tests that failed.

    A `relationships` test only asks for rows, as the parent table is not part
    of a fix; where nothing can be derived, rows are all that is asked for.
    """
    derived: list[Assertion] = []
    for test in failing_tests:
        column, kind = test.get("column_name") or "", test.get("test_type")
        accepted = test.get("accepted_values")
        if kind == "not_null" and column:
            derived.append(not_null(column))
        elif kind == "unique" and column:
            derived.append(unique(column))
        elif kind == "accepted_values" and column and accepted:
            derived.append(accepted_values(column, accepted))
        elif kind == "relationships":
            derived.append(row_count_positive())
    return derived or [row_count_positive()]


def assertions_of_model(failing: DataFrame, model: str) -> list[Assertion]:
    """The same from the failing tests of a run (see `sources.dbt`), those of one model: as many as it has tests."""
    of_model = failing.where(F.col("model") == model).select("test_type", "column_name", "accepted_values")
    return derive_assertions([r.asDict() for r in of_model.distinct().orderBy("test_type", "column_name").collect()])
