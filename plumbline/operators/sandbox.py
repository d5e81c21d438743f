"""Trying a candidate fix: a query over registered tables, judged by assertions.

Fixes run in a session of their own and can only read the tables given to them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.assertions import (
    COULD_NOT_RUN,
    DETAIL,
    Assertion,
    assertion_rollup,
    derive_assertions,
    run_assertions,
)

# Attempts before an incident is escalated, name of a fix that did not run.
MAX_ATTEMPTS = 3
EXECUTION = "sql_execution"

# Things a plain query can call that reach outside the given tables.
OUTSIDE_CALLS = re.compile(
    r"ScriptTransformation|\b(?:reflect|java_method|try_reflect)\s*\(|CallMethodViaReflection", re.IGNORECASE
)
RELATION = re.compile(r"'UnresolvedRelation \[([^\]]*)\]")
NAMED_INSIDE = re.compile(r"CTE \[([^\]]*)\]")


class UnsafeFix(ValueError):
    """A fix that is more than a query over the given tables."""


@dataclass(frozen=True)
class FixResult:
    """`details` has one row per assertion, `summary` one row."""

    details: DataFrame
    summary: DataFrame
    fixed: DataFrame | None
    error: str = ""


class Sandbox:
    """Tables under their own names in a session that shares no temporary views."""

    def __init__(self, spark: SparkSession):
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.session.timeZone", "UTC")
        # Keeps `format.\`path\`` from being read as a table.
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self._shared: list[str] = []
        self.tables: set[str] = set()

    def load_table(self, name: str, df: DataFrame) -> None:
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"not a table name: {name!r}")
        shared = f"plumbline_{uuid4().hex}"
        df.createOrReplaceGlobalTempView(shared)
        self._shared.append(shared)
        self.session.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM global_temp.{shared}")
        self.tables.add(name.lower())

    def execute_fix(self, fix_sql: str) -> DataFrame:
        """The result of a fix, as a frame nothing has run for yet.

        The text is put where only a query can stand, so a command or an insert
        is a syntax error; Spark's own plan of it then shows what it reads.
        """
        query = f"SELECT * FROM (\n{fix_sql.strip().rstrip(';')}\n) AS fix"
        self._check(query)
        return self.session.sql(query)

    def _check(self, query: str) -> None:
        plan = self.session.sql(f"EXPLAIN EXTENDED {query}").first()[0]
        if OUTSIDE_CALLS.search(plan):
            raise UnsafeFix("a fix may not call scripts or Java methods")
        parsed = plan.split("== Analyzed Logical Plan ==")[0]
        inside = {n.strip().lower() for names in NAMED_INSIDE.findall(parsed) for n in names.split(",")}
        # A CTE must not lend its name to a catalog table read inside it.
        inside = {n for n in inside - self.tables if not self.session.catalog.tableExists(n)}
        for relation in RELATION.findall(parsed):
            if relation.strip().lower() not in self.tables | inside:
                raise UnsafeFix(f"a fix may only read the tables it was given, not {relation!r}")

    def close(self) -> None:
        for name in self._shared:
            self.session.catalog.dropGlobalTempView(name)
        self._shared.clear()

    def __enter__(self) -> Sandbox:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def validate_fix(
    sandbox: Sandbox,
    fix_sql: str,
    failing_tests: Sequence[Mapping[str, Any]] = (),
    *,
    assertions: Sequence[Assertion] | None = None,
    order: Sequence[str] | None = None,
) -> FixResult:
    """Run a fix and assert on what it returns. A fix that cannot run, to its last row, fails one test."""
    try:
        fixed = sandbox.execute_fix(fix_sql)
        checks = list(assertions) if assertions is not None else derive_assertions(failing_tests)
        details = run_assertions(fixed, checks, order=order)
        if not details.where("error IS NOT NULL").isEmpty():
            fixed.write.format("noop").mode("overwrite").save()  # raises if it is the fix that fails
        return FixResult(details, assertion_rollup(details), fixed)
    except (PySparkException, UnsafeFix) as problem:
        message = str(problem).splitlines()[0]
        rows = [(EXECUTION, False, COULD_NOT_RUN, "", [], message)]
        details = sandbox.session.createDataFrame(rows, DETAIL)
        return FixResult(details, assertion_rollup(details), None, message)


def next_status(fix_sql: str, passed: bool, iteration: int, max_attempts: int = MAX_ATTEMPTS) -> tuple[str, int]:
    """Where an incident goes after an attempt, and the number of attempts made."""
    if not fix_sql:
        return "escalated", iteration
    if passed:
        return "pending_approval", iteration
    made = iteration + 1
    return ("escalated" if made >= max_attempts else "fixing"), made
