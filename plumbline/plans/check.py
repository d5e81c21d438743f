"""A rule set compiled against a schema: which rules run as columns, windows or scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from plumbline.operators import baseline, ordered, rowchecks
from plumbline.rules import RuleSet


@dataclass(frozen=True)
class CheckPlan:
    """Checks of one topic, ready to run on any frame with the topic's columns.

    `order` puts the records in sequence for the rules that look back; `keys`
    gives every entity its own window and baseline instead of one per topic.
    """

    rules: RuleSet
    order: Sequence[str] = ()
    keys: Sequence[str] = ()
    time_column: str | None = None
    id_columns: Sequence[str] = rowchecks.ID_COLUMNS
    rows_per_task: int = ordered.ROWS_PER_TASK

    def __post_init__(self) -> None:
        if not self.order and self.rules.of("null_rate", "statistical"):
            raise ValueError("null_rate and statistical rules need an order for the records")

    def row_violations(self, df: DataFrame) -> DataFrame:
        return rowchecks.violations(
            df, self.rules, time_column=self.time_column, id_columns=self.id_columns
        )

    def window_violations(self, df: DataFrame) -> list[DataFrame]:
        options = {
            "order": self.order, "keys": self.keys, "time_column": self.time_column,
            "id_columns": self.id_columns, "rows_per_task": self.rows_per_task,
        }
        rates = [
            ordered.null_rate_violations(df, self.rules.topic, rule, **options)
            for rule in self.rules.of("null_rate")
        ]
        scores = [
            baseline.statistical_violations(df, self.rules.topic, rule, **options)
            for rule in self.rules.statistical
        ]
        return rates + scores

    def violations(self, df: DataFrame) -> DataFrame:
        """Everything the rule set finds; one scan for all per-record rules."""
        parts = [self.row_violations(df), *self.window_violations(df)]
        return reduce(DataFrame.unionByName, parts)


def compile_rules(rules: RuleSet, **options) -> CheckPlan:
    return CheckPlan(rules, **options)
