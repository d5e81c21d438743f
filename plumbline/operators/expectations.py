"""Expectations: what a column must satisfy, and how many rows have to.

Row expectations give a verdict column, batch expectations a frame of results.
Both kinds are looked up by the names a suite file uses.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import map_as_text
from plumbline.functions.vectors import blend
from plumbline.operators import scorers, verdicts
from plumbline.operators.drift import (
    BASELINE_SHARE,
    DRIFT_THRESHOLD,
    LOOKBACK_DAYS,
    MEASURES,
    centroids,
    drift_columns,
)
from plumbline.operators.rowchecks import require_column

# Default share of rows that must pass.
THRESHOLD = 0.95
LABEL_THRESHOLD = 0.90

EXPECTATIONS: dict[str, type[Expectation]] = {}


def register_expectation(kind: str) -> Callable[[type[Expectation]], type[Expectation]]:
    """Make an expectation known to suite files under `kind`."""

    def add(cls):
        EXPECTATIONS[kind] = cls
        return cls

    return add


class Expectation(ABC):
    """A column, a name for results, and the pass rate that satisfies it."""

    name: ClassVar[str] = "expectation"

    def __init__(self, column: str, threshold: float = THRESHOLD):
        self.column = column
        self.threshold = float(threshold)


class RowExpectation(Expectation):
    """Judges records one by one, by a column expression.

    `scorer` replaces the built-in judgement: a function of (expectation, frame)
    that returns a struct column of passed, confidence, reason and evidence.
    """

    def __init__(self, column, threshold=THRESHOLD, scorer: Callable[..., Column] | None = None):
        super().__init__(column, threshold)
        self.scorer = scorer

    def verdict(self, df: DataFrame) -> Column:
        require_column(df, self.column)
        return self.scorer(self, df) if self.scorer else self.judge(df)

    @abstractmethod
    def judge(self, df: DataFrame) -> Column:
        """The built-in verdict."""

    def criterion(self) -> str:
        return f"'{self.column}' must hold"

    def record(self, df: DataFrame) -> Mapping[str, Column]:
        """The values an outside judge gets to see, by label."""
        return {self.column: optional_column(df, self.column)}

    context = ""

    def payloads(self, df: DataFrame, index: str) -> DataFrame:
        """One row per record for an outside judge."""
        require_column(df, self.column)
        return df.select(
            F.lit(self.name).alias("expectation"),
            F.lit(self.column).alias("column_name"),
            F.col(index).cast("long").alias("record_index"),
            verdicts.payload(self.criterion(), self.record(df), self.context).alias("payload"),
        )


class BatchExpectation(Expectation):
    """Judges a whole batch at once."""

    @abstractmethod
    def evaluate(self, df: DataFrame) -> DataFrame:
        """One row: total_records, passed, confidence, reason, evidence."""


def optional_column(df: DataFrame, name: str) -> Column:
    """The column, or empty text where the frame lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit("")


@register_expectation("factual_consistency")
class FactualConsistency(RowExpectation):
    """A generated text must not contradict its reference."""

    name = "expect_column_to_be_factually_consistent_with"

    def __init__(self, column, reference_column, context="", threshold=THRESHOLD, scorer=None):
        super().__init__(column, threshold, scorer)
        self.reference_column = reference_column
        self.context = context

    def judge(self, df):
        return scorers.score_consistency(
            optional_column(df, self.column), optional_column(df, self.reference_column)
        )

    def criterion(self):
        return f"Nothing stated in '{self.column}' may contradict '{self.reference_column}'."

    def record(self, df):
        return {
            self.column: optional_column(df, self.column),
            self.reference_column: optional_column(df, self.reference_column),
        }


@register_expectation("hallucination_detection")
class NoInventedEntities(RowExpectation):
    """Every entity in a generated text must come from the source columns."""

    name = "expect_column_to_not_hallucinate_entities"

    def __init__(
        self, column, source_columns: Sequence[str], entity_types: Sequence[str] | None = None,
        threshold=THRESHOLD, scorer=None,
    ):
        super().__init__(column, threshold, scorer)
        self.source_columns = list(source_columns)
        self.entity_types = list(entity_types or scorers.ENTITY_PATTERNS)

    def judge(self, df):
        sources = {name: optional_column(df, name) for name in self.source_columns}
        return scorers.score_entities(optional_column(df, self.column), sources, self.entity_types)

    def criterion(self):
        kinds = ", ".join(self.entity_types)
        return f"Each of the {kinds} in '{self.column}' must appear in a source field."

    def record(self, df):
        return {name: optional_column(df, name) for name in [self.column, *self.source_columns]}


@register_expectation("label_accuracy")
class LabelMatchesContent(RowExpectation):
    """A label must agree with the content it was given to.

    Judged by a lexicon of words per label, or by a `predicted_column` some
    classifier filled (see `drift.nearest_label`).
    """

    name = "expect_label_to_match_content"

    def __init__(
        self, column, content_column, label_descriptions: Mapping[str, str] | None = None,
        threshold=LABEL_THRESHOLD, lexicon: Mapping[str, Sequence[str]] | None = None,
        predicted_column: str | None = None, confidence_column: str | None = None, scorer=None,
    ):
        super().__init__(column, threshold, scorer)
        self.content_column = content_column
        self.label_descriptions = dict(label_descriptions or {})
        self.lexicon = lexicon or {k: v.lower().split() for k, v in self.label_descriptions.items()}
        self.predicted_column = predicted_column
        self.confidence_column = confidence_column

    def judge(self, df):
        label, content = optional_column(df, self.column), optional_column(df, self.content_column)
        if self.predicted_column:
            sure = F.col(self.confidence_column) if self.confidence_column else F.lit(1.0)
            return scorers.score_label_by_prediction(label, content, F.col(self.predicted_column), sure)
        if not self.lexicon:
            raise ValueError(f"{self.name}({self.column}) needs a lexicon, descriptions or predictions")
        return scorers.score_label_by_words(label, content, self.lexicon)

    def criterion(self):
        meanings = "; ".join(f"{k}={v}" for k, v in self.label_descriptions.items())
        hint = f" Label meanings: {meanings}" if meanings else ""
        return f"The label in '{self.column}' must fit the content of '{self.content_column}'.{hint}"

    def record(self, df):
        return {
            self.column: optional_column(df, self.column),
            self.content_column: optional_column(df, self.content_column),
        }


@register_expectation("semantic_drift")
class SemanticDrift(BatchExpectation):
    """The centre of a batch of embeddings must stay near its baseline.

    `baseline` is a one-row frame with a `centroid`; without one the batch
    passes and `next_baseline` is its own centroid.
    """

    name = "expect_semantic_drift_below"

    def __init__(
        self, column, threshold=DRIFT_THRESHOLD, lookback_days=LOOKBACK_DAYS,
        baseline: DataFrame | None = None, measure: str = "cosine",
    ):
        super().__init__(column, threshold)
        if measure not in MEASURES:
            raise ValueError(f"unknown measure {measure!r}")
        self.lookback_days, self.baseline, self.measure = lookback_days, baseline, measure

    def set_baseline(self, baseline: DataFrame) -> None:
        self.baseline = baseline

    def _compared(self, df: DataFrame) -> DataFrame:
        require_column(df, self.column)
        only = centroids(df, self.column).agg(F.first(F.struct("n", "centroid")).alias("_c"))
        centre = only.select(
            F.coalesce("_c.n", F.lit(0)).alias("n"), F.col("_c.centroid").alias("centroid")
        )
        before = F.lit(None).cast("array<double>")
        if self.baseline is not None:
            before = self.baseline.select("centroid").scalar()
        return centre.withColumn("_before", before)

    def evaluate(self, df):
        compared = self._compared(df)
        by_dot, by_cosine = drift_columns(F.col("centroid"), F.col("_before"))
        measured = compared.select(
            "n", F.col("_before").isNull().alias("_first"),
            by_dot.alias("drift_dot"), by_cosine.alias("drift_cosine"),
        )
        drift = F.col(f"drift_{self.measure}")
        # An empty batch has no centre: it is not passed, unless there is nothing to compare with.
        passed = F.col("_first") | F.coalesce(drift <= self.threshold, F.lit(False))
        reason = F.when(passed, F.lit("")).otherwise(F.format_string(
            f"drift %.4f is over {self.threshold} against the {self.lookback_days}-day baseline", drift
        ))
        return measured.select(
            F.col("n").alias("total_records"),
            passed.alias("passed"),
            F.lit(1.0).alias("confidence"),
            reason.alias("reason"),
            F.create_map(
                F.lit("drift_dot"), F.col("drift_dot").cast("string"),
                F.lit("drift_cosine"), F.col("drift_cosine").cast("string"),
                F.lit("threshold"), F.lit(str(self.threshold)),
            ).alias("evidence"),
        )

    def next_baseline(self, df: DataFrame) -> DataFrame:
        """The baseline after this batch; it moves whether or not the batch passed."""
        moved = blend(F.col("_before"), F.col("centroid"), BASELINE_SHARE)
        return self._compared(df).select(
            F.when(F.col("_before").isNull(), F.col("centroid"))
            .when(F.col("centroid").isNull(), F.col("_before"))
            .otherwise(moved).alias("centroid")
        )


def expectation_from(check: Mapping[str, Any]) -> Expectation | None:
    """An expectation from one entry of a suite file; None for an unknown type."""
    cls = EXPECTATIONS.get(check.get("type"))
    return None if cls is None else cls(**{k: v for k, v in check.items() if k != "type"})


def described(labels: Column) -> Column:
    """Label descriptions of a map column as `k=v; k=v`."""
    return map_as_text(labels)
