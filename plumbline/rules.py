"""Rule sets: what a user declares about one topic, checked on the driver.

A rule set holds configuration only. `operators.rowchecks` and
`operators.ordered` turn it into columns.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields
from pathlib import Path
from typing import Any, ClassVar

import yaml

# Severities in rising order, defaults and bounds of the rule format.
SEVERITIES = ("info", "warning", "critical")
DEFAULT_SEVERITY = "warning"
DEFAULT_WINDOW_SIZE = 1000
DEFAULT_Z_THRESHOLD = 3.0
DEFAULT_MIN_SAMPLES = 100
SMALLEST_WINDOW = 10
BASELINE_ALPHA = 0.05

# Wording of `expected` in violations; %.3f stands for mean and deviation.
EXPECTED_NOT_NULL = "non-null value"
EXPECTED_NUMBER = "numeric value"
EXPECTED_RANGE = "[{min}, {max}]"
EXPECTED_PATTERN = "matches /{pattern}/"
EXPECTED_NULL_RATE = "null_rate < {threshold}"
EXPECTED_Z_SCORE = "within {threshold} std dev of baseline (mean=%.3f, std=%.3f)"


class RuleError(ValueError):
    """A rule set that cannot be used, with the rule at fault named."""


@dataclass(frozen=True, kw_only=True)
class Rule:
    """Common part of every rule. `kind` is the value of `type` in a rule file."""

    name: str
    column: str
    severity: str = DEFAULT_SEVERITY
    description: str = ""
    kind: ClassVar[str] = ""

    def __post_init__(self) -> None:
        if not self.name or not self.column:
            raise RuleError("a rule needs a name and a column")
        if self.severity not in SEVERITIES:
            self._reject(f"severity must be one of {', '.join(SEVERITIES)}")
        self.validate()

    def validate(self) -> None:
        """Bounds of the fields a rule type adds."""

    def _reject(self, why: str) -> None:
        raise RuleError(f"rule {self.name!r}: {why}")

    def _number(self, label: str) -> float:
        value = getattr(self, label)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            self._reject(f"{label} must be a number")
        return float(value)

    def _whole(self, label: str, at_least: int) -> None:
        value = getattr(self, label)
        if isinstance(value, bool) or not isinstance(value, int) or value < at_least:
            self._reject(f"{label} must be a whole number of at least {at_least}")


@dataclass(frozen=True, kw_only=True)
class NotNullRule(Rule):
    kind: ClassVar[str] = "not_null"


@dataclass(frozen=True, kw_only=True)
class RangeRule(Rule):
    min: float | None = None
    max: float | None = None
    kind: ClassVar[str] = "range"

    def validate(self) -> None:
        for label in ("min", "max"):
            if getattr(self, label) is not None:
                object.__setattr__(self, label, self._number(label))


@dataclass(frozen=True, kw_only=True)
class RegexRule(Rule):
    pattern: str
    kind: ClassVar[str] = "regex"

    def validate(self) -> None:
        try:
            re.compile(self.pattern)
        except (re.error, TypeError) as problem:
            raise RuleError(f"rule {self.name!r}: bad pattern: {problem}") from problem


@dataclass(frozen=True, kw_only=True)
class NullRateRule(Rule):
    threshold: float
    window_size: int = DEFAULT_WINDOW_SIZE
    kind: ClassVar[str] = "null_rate"

    def validate(self) -> None:
        if not 0.0 < self._number("threshold") <= 1.0:
            self._reject("threshold must lie in (0, 1]")
        object.__setattr__(self, "threshold", float(self.threshold))
        self._whole("window_size", SMALLEST_WINDOW)


@dataclass(frozen=True, kw_only=True)
class StatisticalRule(Rule):
    z_score_threshold: float = DEFAULT_Z_THRESHOLD
    min_samples: int = DEFAULT_MIN_SAMPLES
    kind: ClassVar[str] = "statistical"

    def validate(self) -> None:
        if self._number("z_score_threshold") <= 0.0:
            self._reject("z_score_threshold must be above 0")
        object.__setattr__(self, "z_score_threshold", float(self.z_score_threshold))
        self._whole("min_samples", SMALLEST_WINDOW)
        # A value is part of the baseline it is scored against, so z has a ceiling.
        if self.z_score_threshold >= 1.0 / math.sqrt(BASELINE_ALPHA):
            warnings.warn(
                f"rule {self.name!r}: z after the update stays below "
                f"{1.0 / math.sqrt(BASELINE_ALPHA):.3f}, so this threshold cannot fire",
                stacklevel=2,
            )


RULE_TYPES: dict[str, type[Rule]] = {}


def register_rule_type(rule_type: type[Rule]) -> type[Rule]:
    """Make a rule type known to rule files under its `kind`."""
    if not rule_type.kind:
        raise RuleError(f"{rule_type.__name__} has no kind")
    RULE_TYPES[rule_type.kind] = rule_type
    return rule_type


for _builtin in (NotNullRule, RangeRule, RegexRule, NullRateRule, StatisticalRule):
    register_rule_type(_builtin)


def _rule_from(entry: Mapping[str, Any]) -> Rule:
    if not isinstance(entry, Mapping):
        raise RuleError(f"a rule must be a mapping, got {entry!r}")
    rule_type = RULE_TYPES.get(entry.get("type"))
    if rule_type is None:
        raise RuleError(f"rule {entry.get('name')!r}: unknown type {entry.get('type')!r}")
    accepted = {f.name: f for f in fields(rule_type)}
    given = {k: v for k, v in entry.items() if k in accepted}
    missing = [n for n, f in accepted.items() if f.default is MISSING and n not in given]
    if missing:
        raise RuleError(f"rule {entry.get('name')!r}: missing {', '.join(missing)}")
    return rule_type(**given)


@dataclass(frozen=True)
class RuleSet:
    """The rules of one topic."""

    topic: str
    rules: tuple[Rule, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(self.rules))
        if not self.topic:
            raise RuleError("a rule set needs a topic")
        names = [r.name for r in self.rules]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise RuleError(f"rule names must differ: {', '.join(twice)}")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> RuleSet:
        if not isinstance(data, Mapping) or "topic" not in data or "rules" not in data:
            raise RuleError("a rule set needs `topic` and `rules`")
        return cls(data["topic"], tuple(_rule_from(r) for r in data["rules"] or ()))

    @classmethod
    def from_yaml(cls, path: str | Path) -> RuleSet:
        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    def of(self, *kinds: str) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.kind in kinds)

    @property
    def statistical(self) -> tuple[Rule, ...]:
        return self.of("statistical")

    @property
    def deterministic(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.kind != "statistical")

    @property
    def per_record(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.kind not in ("null_rate", "statistical"))
