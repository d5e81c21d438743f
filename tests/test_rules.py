import re

import pytest

from plumbline.functions.values import java_pattern
from plumbline.rules import RuleError, RuleSet

YAML = """
topic: lines
rules:
  - {name: tax_share, type: range, column: l_tax, min: 0.0, max: 0.08, severity: critical}
  - {name: status_given, type: not_null, column: l_linestatus}
  - {name: mode_word, type: regex, column: l_shipmode, pattern: '^[A-Z ]+$'}
  - {name: price_gaps, type: null_rate, column: l_extendedprice, threshold: 0.3, window_size: 40}
  - {name: price_jump, type: statistical, column: l_extendedprice}
"""


def one(**rule):
    return RuleSet.from_dict({"topic": "t", "rules": [{"name": "r", "column": "c", **rule}]})


def test_yaml_gives_all_types_and_defaults(tmp_path):
    path = tmp_path / "rules.yml"
    path.write_text(YAML)
    rules = RuleSet.from_yaml(path)
    assert [r.kind for r in rules.rules] == ["range", "not_null", "regex", "null_rate", "statistical"]
    assert rules.rules[1].severity == "warning"
    assert (rules.statistical[0].z_score_threshold, rules.statistical[0].min_samples) == (3.0, 100)
    assert len(rules.deterministic) == 4 and len(rules.per_record) == 3


@pytest.mark.parametrize("rule", [
    {"type": "regex", "pattern": "["},
    {"type": "regex"},
    {"type": "sometimes"},
    {"type": "null_rate", "threshold": 0.0},
    {"type": "null_rate", "threshold": 1.1},
    {"type": "null_rate", "threshold": 0.5, "window_size": 9},
    {"type": "statistical", "z_score_threshold": 0},
    {"type": "statistical", "min_samples": 9},
    {"type": "not_null", "severity": "fatal"},
    {"type": "range", "min": "low"},
])
def test_unusable_rules_are_rejected(rule):
    with pytest.raises(RuleError):
        one(**rule)


def test_extra_keys_are_ignored_and_names_must_differ():
    assert one(type="not_null", owner="me").rules[0].name == "r"
    twice = {"name": "r", "column": "c", "type": "not_null"}
    with pytest.raises(RuleError, match="differ"):
        RuleSet.from_dict({"topic": "t", "rules": [twice, twice]})


def test_threshold_above_the_ceiling_warns():
    with pytest.warns(UserWarning, match="cannot fire"):
        one(type="statistical", z_score_threshold=4.5)


@pytest.mark.parametrize("pattern, text", [
    (r"(?P<a_b>x)(?P=a_b)", "xx"), (r"\d", "٣"), (r"end\Z", "the end"), (r"a.c", "a\rc"), (r"(?i)ABC", "xabcx"),
])
def test_patterns_mean_the_same_on_the_jvm(spark, pattern, text):
    from pyspark.sql import functions as F

    found = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java_pattern(pattern))).first()[0]
    assert found == bool(re.search(pattern, text))
