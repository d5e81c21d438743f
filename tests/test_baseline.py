import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_ordered import series

from plumbline.functions.smoothing import Baseline, smooth
from plumbline.operators import baseline
from plumbline.rules import RuleSet

ALPHA = 0.05


def fold(values, min_samples):
    """The baseline one value at a time: (n, mean, deviation, z) after each."""
    n, total, squares, mean, variance, out = 0, 0.0, 0.0, None, None, []
    seen = []
    for x in values:
        seen.append(x)
        n += 1
        if mean is None and n >= min_samples:
            mean = sum(seen) / n
            variance = sum((s - mean) ** 2 for s in seen) / n or 1.0
        elif mean is not None:
            mean = ALPHA * x + (1 - ALPHA) * mean
            variance = ALPHA * (x - mean) ** 2 + (1 - ALPHA) * variance
        if mean is None:
            out.append((n, None, None, None))
        else:
            std = math.sqrt(variance) if variance > 0 else 1.0
            out.append((n, mean, std, abs(x - mean) / std))
    return out


def expected(data, min_samples, keyed=True):
    groups = {}
    for seq, key, x in sorted(data, key=lambda r: r[0]):
        if x is not None and math.isfinite(x):
            groups.setdefault(key if keyed else None, []).append((seq, x))
    return {
        seq: state
        for group in groups.values()
        for (seq, _), state in zip(group, fold([x for _, x in group], min_samples))
    }


def check(got, want, count):
    assert len(got) == count
    for r in got:
        n, mean, std, z = want.get(r["seq"], (None, None, None, None))
        assert r["n"] == n
        for name, value in (("mean", mean), ("std", std), ("z", z)):
            if value is None:
                assert r[name] is None
            else:
                assert abs(r[name] - value) < 1e-9


@pytest.mark.parametrize("rows_per_task", [100_000, 25])
@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("min_samples", [10, 60])
def test_equals_the_sequential_fold(spark, rows_per_task, keyed, min_samples):
    """With 25 rows per block, warm-up reaches over several blocks."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        data = series(400, seed=min_samples)
        data[7] = (*data[7][:2], float("nan"))
        data[8] = (*data[8][:2], float("inf"))
        df = spark.createDataFrame(data, "seq long, key int, x double")
        scored = baseline.z_scores(df, "x", order=["seq"], keys=["key"] if keyed else [],
                                   min_samples=min_samples, rows_per_task=rows_per_task)
        check(rows(scored), expected(data, min_samples, keyed), len(data))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("rows_per_task", [100_000, 25])
def test_carry_continues_a_series(spark, rows_per_task):
    data = series(400, seed=3)
    df = spark.createDataFrame(data, "seq long, key int, x double")
    options = {"order": ["seq"], "keys": ["key"], "min_samples": 20, "rows_per_task": rows_per_task}
    first = baseline.learn_baseline(df.where("seq < 150"), "x", **options)
    carry = baseline.carry_over(first, order=["seq"], keys=["key"])
    rest = baseline.z_scores(df.where("seq >= 150"), "x", carry=carry, **options)
    want = {s: v for s, v in expected(data, 20).items() if s >= 150}
    check(rows(rest), want, 250)


def test_smoothing_equals_the_recurrence():
    rnd = random.Random(1)
    values = np.array([rnd.gauss(0, 1) for _ in range(1000)])
    out, m = [], 3.0
    for x in values:
        m = ALPHA * x + (1 - ALPHA) * m
        out.append(m)
    assert np.abs(smooth(values, 3.0, ALPHA) - out).max() < 1e-13


def test_packed_state_round_trips():
    state = Baseline.fresh()
    state.feed(np.arange(1.0, 30.0) / 7, 10, ALPHA)
    assert Baseline.unpack(state.pack()).pack() == state.pack()


RULE = RuleSet.from_dict({"topic": "t", "rules": [
    {"name": "jump", "type": "statistical", "column": "speed", "z_score_threshold": 3.0, "min_samples": 50}]}).rules[0]


def fired(spark, values, rule=RULE, schema="seq long, speed double"):
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return rows(baseline.statistical_violations(df, "t", rule, order=["seq"], id_columns=["seq"]))


def test_silent_during_warm_up(spark):
    assert fired(spark, [999.0] * 49) == []


def test_spike_fires_just_below_the_ceiling(spark):
    (v,) = fired(spark, [60.0] * 100 + [60000.0])
    assert v["record_id"] == "100" and 3 < v["z_score"] < 1 / math.sqrt(ALPHA)
    assert v["expected"].startswith("within 3.0 std dev of baseline (mean=")


def test_near_value_and_missing_column_are_silent(spark):
    assert fired(spark, [60.0] * 100 + [61.0]) == []
    assert fired(spark, [1.0], schema="seq long, other double") == []


def test_text_that_is_no_number_moves_nothing(spark):
    values = ["60.0"] * 60 + ["n/a"] + ["60.0"] * 40
    df = spark.createDataFrame(list(enumerate(values)), "seq long, speed string")
    learned = baseline.learn_baseline(df, "speed", order=["seq"], min_samples=50)
    assert learned.agg(F.max("n")).first()[0] == 100


def test_snapshot(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], "seq long, speed double")
    learned = baseline.learn_baseline(df, "speed", order=["seq"], min_samples=50)
    (shot,) = rows(baseline.baseline_snapshot(learned, "t", RULE, order=["seq"]))
    assert (shot["rule_name"], shot["sample_count"], shot["warmed_up"]) == ("jump", 100, True)
    n, mean, std, _ = fold([float(i % 5) for i in range(100)], 50)[-1]
    assert (shot["mean_value"], shot["std_value"]) == (round(mean, 4), round(std, 4))


def test_scoring_before_the_update_has_no_ceiling(spark):
    df = spark.createDataFrame([(i, 60.0 + i % 2) for i in range(100)] + [(100, 6000.0)], "seq long, speed double")
    scored = baseline.z_scores(df, "speed", order=["seq"], min_samples=50, score="before_update")
    assert scored.where("seq = 100").first()["z"] > 100


def test_taken_column_names_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0)], "n long, x double")
    with pytest.raises(ValueError, match="rename"):
        baseline.learn_baseline(df, "x", order=["n"], min_samples=10)
