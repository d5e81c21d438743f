import random
from collections import deque

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.rules import RuleSet


def series(n, seed, hot=3):
    """(seq, key, x): a third of all rows under one key, some keys null, some values null."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if i % hot == 0 else rnd.choice([None, *range(1, 9)])
        out.append((i, key, None if rnd.random() < 0.3 else rnd.gauss(50, 10)))
    rnd.shuffle(out)
    return out


def rolling(flags, size):
    window, out = deque(maxlen=size), []
    for flag in flags:
        window.append(flag)
        out.append((sum(window) / len(window), len(window)))
    return out


def expected(data, size, keyed):
    groups = {}
    for seq, key, x in sorted(data, key=lambda r: r[0]):
        groups.setdefault(key if keyed else None, []).append((seq, x is None))
    return {
        seq: pair
        for group in groups.values()
        for (seq, _), pair in zip(group, rolling([f for _, f in group], size))
    }


@pytest.mark.parametrize("rows_per_task", [100_000, 40])
@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("size", [10, 75])
def test_rolling_rate_equals_a_sliding_window(spark, rows_per_task, keyed, size):
    data = series(600, seed=size)
    df = spark.createDataFrame(data, "seq long, key int, x double")
    rated = ordered.rolling_rate(
        df, F.col("x").isNull(), size, order=["seq"], keys=["key"] if keyed else [], rows_per_task=rows_per_task
    )
    got = {r["seq"]: (r["rate"], r["rows_in_window"]) for r in rows(rated)}
    want = expected(data, size, keyed)
    assert got.keys() == want.keys()
    assert all(got[s][1] == want[s][1] and abs(got[s][0] - want[s][0]) < 1e-12 for s in want)


def found(spark, values, threshold, size):
    rules = RuleSet.from_dict({"topic": "t", "rules": [
        {"name": "gaps", "type": "null_rate", "column": "x", "threshold": threshold, "window_size": size}]})
    df = spark.createDataFrame(list(enumerate(values)), "seq long, x double")
    return rows(ordered.null_rate_violations(df, "t", rules.rules[0], order=["seq"], id_columns=["seq"]))


def test_null_rate_fires_on_every_record_over_the_threshold(spark):
    fired = found(spark, [60.0] * 10 + [None] * 10, 0.2, 20)
    assert [v["record_id"] for v in fired] == [str(i) for i in range(12, 20)]
    assert fired[0]["value"] == "0.2308" and fired[0]["expected"] == "null_rate < 0.2"


def test_null_rate_is_silent_below_and_before_ten_records(spark):
    assert found(spark, [1.0] * 18 + [None] * 2, 0.5, 20) == []
    assert [v["record_id"] for v in found(spark, [None] * 11, 0.5, 10)] == ["9", "10"]


@pytest.mark.parametrize("rows_per_task", [100_000, 30])
def test_previous_value(spark, rows_per_task):
    data = series(300, seed=5)
    df = spark.createDataFrame(data, "seq long, key int, x double")
    got = ordered.previous_value(df, "seq", "before", keys=["key"], order=["seq"], rows_per_task=rows_per_task)
    last, want = {}, {}
    for seq, key, _ in sorted(data, key=lambda r: r[0]):
        want[seq] = last.get(key)
        last[key] = seq
    assert {r["seq"]: r["before"] for r in rows(got)} == want


def test_blocks_split_a_hot_key(spark):
    df = spark.createDataFrame([(i, 0) for i in range(1000)], "seq long, key int")
    sizes = [r["count"] for r in rows(ordered.order_blocks(df, ["key"], ["seq"], 4).groupBy(ordered.BLOCK).count())]
    assert len(sizes) == 4 and max(sizes) < 500
