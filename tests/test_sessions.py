import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from plumbline.operators import sessions
from plumbline.schemas import VIOLATION

START = datetime(2026, 1, 1)


def violation(seconds, rule="r", column="c", severity="warning", topic="t", record="1"):
    return ("violation", topic, rule, column, "v", "e", severity, None, START + timedelta(seconds=seconds), record)


def folded(spark, violations, gap=60.0, **options):
    found = sessions.incidents(spark.createDataFrame(violations, VIOLATION), gap, **options)
    return sorted(rows(found), key=lambda r: (r["first_seen"], r["column"]))


def test_two_violations_make_one_incident(spark):
    (one,) = folded(spark, [violation(0), violation(59.999999)])
    assert one["violation_count"] == 2 and one["last_seen"] - one["first_seen"] == timedelta(seconds=59.999999)


def test_a_pause_of_exactly_the_gap_splits(spark):
    assert [i["violation_count"] for i in folded(spark, [violation(0), violation(60), violation(61)])] == [1, 2]


def test_columns_and_topics_are_kept_apart(spark):
    both = folded(spark, [violation(0), violation(0, column="d"), violation(0, topic="u")])
    assert len(both) == 3


def test_worst_severity_wins_and_unknown_never_does(spark):
    many = [violation(0, severity="info"), violation(1, severity="critical"), violation(2, severity="dire")]
    assert folded(spark, many)[0]["severity"] == "critical"
    assert folded(spark, [violation(0, severity="dire")])[0]["severity"] == "info"


def test_rules_in_first_seen_order_and_five_samples(spark):
    many = [violation(i, rule="zab"[i % 3], record=str(i)) for i in range(9)]
    (one,) = folded(spark, many)
    assert one["rule_names"] == ["z", "a", "b"]
    assert [v["record_id"] for v in one["sample_violations"]] == ["0", "1", "2", "3", "4"]


def test_missing_topic_and_column_count_as_empty(spark):
    (one,) = folded(spark, [violation(0, topic=None, column=None)])
    assert (one["topic"], one["column"]) == ("", "")


@pytest.mark.parametrize("rows_per_task", [100_000, 20])
def test_equals_a_sequential_pass(spark, rows_per_task):
    """One column holds most violations; the small limit takes the block plan."""
    rnd = random.Random(4)
    many = [
        violation(round(rnd.uniform(0, 4000), 3), column="hot" if i % 3 else rnd.choice("ab"), record=str(i))
        for i in range(400)
    ]
    open_, want = {}, []
    for v in sorted(many, key=lambda v: v[8]):
        last = open_.get(v[3])
        if last is None or v[8] - last[1] >= timedelta(seconds=15):
            open_[v[3]] = last = [v[8], v[8], 0, v[3]]
            want.append(last)
        last[1], last[2] = v[8], last[2] + 1
    got = folded(spark, many, 15.0, samples=0, rows_per_task=rows_per_task)
    assert [(i["first_seen"], i["last_seen"], i["violation_count"], i["column"]) for i in got] == sorted(
        map(tuple, want), key=lambda w: (w[0], w[3])
    )


def test_ids_are_stable_and_numbers_follow_the_end(spark):
    many = [violation(0, column="long"), violation(50, column="long"), violation(10, column="short")]
    again = [i["incident_id"] for i in folded(spark, many)]
    assert again == [i["incident_id"] for i in folded(spark, many)] and len(set(again)) == 2
    found = sessions.incidents(spark.createDataFrame(many, VIOLATION), samples=0)
    ids = {r["column"]: r["incident_id"] for r in rows(sessions.numbered(found))}
    assert ids == {"short": "stream-000001", "long": "stream-000002"}


def test_topics_at_once_become_one_incident(spark):
    many = [violation(0, topic="a"), violation(30, topic="b"), violation(500, topic="a")]
    found = sessions.incidents(spark.createDataFrame(many, VIOLATION))
    (one,) = rows(sessions.cross_topic_incidents(found, 60.0))
    assert one["topics"] == ["a", "b"] and one["incident_count"] == 2
