import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catalog import streams
from plumbline.operators.sessions import incidents
from plumbline.plans.check import compile_rules
from plumbline.rules import RuleSet
from plumbline.sources.store import Store
from plumbline.streaming import bursts, checks, lookback, sessions, source
from plumbline.streaming.state import state_settings

RULES = RuleSet.from_dict({"topic": "gps", "rules": [
    {"name": "speed_range", "type": "range", "column": "speed", "max": 80.0},
    {"name": "device", "type": "not_null", "column": "device", "severity": "critical"},
    {"name": "gaps", "type": "null_rate", "column": "speed", "threshold": 0.3, "window_size": 20},
    {"name": "jump", "type": "statistical", "column": "speed", "z_score_threshold": 2.5, "min_samples": 30},
]})
SCHEMA = "seq long, id string, device string, speed double, at timestamp"
OPTIONS = {"order": ["seq"], "time_column": "at"}


def feed(spark, n=400):
    rnd = random.Random(9)
    return spark.createDataFrame([
        (i, str(i), None if i % 17 == 0 else f"d{0 if i % 3 else i % 5}",
         None if rnd.random() < 0.25 else rnd.gauss(60, 12), datetime(2026, 1, 1) + timedelta(seconds=i * 7))
        for i in range(n)
    ], SCHEMA)


def parts(df, folder, bounds):
    """Files that appear one after the other, cut at the bounds."""
    for low, high in zip([0, *bounds], [*bounds, 10**9]):
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(folder)


def key(found):
    return sorted((v["rule_name"], v["record_id"], v["value"] or "", v["expected"], v["z_score"]) for v in rows(found))


def run(spark, folder, store, checkpoint, **options):
    stream = source.file_source(spark, folder, SCHEMA, files_per_batch=1)
    checks.run_checks(stream, RULES, store, checkpoint, state_parts=2, **OPTIONS, **options).awaitTermination()


def test_stream_equals_batch_with_a_restart_in_between(spark, tmp_path):
    df, folder = feed(spark), str(tmp_path / "in")
    store, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    parts(df.where("seq < 200"), folder, [90])
    run(spark, folder, store, checkpoint)
    parts(df.where("seq >= 200"), folder, [300])
    run(spark, folder, store, checkpoint)
    batch = compile_rules(RULES, **OPTIONS).violations(df)
    assert key(store.violations()) == key(batch.withColumn("value", F.coalesce("value", F.lit(""))))
    (shot,) = rows(store.baselines())
    assert shot["sample_count"] == df.where("speed is not null").count() and shot["warmed_up"]


def test_keyed_stream_equals_keyed_batch(spark, tmp_path):
    df, folder = feed(spark), str(tmp_path / "in")
    parts(df, folder, [70, 100, 180, 300])
    store = Store(spark, str(tmp_path / "store"))
    run(spark, folder, store, str(tmp_path / "checkpoint"), keys=["device"])
    batch = compile_rules(RULES, keys=["device"], **OPTIONS).violations(df)
    assert key(store.violations()) == key(batch.withColumn("value", F.coalesce("value", F.lit(""))))


def test_state_is_kept_by_group_and_not_by_series(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookback, "SERIES_GROUPS", 3)
    df = feed(spark).withColumn("device", F.when(F.col("seq") % 31 != 0, F.concat(F.lit("d"), (F.col("seq") % 31).cast("string"))))
    folder, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    parts(df, folder, [150, 260])
    rules = RuleSet.from_dict({"topic": "gps", "rules": [
        {"name": "gaps", "type": "null_rate", "column": "speed", "threshold": 0.2, "window_size": 11},
        {"name": "jump", "type": "statistical", "column": "speed", "z_score_threshold": 1.2, "min_samples": 10}]})
    stream = source.file_source(spark, folder, SCHEMA, files_per_batch=1)
    query = checks.run_checks(stream, rules, store, str(tmp_path / "checkpoint"), keys=["device"], state_parts=2, **OPTIONS)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    batch = compile_rules(rules, keys=["device"], **OPTIONS).violations(df)
    found = key(store.violations())
    assert found == key(batch.withColumn("value", F.coalesce("value", F.lit("")))) and {f[0] for f in found} == {"gaps", "jump"}


class Kept:
    """The state of one group, as the function of a stateful query sees it."""

    hasTimedOut, exists, now = False, False, 0

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, values):
        self.get, self.exists = values, True

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_a_series_quiet_for_its_time_is_forgotten_alone():
    rule, state = RULES.of("null_rate")[0], Kept()
    check = lookback.SeriesRules([rule], ["order0"], snapshots=False, ttl_ms=1000)

    def arrive(now, *series):
        state.now = now
        rows_ = pd.DataFrame({"series": list(series), "order0": now, "missing0": True, "record": "r", "at_us": 0})
        list(check((0,), iter([rows_]), state))
        return dict(zip(state.get[0], state.get[2]))

    assert arrive(0, "a", "b", "a") == {"a": 2, "b": 1}
    assert arrive(900, "b") == {"a": 2, "b": 2}
    assert arrive(1500, "c") == {"b": 2, "c": 1} and state.timeout == 1000
    assert arrive(1600, "a") == {"a": 1, "b": 2, "c": 1}


def test_a_batch_that_fails_runs_again_on_the_state_before_it(spark, tmp_path):
    df, folder = feed(spark), str(tmp_path / "in")
    parts(df, folder, [90, 200, 300])
    store, checkpoint, tried = Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint"), []

    def breaks_once(messages, batch_id):
        tried.append(batch_id)
        if tried.count(1) == 1 and batch_id == 1:
            raise RuntimeError("sink down")

    with pytest.raises(StreamingQueryException):
        run(spark, folder, store, checkpoint, keys=["device"], messages=breaks_once)
    run(spark, folder, store, checkpoint, keys=["device"], messages=breaks_once)
    assert tried.count(1) == 2
    batch = compile_rules(RULES, keys=["device"], **OPTIONS).violations(df)
    assert key(store.violations()) == key(batch.withColumn("value", F.coalesce("value", F.lit(""))))


def test_messages_are_published_per_record(spark, tmp_path):
    folder, sent = str(tmp_path / "in"), []
    parts(feed(spark, 60), folder, [])
    store = Store(spark, str(tmp_path / "store"))
    run(spark, folder, store, str(tmp_path / "c"), messages=lambda m, _: sent.extend(rows(m)))
    assert len({m["key"] for m in sent}) == len(sent)
    assert sum(m["value"].count('"type":"violation"') for m in sent) == store.violations().count()


def test_incidents_of_a_stream_and_its_open_tail_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts(feed(spark), folder, [100, 250])
    stream = source.file_source(spark, folder, SCHEMA, files_per_batch=1)
    found = checks.stream_violations(stream, RULES, time_column="at")
    closed_stream = sessions.stream_incidents(found, [r.name for r in RULES.rules], gap_seconds=60)
    out = str(tmp_path / "out")
    query = closed_stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.schema(closed_stream.schema).parquet(out)
    whole = compile_rules(RULES, **OPTIONS).row_violations(feed(spark))
    tail = sessions.flush_open(whole, closed, gap_seconds=60)
    want = incidents(whole, 60, samples=0).drop("sample_violations")
    assert 0 < tail.count() <= 2

    def listed(df):
        return sorted(map(repr, rows(df.select(*want.columns))))

    assert listed(closed.unionByName(tail)) == listed(want)


def run_bursts(spark, stream, ends, out, checkpoint):
    bursts_out = bursts.stream_bursts(stream, ends=ends, gap_seconds=60)
    with state_settings(spark, 2):
        query = bursts_out.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return bursts.late_counts(query.recentProgress)


def test_late_rows_are_routed_counted_and_kept_and_an_end_closes_all(spark, tmp_path):
    folder, out, checkpoint, control = (str(tmp_path / n) for n in ("in", "out", "c", "ends"))
    df = feed(spark)
    # Rows 40 to 54 arrive with those from 100 on, rows 150 to 169 with those from 250 on.
    arrival = F.expr("CASE WHEN seq BETWEEN 40 AND 54 THEN 1 WHEN seq BETWEEN 150 AND 169 THEN 2 WHEN seq < 100 THEN 0 WHEN seq < 250 THEN 1 ELSE 2 END")
    arrived = df.withColumn("part", arrival)
    for part in range(3):
        arrived.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    stream = source.file_source(spark, folder, SCHEMA, files_per_batch=1)
    found = checks.stream_violations(stream, RULES, time_column="at")
    ends = bursts.markers(spark, control)
    counts = run_bursts(spark, found, ends, out, checkpoint)
    bursts.end_input(spark, control, "2026-02-01")
    counts |= run_bursts(spark, found, ends, out, checkpoint)

    whole = compile_rules(RULES, **OPTIONS).row_violations(arrived)
    table = whole.join(arrived.select(F.col("id").alias("record_id"), "part"), "record_id").toPandas()
    behind, late = 0, []
    for part in range(3):
        mine = table[table["part"] == part]
        late += mine[mine["timestamp"].astype("int64") < behind]["record_id"].tolist()
        behind = max(behind, mine["timestamp"].astype("int64").max())
    result = spark.read.schema(bursts._OUT).parquet(out)
    assert sorted(r["record_id"] for r in bursts.late_rows(result).collect()) == sorted(late) and len(late) > 3
    assert sum(counts.values()) == len(late)

    on_time = whole.where(~F.col("record_id").isin(late))
    want = incidents(on_time, 60, samples=0).drop("sample_violations")
    got = bursts.closed(result)
    assert sorted(map(repr, rows(got.select(*want.columns)))) == sorted(map(repr, rows(want)))
    assert got.select("incident_id").distinct().count() == got.count()


def test_micro_batches_stay_bounded_and_in_order_whatever_gaps_ids_have(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "ROWS_PER_BATCH", 100)
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 50)
    ids = spark.range(1000).select((F.col("id") + F.when(F.col("id") >= 300, 10**6).otherwise(0)).alias("event_id"))
    folder = tmp_path / "in"
    files = streams.arriving_bounded(ids, str(folder), ["event_id"])
    came = [pd.read_parquet(f)["event_id"].tolist() for f in sorted(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)]
    batches = [sum(came[i:i + files], []) for i in range(0, len(came), files)]
    assert files == 2 and len(batches) == 10 and max(map(len, batches)) <= 110
    assert all(max(a) < min(b) for a, b in zip(batches, batches[1:])) and sum(map(len, batches)) == 1000


def test_records_are_parsed_once_whatever_the_rules_name(spark):
    texts = [
        ("{}", True), (' \t\n{"speed": 90, "device": null}', True), ('{"speed": [1, {"a": "}"}], "id": "x"} ', True), ('{"speed": "fast"', False),
        ("", False), (None, False), ("null", False), ('"{}"', False), ("17", False), ('[{"speed": 1}]', False), ("{speed: 1}", False), ("{}{", True),
        ('\x0b{"speed": 1}', False), ("{", False), ('{"id": "7", "speed": 20, "device": ""}', True)]
    raw = spark.createDataFrame([(text, i) for i, (text, _) in enumerate(texts)], "raw string, n int")
    schema = spark.createDataFrame([], "id string, device string, speed double").schema
    records, malformed = source.decode(raw, schema)
    assert [r["n"] for r in records.orderBy("n").collect()] == [i for i, (_, ok) in enumerate(texts) if ok]
    assert [r["n"] for r in malformed.orderBy("n").collect()] == [i for i, (_, ok) in enumerate(texts) if not ok]
    kind = F.schema_of_variant(F.try_parse_json("raw"))
    assert raw.where(~F.coalesce(kind.startswith("OBJECT<"), F.lit(False)).eqNullSafe(source.is_record(F.col("raw")))).isEmpty()
    first = {r["n"]: (r["id"], r["device"], r["speed"]) for r in records.collect()}
    assert first[0] == (None, None, None) and first[1] == (None, None, "90") and first[2][2] == '[1,{"a":"}"}]' and first[14] == ("7", "", "20")
    found = checks.stream_violations(records, RULES)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted((r["rule_name"], r["record_id"]) for r in found.collect()) == [
        ("device", ""), ("device", ""), ("device", ""), ("device", "7"), ("device", "x"), ("speed_range", ""), ("speed_range", "x")]


def test_messages_of_a_batch_are_read_from_its_folder_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    found = compile_rules(RULES, **OPTIONS).row_violations(feed(spark, 60))
    for batch in range(3):
        store.save_violations(found, batch_id=batch)
    store.save_violations(found.limit(0), batch_id=3)
    one = store.read_batch("violations", 1)
    assert all("/batch_id=1/" in path for path in one.inputFiles())
    whole = store.read("violations").where("batch_id = 1").drop("batch_id")
    assert one.columns == whole.columns and one.count() == found.count()
    assert one.exceptAll(whole).isEmpty() and whole.exceptAll(one).isEmpty()
    assert checks.as_messages(store.read_batch("violations", 3)).isEmpty()
