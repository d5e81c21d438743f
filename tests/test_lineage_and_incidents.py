import json
import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import cycles, incidents, lineage, profile
from plumbline.sources import dbt, tables
from plumbline.sources.store import Store


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def walk(spark, pairs, root, **options):
    found = lineage.upstream(edges(spark, *pairs), spark.createDataFrame([(root,)], "root string"), **options)
    return [r["table"] for r in rows(found.orderBy(lineage.walk_order(F.col("depth"), F.col("table"))))]


CHAIN = [("raw.t_raw", "staging.stg_t"), ("staging.stg_t", "t")]


def test_furthest_ancestors_come_first(spark):
    assert walk(spark, CHAIN, "t") == ["raw.t_raw", "staging.stg_t"]
    assert walk(spark, CHAIN, "raw.t_raw") == []


@pytest.mark.parametrize("depth", [3, None])
def test_an_ancestor_precedes_everything_built_from_it(spark, depth):
    """a feeds t directly and through b and c: the long way counts."""
    assert walk(spark, [("a", "t"), ("a", "b"), ("b", "c"), ("c", "t")], "t", max_depth=depth) == ["a", "b", "c"]


def test_all_ancestors_are_found_unless_a_depth_is_given(spark):
    long = [(str(i), str(i + 1)) for i in range(6)]
    assert walk(spark, long, "6") == [str(i) for i in range(6)]
    assert walk(spark, long, "6", max_depth=3) == ["3", "4", "5"]


def depths(spark, pairs, root):
    found = lineage.upstream(edges(spark, *pairs), spark.createDataFrame([(root,)], "root string"))
    return {r["table"]: r["depth"] for r in rows(found)}


def test_a_cycle_is_one_place(spark):
    """a and b feed each other, one hop from t; c, d, e lie behind each other and further away."""
    pairs = [("a", "b"), ("b", "a"), ("a", "t"), ("c", "b"), ("d", "c"), ("e", "d"), ("d", "t")]
    assert depths(spark, pairs, "t") == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 4}


def test_a_cycle_through_the_root(spark):
    assert depths(spark, [("t", "a"), ("a", "t"), ("b", "a")], "t") == {"a": 1, "b": 2}


def test_ways_of_a_chain_are_no_more_than_its_edges(spark):
    chain = spark.range(100).selectExpr("concat('t', id) AS _src", "concat('t', id + 1) AS _dst")
    ways, whole = lineage._strides(chain)
    assert [w.count() for w in ways] == [100, 99, 97, 93, 85] and not whole
    ways, whole = lineage._strides(chain.limit(3))
    assert [w.count() for w in ways] == [3, 2] and whole


def test_depths_equal_longest_ways_by_hand(spark):
    draw = random.Random(5)
    pairs = {(f"n{b:02}", f"n{a:02}") for a, b in (sorted(draw.sample(range(40), 2)) for _ in range(70))}
    pairs |= {(f"c{i + 1:02}", f"c{i:02}") for i in range(69)} | {("n00", "c03"), ("c40", "c20"), ("c69", "c07")}
    above = {}
    for src, dst in pairs:
        above.setdefault(dst, set()).add(src)
    want = {}
    for root in ("c00", "c05", "n01", "n30", "nowhere"):
        front, depth = {root}, 0
        while front:
            front, depth = set().union(*(above.get(t, set()) for t in front)), depth + 1
            want |= {(root, t): depth for t in front}
    roots = spark.createDataFrame([(r,) for r in ("c00", "c05", "n01", "n30", "nowhere")], "root string")
    got = {(r["root"], r["table"]): r["depth"] for r in rows(lineage.upstream(edges(spark, *pairs), roots))}
    assert got == want and max(want.values()) > 62


def frames(spark, raw_nulls, staged_nulls):
    def made(nulls):
        return spark.range(100).select(F.when(F.col("id") >= nulls, F.col("id")).alias("amount"))
    return {"raw.t_raw": made(raw_nulls), "staging.stg_t": made(staged_nulls), "t": made(50)}


@pytest.mark.parametrize("raw, staged, cause", [(9, 9, "raw.t_raw"), (5, 9, "staging.stg_t"), (5, 5, "t")])
def test_root_cause_is_the_furthest_suspect(spark, raw, staged, cause):
    (found,) = rows(lineage.trace_root_cause(edges(spark, *CHAIN), frames(spark, raw, staged), "t", "amount"))
    assert (found["root_cause_table"], found["root_cause_column"]) == (cause, "amount")


def test_without_lineage_the_failing_table_is_the_cause(spark):
    (found,) = rows(lineage.trace_root_cause(edges(spark, ("x", "y")), frames(spark, 9, 9), "t", "amount"))
    assert found["root_cause_table"] == "t"


def test_renamed_columns_are_followed(spark):
    known = frames(spark, 9, 9)
    known["raw.t_raw"] = known["raw.t_raw"].withColumnRenamed("amount", "amt")
    args = (edges(spark, *CHAIN), known, "t", "amount")
    assert rows(lineage.trace_root_cause(*args))[0]["root_cause_table"] == "staging.stg_t"
    found = lineage.trace_root_cause(*args, renamed={"raw.t_raw": "amt"})
    assert rows(found)[0]["root_cause_table"] == "raw.t_raw"


def test_lineage_document(spark, tmp_path):
    path = tmp_path / "lineage.json"
    path.write_text(json.dumps({
        "nodes": [{"fullyQualifiedName": "db.raw.a", "type": "Table"}, {"fullyQualifiedName": "db.b", "name": "B"}],
        "upstreamEdges": [{"fromEntity": {"fullyQualifiedName": "db.raw.a"}, "toEntity": {"fullyQualifiedName": "db.b"}}],
    }, indent=1))
    nodes, read = tables.scan_lineage(spark, str(path))
    assert [(n["name"], n["node_type"]) for n in rows(nodes.orderBy("fqn"))] == [("B", "table"), ("a", "table")]
    assert rows(read) == [{"src": "db.raw.a", "dst": "db.b"}]


def project(tmp_path):
    target = tmp_path / "target" / "compiled"
    target.mkdir(parents=True)
    (tmp_path / "target" / "run_results.json").write_text(json.dumps({"results": [
        {"unique_id": "test.a", "status": "fail", "failures": 3, "message": "Got 3 results"},
        {"unique_id": "test.b", "status": "pass"},
        {"unique_id": "test.c", "status": "error"},
    ]}, indent=1))
    (tmp_path / "target" / "manifest.json").write_text(json.dumps({"nodes": {
        "test.a": {"name": "accepted", "test_metadata": {"name": "accepted_values", "kwargs": {"values": ["x", "y"]}},
                   "attached_node": "model.m", "column_name": "c", "compiled_code": "", "compiled_sql": "select 1"},
        "model.m": {"name": "m", "resource_type": "model", "compiled_code": "select 2",
                    "columns": {"c": {"name": "c", "description": "a column", "data_type": "text"}}},
    }}, indent=1))
    (target / "other.sql").write_text("select 3\nfrom t")
    return str(tmp_path)


def test_failing_tests(spark, tmp_path):
    found = {r["unique_id"]: r for r in rows(dbt.scan_failing_tests(spark, project(tmp_path)))}
    assert found.keys() == {"test.a", "test.c"}
    a, c = found["test.a"], found["test.c"]
    assert (a["node_name"], a["test_type"], a["model"], a["column_name"], a["failures"], a["compiled_code"]) == (
        "accepted", "accepted_values", "model.m", "c", 3, "select 1")
    assert a["accepted_values"] == ["x", "y"]
    assert (c["node_name"], c["test_type"], c["model"], c["failures"], c["message"]) == ("test.c", "generic", "", 0, "")


def test_project_that_never_ran(spark, tmp_path):
    assert rows(dbt.scan_failing_tests(spark, str(tmp_path))) == []


def test_model_sql_and_columns(spark, tmp_path):
    folder = project(tmp_path)
    assert [dbt.model_sql(spark, folder, m).first()["sql"] for m in ("m", "other", "none")] == [
        "select 2", "select 3\nfrom t", ""]
    nodes = dbt.scan_manifest(spark, f"{folder}/{dbt.MANIFEST}")
    assert rows(dbt.model_columns(nodes, "m")) == [{"column_name": "c", "description": "a column", "data_type": "text"}]


LOG = "incident_id string, seq long, table_name string, anomaly_type string, root_cause string, " \
      "root_cause_table string, status string, proposed_fix string, sandbox_result string, created_at timestamp"


def event(seq, status, table="t", cause="c"):
    return ("i", seq, table, "null_spike", cause, "raw", status, "", "{}", datetime(2026, 1, 1, 0, seq))


def test_upsert_keeps_first_table_and_time_and_last_rest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    log = spark.createDataFrame([event(1, "observing"), event(3, "pending_approval", "u", "d")], LOG)
    store.save_incident_events(log.where("seq = 3"))
    store.save_incident_events(log.where("seq = 1"))
    (state,) = rows(store.incident_states())
    assert (state["table_name"], state["created_at"].minute, state["status"], state["root_cause"]) == (
        "t", 1, "pending_approval", "d")
    yes = incidents.decide(store.incident_states(), "i", approve=True, seq=F.lit(4),
                           at=F.lit("2026-01-02").cast("timestamp"))
    store.save_incident_events(yes)
    (state,) = rows(store.incident_states())
    assert (state["status"], state["resolved_at"]) == ("resolved", datetime(2026, 1, 2))


def test_tasks_that_fold_a_log_sort_a_bounded_number_of_events(spark):
    log = spark.range(1_000).selectExpr(
        "if(id < 600, 'hot', concat('i', id div 4)) AS incident_id", "id AS seq", "concat('t', id) AS table_name",
        "'null_spike' AS anomaly_type", "'c' AS root_cause", "'raw' AS root_cause_table",
        "if(id % 2 = 0, 'observing', 'resolved') AS status", "concat('f', id) AS proposed_fix", "'{}' AS sandbox_result",
        "timestamp_seconds(id) AS created_at").repartition(1)
    state = incidents.current_state(log, rows_per_task=100)
    plan = state._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "rangepartitioning(incident_id" in line]
    assert dealt and ", 10)" in dealt[0]
    got = {r["incident_id"]: r for r in state.collect()}
    assert len(got) == 101
    assert (got["hot"]["table_name"], got["hot"]["proposed_fix"], got["hot"]["events"]) == ("t0", "f599", 600)
    assert (got["i200"]["table_name"], got["i200"]["proposed_fix"], got["i200"]["events"]) == ("t800", "f803", 4)


def test_illegal_transitions(spark):
    steps = ["observing", "tracing", "diagnosing", "fixing", "sandbox", "fixing", "sandbox", "pending_approval",
             "resolved", "fixing"]
    log = spark.createDataFrame([event(i, s) for i, s in enumerate(steps)], LOG)
    assert [(r["previous_status"], r["status"]) for r in rows(incidents.illegal_transitions(log))] == [
        ("resolved", "fixing")]


def test_profile_of_an_empty_table_has_rate_zero(spark):
    df = spark.createDataFrame([], "a int, b string")
    found = rows(profile.profile_columns(df, "t"))
    assert [(r["row_count"], r["null_count"], r["null_rate"]) for r in found] == [(0, 0, 0.0)] * 2
    assert profile.null_rate(df, "a").first()[0] == 0.0


def test_profile_takes_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id as b").write.parquet(str(tmp_path / "t"))
    plan = profile.profile_columns(spark.read.parquet(str(tmp_path / "t")), "t")
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_schema_diff(spark):
    before = spark.createDataFrame([], "a int, b string, c long")
    after = spark.createDataFrame([], "a long, b string, d long")
    found = {r["name"]: r["change"] for r in rows(profile.schema_diff(
        profile.schema_frame(before), profile.schema_frame(after)))}
    assert found == {"a": "retyped", "c": "removed", "d": "added"}


def test_bins_keep_nulls_apart(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (3.0,), (99.0,)], "x double")
    assert [r[0] for r in df.select(profile.equal_width_bin(F.col("x"), 0.0, 10.0, 5)).collect()] == [None, 0, 1, 4]


def components_by_hand(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
        reach.setdefault(b, set())
    changed = True
    while changed:
        changed = False
        for v in reach:
            more = set().union(*(reach[w] for w in reach[v])) - reach[v] if reach[v] else set()
            if more:
                reach[v] |= more
                changed = True
    return {frozenset(w for w in reach if v in reach[w] and w in reach[v]) for v in reach if any(v in reach[w] and w in reach[v] for w in reach if w != v)}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_mutual_reach(spark, seed):
    draw = random.Random(seed)
    n = 40
    edges = [(f"t{draw.randrange(n)}", f"t{draw.randrange(n)}") for _ in range((20, 45, 60, 90)[seed])]
    edges += [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("r3", "t1"), ("tail1", "tail2"), ("tail2", "r0"), ("p", "q"), ("q", "p")]
    got = {}
    for r in cycles.components(spark.createDataFrame(edges, "src string, dst string")).collect():
        got.setdefault(r["place"], set()).add(r["table"])
    assert {frozenset(v) for v in got.values()} == components_by_hand([e for e in edges if e[0] != e[1]])
    assert all(place == min(tables) for place, tables in got.items())


def test_a_ring_of_many_tables_is_one_component(spark):
    n = 2_000
    ring = spark.range(n).selectExpr("concat('t', id) AS src", f"concat('t', (id + 1) % {n}) AS dst")
    got = cycles.components(ring)
    assert got.count() == n and got.select("place").distinct().count() == 1
