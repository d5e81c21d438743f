import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import drift, expectations, scorers, verdicts
from plumbline.plans.suite import (
    CONFIG_TEMPLATE,
    Suite,
    SuiteFailed,
    rollup_verdicts,
    run_model_checks,
    sample_rows,
)

CATALOGUE = [
    (1, "BOOT-001", "Alpina", "Waterproof hiking boot in brown leather.", "waterproof brown leather boot", "positive", "great boot"),
    (2, "BOOT-003", "Alpina", "Not waterproof trail boot, size 42.", "waterproof trail boot, size 42", "negative", "bad sole"),
    (3, "SHOE-002", "Runly", "Runner with XR-7 foam and AirFlow-3000 mesh.", "light runner", "positive", "great shoe"),
    (4, "SANDAL-002", "Solea", "Open sandal.", "open sandal", "positive", "bad and broken"),
    (5, "COAT-001", "Alpina", None, "wool coat", "neutral", "it is a coat"),
]
SCHEMA = "id long, sku string, brand string, description string, spec string, label string, review string"
LEXICON = {"positive": ["great", "good"], "negative": ["bad", "broken"], "neutral": []}


@pytest.fixture
def products(spark):
    return spark.createDataFrame(CATALOGUE, SCHEMA)


def judged(df, check):
    found = rows(df.select("id", check.verdict(df).alias("v")).orderBy("id"))
    return {r["id"]: r["v"] for r in found}


def failing(df, check):
    return [i for i, v in judged(df, check).items() if not v["passed"]]


def test_contradictions(products):
    check = expectations.FactualConsistency("description", "spec")
    found = judged(products, check)
    assert "waterproof" in found[2]["reason"] and not found[2]["passed"]
    assert found[1]["passed"] and found[5]["passed"]


def test_invented_entities(products):
    check = expectations.NoInventedEntities("description", ["sku", "brand"])
    assert failing(products, check) == [3]
    assert judged(products, check)[3]["evidence"]["unmatched"] == "airflow-3000, xr-7"


def test_labels_by_words(products):
    check = expectations.LabelMatchesContent("label", "review", lexicon=LEXICON)
    assert failing(products, check) == [4]
    assert judged(products, check)[5]["confidence"] == 0.0


def test_label_descriptions_serve_as_lexicon(products):
    words = {"positive": "great good", "negative": "bad broken"}
    check = expectations.LabelMatchesContent("label", "review", label_descriptions=words)
    assert failing(products, check) == [4] and "positive=great good" in check.criterion()


def test_unknown_column_names_the_available_ones(products):
    with pytest.raises(ValueError, match="among.*sku"):
        Suite("s").add(expectations.FactualConsistency("nope", "spec")).run(products, index="id")


def test_missing_reference_reads_as_empty(products):
    check = expectations.FactualConsistency("description", "nope")
    assert judged(products, check)[1]["evidence"]["reference_value"] == ""


def test_evidence_is_cut(spark):
    df = spark.createDataFrame([(1, "x" * 900, "y" * 900)], "id long, a string, b string")
    evidence = judged(df, expectations.FactualConsistency("a", "b"))[1]["evidence"]
    assert (len(evidence["ai_value"]), len(evidence["reference_value"])) == (300, 300)


def rolled(spark, passed, total, threshold=0.95):
    df = spark.range(total).select(
        F.lit("e").alias("expectation"), F.lit("c").alias("column_name"), (F.col("id") < passed).alias("passed"))
    found = rows(rollup_verdicts(df, threshold))
    return found[0] if found else None


def test_pass_rate_equal_to_the_threshold_passes(spark):
    assert rolled(spark, 95, 100)["passed"] and not rolled(spark, 80, 100)["passed"]


def test_no_records_have_rate_zero(products):
    run = Suite("s").add(expectations.FactualConsistency("description", "spec")).run(products.limit(0), index="id")
    (result,) = rows(run.results)
    assert (result["total_records"], result["pass_rate"], result["passed"]) == (0, 0.0, False)


def suite():
    return (
        Suite("products")
        .add(expectations.FactualConsistency("description", "spec", threshold=0.5))
        .add(expectations.NoInventedEntities("description", ["sku", "brand"], threshold=0.99))
        .add(expectations.LabelMatchesContent("label", "review", lexicon=LEXICON, threshold=0.8))
    )


def test_one_failing_expectation_fails_the_suite(products):
    run = suite().run(products, index="id", dataset_name="catalogue")
    overall = rows(run.overall())[0]
    assert not overall["passed"] and overall["failed_expectations"] == 1 and overall["expectations"] == 3
    assert math.isclose(overall["overall_pass_rate"], 11 / 15)
    assert [r["expectation"] for r in rows(run.failed())] == ["expect_column_to_not_hallucinate_entities"]
    assert sorted((v["column_name"], v["record_index"]) for v in rows(run.verdicts)) == [
        ("description", 2), ("description", 3), ("description", 3), ("label", 4)]
    assert {r["dataset_name"] for r in rows(run.results)} == {"catalogue"}
    assert "[FAIL] expect_column_to_not_hallucinate_entities(description) pass_rate=80.0% (4/5)" in {
        r["summary"] for r in rows(run.summary())}


def test_at_most_100_failures_are_kept_in_order(spark):
    df = spark.range(1000).select("id", F.lit("a 7").alias("a"), F.lit("b").alias("b"))
    run = Suite("s").add(expectations.FactualConsistency("a", "b")).run(df, index="id")
    assert sorted(r["record_index"] for r in rows(run.verdicts)) == list(range(100))


def test_counts_of_a_suite_take_one_scan(spark, products, tmp_path):
    products.write.parquet(str(tmp_path / "p"))
    run = suite().run(spark.read.parquet(str(tmp_path / "p")), index="id")
    assert run.results._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_empty_suite_passes_with_rate_zero(products):
    overall = rows(Suite("s").run(products, index="id").overall())[0]
    assert overall["passed"] and overall["overall_pass_rate"] == 0.0


def test_sample_is_fixed_by_key_and_seed(spark):
    df = spark.range(500)
    draw = [r["id"] for r in rows(sample_rows(df, 20, "id"))]
    assert sorted(draw) == sorted(r["id"] for r in rows(sample_rows(df.repartition(7), 20, "id")))
    assert sorted(draw) != sorted(r["id"] for r in rows(sample_rows(df, 20, "id", seed=7)))
    assert sample_rows(df, 900, "id").count() == 500


def test_suite_file(products, tmp_path):
    path = tmp_path / "suite.yml"
    path.write_text(CONFIG_TEMPLATE)
    columns = {m: [e.column for e in Suite.from_yaml(path, m).expectations] for m in ("part", "documents", "embeddings")}
    assert columns == {"part": ["p_name", "p_name"], "documents": ["lang"], "embeddings": ["embedding"]}
    assert Suite.from_yaml(path, "unknown").expectations == []
    path.write_text("models: {p: {checks: [{type: factual_consistency, column: description, reference_column: spec}]}}")
    with pytest.raises(SuiteFailed):
        run_model_checks(products, path, "p", index="id")
    assert not run_model_checks(products, path, "p", index="id", fail_on_error=False).passed()


def test_unknown_type_is_left_out_with_a_warning():
    with pytest.warns(UserWarning, match="mystery"):
        suite = Suite.from_config({"models": {"m": {"checks": [{"type": "mystery", "column": "c"}]}}}, "m")
    assert suite.expectations == []


def vectors(spark, *vectors):
    return spark.createDataFrame([(list(map(float, v)),) for v in vectors], "embedding array<double>")


def test_first_drift_run_passes_and_seeds(spark):
    batch = vectors(spark, [3, 4], [0, 2])
    check = expectations.SemanticDrift("embedding")
    assert rows(check.evaluate(batch))[0]["passed"]
    (seed,) = rows(check.next_baseline(batch))
    assert seed["centroid"] == pytest.approx([0.3, 0.9])


def test_orthogonal_batch_drifts_and_still_moves_the_baseline(spark):
    size = 384
    flat = [1 / math.sqrt(size)] * size
    e0 = [1.0] + [0.0] * (size - 1)
    check = expectations.SemanticDrift("embedding", threshold=0.10, measure="dot")
    check.set_baseline(spark.createDataFrame([(flat,)], "centroid array<double>"))
    (result,) = rows(check.evaluate(vectors(spark, e0, e0)))
    assert not result["passed"] and float(result["evidence"]["drift_dot"]) == pytest.approx(1 - 1 / math.sqrt(size))
    (moved,) = rows(check.next_baseline(vectors(spark, e0)))
    assert moved["centroid"][0] == pytest.approx(0.9 / math.sqrt(size) + 0.1)
    run = Suite("s").add(check).run(vectors(spark, e0, e0).withColumn("id", F.lit(1)), index="id")
    assert [(r["passed_records"], r["failed_records"]) for r in rows(run.results)] == [(0, 2)]
    assert [v["record_index"] for v in rows(run.verdicts)] == [-1]


def test_empty_batch_is_not_passed(spark):
    check = expectations.SemanticDrift("embedding", baseline=spark.createDataFrame([([1.0, 0.0],)], "centroid array<double>"))
    assert rows(check.evaluate(vectors(spark, [1, 0]).limit(0)))[0]["passed"] is False


def test_dot_measure_drifts_against_itself_and_cosine_does_not(spark):
    batch = vectors(spark, [1, 0], [0, 1])
    own = drift.centroids(batch, "embedding").select("centroid")
    def measured(measure):
        check = expectations.SemanticDrift("embedding", baseline=own, measure=measure)
        return rows(check.evaluate(batch))[0]["passed"]
    assert measured("cosine") and not measured("dot")


@pytest.mark.parametrize("response, passed, confidence, error", [
    ('{"passed": false, "confidence": 0.2}', False, 0.2, False),
    ('```json\n{"passed": true, "confidence": 1}\n```', True, 1.0, False),
    ('{"passed": true}', True, 0.5, False),
    ('{"passed": "false"}', True, 0.0, True),
    ('{"passed": false, "confidence": "high"}', True, 0.0, True),
    ("gibberish", True, 0.0, True),
    ("[true]", True, 0.0, True),
    (None, True, 0.0, True),
])
def test_parse_verdict_fails_open(spark, response, passed, confidence, error):
    df = spark.createDataFrame([(response,)], "r string")
    (v,) = rows(df.select(verdicts.parse_verdict(F.col("r")).alias("v")).select("v.*"))
    assert (v["passed"], v["confidence"], v["judge_error"]) == (passed, confidence, error)


@pytest.mark.parametrize("response, sql, explanation", [
    ("EXPLANATION: drop nulls\n```sql\nSELECT 1\n```", "SELECT 1", "drop nulls"),
    ("```SQL\n  SELECT 1\nFROM t \n```", "SELECT 1\nFROM t", ""),
    ("so\n  select 1\nok\nWITH x", "  select 1\nWITH x", ""),
    ("nothing here", "nothing here", ""),
])
def test_parse_fix(spark, response, sql, explanation):
    df = spark.createDataFrame([(response,)], "r string")
    (f,) = rows(df.select(verdicts.parse_fix(F.col("r")).alias("f")).select("f.*"))
    assert (f["sql"], f["explanation"]) == (sql, explanation)


def test_unknown_entity_type_is_refused(products):
    with pytest.raises(ValueError, match="unknown entity type"):
        scorers.entities(F.col("description"), ["planets"])


def test_a_judge_gets_bounded_payloads_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(verdicts, "PAYLOAD_BYTES", 10_000)
    sizes = [1000] * 40 + [25_000, 10, 0]
    texts = spark.createDataFrame(list(enumerate("x" * n for n in sizes)), "i int, payload string").coalesce(1)

    def handed(payloads):
        return payloads.map(lambda p: f"{len(payloads)} {payloads.str.len().sum()} {len(p)}")

    got = [tuple(map(int, r["response"].split())) for r in verdicts.apply_scorer(texts, handed).orderBy("i").collect()]
    assert [g[2] for g in got] == sizes
    assert all(total <= 10_000 or count == 1 for count, total, _ in got) and max(g[0] for g in got) == 10


def test_rows_of_one_small_file_are_judged_on_all_cores(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(400).selectExpr("id", "concat('size ', id) AS said", "concat('size ', id % 390) AS known").coalesce(1).write.parquet(path)
    run = Suite("one").add(expectations.FactualConsistency("said", "known")).run(spark.read.parquet(path), index="id", failures_kept=None)
    assert run.verdicts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows(run.results)[0]["failed_records"] == run.verdicts.count() == 10
