import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import assertions as A
from plumbline.operators import sandbox

SCHEMA = "id int, amount double"


@pytest.fixture
def clean(spark):
    return spark.createDataFrame([(1, 10.0), (2, 20.0)], SCHEMA)


@pytest.fixture
def damaged(spark):
    return spark.createDataFrame([(1, 10.0), (2, None), (2, None), (3, None), (None, None)], SCHEMA)


def details(df, *checks):
    return {d["name"]: d for d in rows(A.run_assertions(df, checks))}


def test_pass_and_fail(clean, damaged):
    assert details(clean, A.not_null("amount"))["not_null_amount"]["passed"]
    found = details(damaged, A.not_null("amount"))["not_null_amount"]
    assert (found["passed"], found["failures"], len(found["sample_failures"])) == (False, 4, 3)


def test_not_null_lets_empty_text_pass(spark):
    assert details(spark.createDataFrame([("",)], "c string"), A.not_null("c"))["not_null_c"]["passed"]


def test_unique_counts_groups_and_nulls_by_choice(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "c int")
    assert details(df, A.unique("c"))["unique_c"]["failures"] == 2
    assert details(df, A.unique("c", nulls="ignore"))["unique_c"]["failures"] == 1


def test_accepted_values_compare_as_text(damaged):
    found = details(damaged, A.accepted_values("id", ["1", "2", "it's"]))["accepted_values_id"]
    assert found["failures"] == 1


def test_relationships_find_orphans(clean, damaged):
    found = details(damaged, A.relationships("id", clean, "id"))["relationships_id"]
    assert found["failures"] == 1


def test_missing_column_fails_with_minus_one(clean):
    found = details(clean, A.not_null("nope"), A.unique("nope"), A.not_null("id"))
    assert [found[n]["failures"] for n in ("not_null_nope", "unique_nope", "not_null_id")] == [-1, -1, 0]
    assert "nope" in found["unique_nope"]["error"]


def test_an_assertion_that_fails_while_it_runs_fails_alone(clean):
    found = details(clean, A.RowAssertion(name="cast", broken=F.expr("CAST(concat('x', id) AS INT) > 0"), description="breaks"), A.not_null("id"))
    assert [found[n]["failures"] for n in ("cast", "not_null_id")] == [-1, 0]
    assert found["cast"]["error"]


def test_no_assertions_pass(clean):
    (summary,) = rows(A.assertion_rollup(A.run_assertions(clean, [])))
    assert (summary["passed"], summary["tests_run"]) == (True, 0)


def test_derived_assertions():
    derived = A.derive_assertions([
        {"test_type": "not_null", "column_name": "a"}, {"test_type": "unique", "column_name": "a"},
        {"test_type": "accepted_values", "column_name": "a"}, {"test_type": "relationships"},
        {"test_type": "not_null", "column_name": ""},
    ])
    assert [a.name for a in derived] == ["not_null_a", "unique_a", "row_count_positive"]
    assert [a.name for a in A.derive_assertions([])] == ["row_count_positive"]


TESTS = [{"test_type": "not_null", "column_name": "amount"}]


@pytest.fixture
def box(spark, damaged):
    with sandbox.Sandbox(spark) as box:
        box.load_table("orders", damaged)
        yield box


def outcome(box, sql):
    result = sandbox.validate_fix(box, sql, TESTS)
    return rows(result.summary)[0], rows(result.details)


def test_good_and_bad_fix(box):
    good, _ = outcome(box, "SELECT * FROM orders WHERE amount IS NOT NULL;")
    bad, _ = outcome(box, "SELECT id, NULL AS amount FROM orders")
    assert good["passed"] and not bad["passed"]
    assert outcome(box, "SELECT * FROM VALUES (1, 10.0), (2, 20.0) AS t(id, amount)")[0]["passed"]


def test_a_fix_that_fails_while_it_runs_did_not_run(box):
    summary, (only,) = outcome(box, "SELECT id, CAST(concat('x', id) AS INT) AS amount FROM orders")
    assert not summary["passed"]
    assert (only["name"], only["failures"]) == (sandbox.EXECUTION, A.COULD_NOT_RUN)


@pytest.mark.parametrize("sql", [
    "SELECT nope FROM orders",
    "SELEC 1",
    "DROP TABLE orders",
    "INSERT INTO orders VALUES (1, 2.0)",
    "WITH a AS (SELECT 1 AS x) INSERT INTO orders SELECT x, 1.0 FROM a",
    "SELECT 1; DROP VIEW orders",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM orders",
    "SELECT reflect('java.lang.System', 'getenv') FROM orders",
    "SELECT java_method('java.lang.System', 'getenv') FROM orders",
    "SELECT * FROM elsewhere elsewhere",
    "SELECT * FROM global_temp.anything",
])
def test_anything_but_a_query_over_given_tables_is_refused(box, sql):
    summary, (detail,) = outcome(box, sql)
    assert not summary["passed"] and (detail["name"], detail["failures"]) == ("sql_execution", -1)
    assert box.session.table("orders").count() == 5


def test_cte_must_not_lend_its_name_to_a_catalog_table(spark, box):
    spark.sql("CREATE TABLE IF NOT EXISTS secret_prices AS SELECT 1 AS id, 2.0D AS amount")
    try:
        sql = "WITH secret_prices AS (SELECT * FROM secret_prices) SELECT * FROM secret_prices"
        assert not outcome(box, sql)[0]["passed"]
    finally:
        spark.sql("DROP TABLE secret_prices")


def test_ctes_subqueries_and_aliases_are_fine(box):
    sql = """WITH k AS (SELECT * FROM orders o WHERE o.amount IS NOT NULL)
    SELECT k.* FROM k JOIN (SELECT max(id) AS m FROM orders) x ON k.id <= x.m -- done"""
    assert outcome(box, sql)[0]["passed"]


def test_views_do_not_leak_out_of_the_sandbox(spark, box):
    assert not spark.catalog.tableExists("orders")


@pytest.mark.parametrize("sql, passed, made, status", [
    ("", False, 0, "escalated"), ("SELECT 1", True, 0, "pending_approval"), ("SELECT 1", False, 0, "fixing"),
    ("SELECT 1", False, 1, "fixing"), ("SELECT 1", False, 2, "escalated"),
])
def test_next_status(sql, passed, made, status):
    assert sandbox.next_status(sql, passed, made)[0] == status
