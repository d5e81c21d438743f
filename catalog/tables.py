"""Profiles, assertions, fixes, lineage and incident state over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import CATALOG
from catalog.frames import table
from plumbline.operators import assertions as A
from plumbline.operators import incidents, lineage, ordered, profile, reports, sandbox
from plumbline.session import scratch_path
from plumbline.sources import dbt, tables


def damaged_orders(spark, folder):
    """`orders` with missing customers and statuses, unknown priorities and repeated keys."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.when(key % 97 == 0, key - 1).otherwise(key).alias("o_orderkey"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 29 == 0, F.lit("X")).when(key % 31 == 0, F.lit(None))
        .otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
        key.alias("row_id"),
    )


DAMAGED = """damaged AS (SELECT
  CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 29 = 0 THEN 'X' WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice, o_orderkey AS row_id FROM orders)"""


@CATALOG.add("s1_scan_parquet", """SELECT l_returnflag, COUNT(*) AS lines, SUM(l_quantity) AS quantity
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY l_returnflag""")
def s1(spark, folder):
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")
    )


@CATALOG.add("s2_scan_csv", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def s2(spark, folder):
    path = scratch_path(spark, "csv")
    kept = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    kept.write.option("header", True).csv(path)
    return tables.scan_csv(spark, path, kept.schema)


@CATALOG.add("s3_register_table", """SELECT c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def s3(spark, folder):
    with sandbox.Sandbox(spark) as box:
        box.load_table("orders", table(spark, folder, "orders"))
        box.load_table("customer", table(spark, folder, "customer"))
        return box.execute_fix("""SELECT c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")


@CATALOG.add("g1_profile_columns", f"""WITH {DAMAGED}, counts AS (SELECT COUNT(*) AS r,
    COUNT(*) - COUNT(o_orderkey) AS a, COUNT(*) - COUNT(o_custkey) AS b, COUNT(*) - COUNT(o_orderstatus) AS c,
    COUNT(*) - COUNT(o_totalprice) AS d FROM damaged)
  SELECT 'orders' AS table_name, n AS column_name, r AS row_count, k AS null_count, ROUND(k / r, 9) AS null_rate
  FROM counts, LATERAL (VALUES ('o_orderkey', a), ('o_custkey', b), ('o_orderstatus', c), ('o_totalprice', d)) AS t(n, k)""")
def g1(spark, folder):
    profiled = profile.profile_columns(damaged_orders(spark, folder).drop("row_id"), "orders")
    return profiled.withColumn("null_rate", F.round("null_rate", 9))


@CATALOG.add("g1_profile_all_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, {n} AS columns FROM {t}" for t, n in (
        ("customer", 5), ("lineitem", 11), ("documents", 5), ("events", 6))))
def g1_all(spark, folder):
    names = ("customer", "lineitem", "documents", "events")
    whole = profile.profile_tables({n: table(spark, folder, n) for n in names}, distinct=True)
    return whole.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("columns")
    )


@CATALOG.add("g2_null_rate", f"""WITH {DAMAGED} SELECT ROUND(AVG(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END), 9)
  AS null_rate, 0.0 AS missing_column FROM damaged""")
def g2(spark, folder):
    rows = damaged_orders(spark, folder)
    return profile.null_rate(rows, "o_custkey").select(
        F.round("null_rate", 9).alias("null_rate"),
        profile.null_rate(rows, "no_such_column").scalar().alias("missing_column"),
    )


@CATALOG.add("g5_assert_unique", f"""WITH {DAMAGED} SELECT o_orderkey, COUNT(*) AS cnt FROM damaged
  GROUP BY o_orderkey HAVING COUNT(*) > 1""")
def g5(spark, folder):
    return A.unique("o_orderkey").broken_rows(damaged_orders(spark, folder))


@CATALOG.add("g5_assert_unique_nulls", f"""WITH {DAMAGED}, g AS (SELECT o_custkey, COUNT(*) AS cnt FROM damaged
  GROUP BY o_custkey HAVING COUNT(*) > 1)
  SELECT COUNT(*) AS counting_nulls, COUNT(o_custkey) AS ignoring_nulls FROM g""")
def g5_nulls(spark, folder):
    rows = damaged_orders(spark, folder)

    def groups(nulls):
        return A.unique("o_custkey", nulls=nulls).broken_rows(rows).agg(F.count(F.lit(1)).alias(nulls))

    return groups("count").select(
        F.col("count").alias("counting_nulls"), groups("ignore").scalar().alias("ignoring_nulls")
    )


@CATALOG.add("u0b_assert_accepted_values", f"""WITH {DAMAGED} SELECT row_id, o_orderstatus FROM damaged
  WHERE o_orderstatus NOT IN ('O', 'F')""")
def u0b(spark, folder):
    check = A.accepted_values("o_orderstatus", ["O", "F"])
    return damaged_orders(spark, folder).where(check.broken).select("row_id", "o_orderstatus")


@CATALOG.add("u0d_schema_diff", """WITH old AS (SELECT DISTINCT json_keys(props)[1] AS name FROM events),
  new AS (SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN 'kk' ELSE 'k' END AS name,
    CASE WHEN event_id % 5 = 0 THEN 'STRING' ELSE 'BIGINT' END AS type FROM events)
  SELECT COALESCE(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN NULL ELSE 'BIGINT' END AS old_type,
    n.type AS new_type, CASE WHEN o.name IS NULL THEN 'added' ELSE 'retyped' END AS change
  FROM new n LEFT JOIN old o ON o.name = n.name WHERE o.name IS NULL OR n.type <> 'BIGINT'""")
def u0d(spark, folder):
    """Fields the JSON of `events` has, before and after some keys and types changed."""
    before = table(spark, folder, "events").select("event_id", "props")
    renamed = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", '"k"', '"kk"')).otherwise(F.col("props"))
    quoted = F.regexp_replace(renamed, r": ([0-9]+)", r': "$1"')
    after = before.withColumn("props", F.when(F.col("event_id") % 5 == 0, quoted).otherwise(renamed))
    return profile.schema_diff(
        profile.observed_schema(before, "props"), profile.observed_schema(after, "props")
    )


def _customers(spark, folder):
    """Customers in credit; orders of the others refer to nobody."""
    return table(spark, folder, "customer").where(F.col("c_acctbal") >= 0)


ORPHANS = f"""WITH {DAMAGED}, parents AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
  SELECT row_id, o_custkey FROM damaged
  WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM parents)"""


@CATALOG.add("j6_anti_relationships", ORPHANS)
def j6(spark, folder):
    check = A.relationships("o_custkey", _customers(spark, folder), "c_custkey")
    return check.broken_rows(damaged_orders(spark, folder)).select("row_id", "o_custkey")


@CATALOG.add("j6_relationships_lenient", f"""WITH {DAMAGED} SELECT 'row_count_positive' AS name, COUNT(*) > 0 AS passed,
  CAST(CASE WHEN COUNT(*) > 0 THEN 0 ELSE 1 END AS BIGINT) AS failures FROM damaged""")
def j6_lenient(spark, folder):
    checks = A.derive_assertions([{"test_type": "relationships", "column_name": "o_custkey"}])
    return A.run_assertions(damaged_orders(spark, folder), checks).select("name", "passed", "failures")


ASSERTED = f"""WITH {DAMAGED}, checks AS (
  SELECT 'not_null_o_custkey' AS name, (SELECT COUNT(*) FROM damaged WHERE o_custkey IS NULL) AS failures,
    (SELECT string_agg(row_id, ',' ORDER BY row_id) FROM (SELECT row_id FROM damaged WHERE o_custkey IS NULL
      ORDER BY row_id LIMIT 3)) AS samples
  UNION ALL SELECT 'accepted_values_o_orderstatus',
    (SELECT COUNT(*) FROM damaged WHERE o_orderstatus NOT IN ('O', 'F', 'P')),
    (SELECT string_agg(row_id, ',' ORDER BY row_id) FROM (SELECT row_id FROM damaged
      WHERE o_orderstatus NOT IN ('O', 'F', 'P') ORDER BY row_id LIMIT 3))
  UNION ALL SELECT 'not_null_o_totalprice', 0, NULL
  UNION ALL SELECT 'unique_o_orderkey',
    (SELECT COUNT(*) FROM (SELECT 1 FROM damaged GROUP BY o_orderkey HAVING COUNT(*) > 1)), NULL
  UNION ALL SELECT 'row_count_positive', 0, NULL)"""


def _details(spark, folder):
    checks = [
        A.not_null("o_custkey"), A.accepted_values("o_orderstatus", ["O", "F", "P"]),
        A.not_null("o_totalprice"), A.unique("o_orderkey"), A.row_count_positive(),
    ]
    return A.run_assertions(damaged_orders(spark, folder), checks, order=["row_id"])


@CATALOG.add("x5_run_assertions", f"{ASSERTED} SELECT name, failures = 0 AS passed, failures FROM checks")
def x5(spark, folder):
    return _details(spark, folder).select("name", "passed", "failures")


@CATALOG.add("l5_sample_failures", f"""{ASSERTED} SELECT name, samples FROM checks WHERE samples IS NOT NULL""")
def l5(spark, folder):
    shown = _details(spark, folder).where("name like 'not_null%' or name like 'accepted%'")
    ids = F.transform("sample_failures", lambda r: F.get_json_object(r, "$.row_id"))
    return shown.where(F.size("sample_failures") > 0).select("name", F.array_join(ids, ",").alias("samples"))


@CATALOG.add("g11_assertion_rollup", f"""{ASSERTED} SELECT bool_and(failures = 0) AS passed, COUNT(*) AS tests_run,
  COUNT(*) FILTER (WHERE failures = 0) AS tests_passed, COUNT(*) FILTER (WHERE failures > 0) AS tests_failed
  FROM checks""")
def g11(spark, folder):
    return A.assertion_rollup(_details(spark, folder))


@CATALOG.add("x6_derive_assertions", f"""{ASSERTED} SELECT name, failures FROM checks
  WHERE name <> 'not_null_o_totalprice'""")
def x6(spark, folder):
    tests = [
        {"test_type": "not_null", "column_name": "o_custkey"},
        {"test_type": "unique", "column_name": "o_orderkey"},
        {"test_type": "accepted_values", "column_name": "o_orderstatus", "accepted_values": ["O", "F", "P"]},
        {"test_type": "relationships", "column_name": "o_custkey"},
        {"test_type": "accepted_values", "column_name": "o_orderstatus", "accepted_values": []},
        {"test_type": "freshness", "column_name": "o_orderkey"},
    ]
    checks = A.derive_assertions(tests)
    return A.run_assertions(damaged_orders(spark, folder), checks).select("name", "failures")


@CATALOG.add("x6_assertions_of_a_run", f"""{ASSERTED} SELECT name, failures FROM checks
  WHERE name IN ('not_null_o_custkey', 'accepted_values_o_orderstatus')""")
def x6_run(spark, folder):
    """Failing tests read from a run's artifacts become the assertions a fix has to meet.

    The accepted values in the manifest are those of the undamaged table.
    """
    values = table(spark, folder, "orders").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("v"))

    def node(kind, column, accepted):
        return F.struct(
            F.lit(f"{kind}_{column}").alias("name"), F.lit("test").alias("resource_type"),
            F.struct(F.lit(kind).alias("name"), F.struct(accepted.alias("values")).alias("kwargs")).alias("test_metadata"),
            F.lit("model.orders").alias("attached_node"), F.lit(column).alias("column_name"),
        )

    none = F.lit(None).cast("array<string>")
    nodes = values.select(F.create_map(
        F.lit("test.1"), node("not_null", "o_custkey", none),
        F.lit("test.2"), node("accepted_values", "o_orderstatus", F.col("v")),
        F.lit("test.3"), node("unique", "o_orderkey", none),
    ).alias("nodes"))
    results = values.select(F.array(*[
        F.struct(F.lit(f"test.{i}").alias("unique_id"), F.lit(status).alias("status"))
        for i, status in ((1, "fail"), (2, "error"), (3, "pass"))
    ]).alias("results"))
    paths = scratch_path(spark, "run"), scratch_path(spark, "manifest")
    results.select(F.to_json(F.struct("results"))).write.text(paths[0])
    nodes.select(F.to_json(F.struct("nodes"))).write.text(paths[1])
    failing = dbt.failing_tests(
        dbt.scan_run_results(spark, paths[0], multiline=False), dbt.scan_manifest(spark, paths[1], multiline=False)
    )
    checks = A.assertions_of_model(failing, "model.orders")
    return A.run_assertions(damaged_orders(spark, folder), checks).select("name", "failures")


@CATALOG.add("x7_assert_not_null", f"""WITH {DAMAGED} SELECT row_id FROM damaged WHERE o_custkey IS NULL""")
def x7(spark, folder):
    return damaged_orders(spark, folder).where(A.not_null("o_custkey").broken).select("row_id")


@CATALOG.add("x8_assert_row_count_positive", """SELECT 'lineitem' AS name, COUNT(*) > 0 AS passed FROM lineitem
  UNION ALL SELECT 'nothing', FALSE""")
def x8(spark, folder):
    lines = table(spark, folder, "lineitem")

    def check(name, rows):
        return A.run_assertions(rows, [A.row_count_positive()]).select(F.lit(name).alias("name"), "passed")

    return check("lineitem", lines).unionByName(check("nothing", lines.where("l_quantity < 0")))


FIX = """WITH known AS (SELECT * FROM orders_raw WHERE o_custkey IS NOT NULL)
SELECT o_orderkey, MAX(o_custkey) AS o_custkey, MAX(o_orderstatus) AS o_orderstatus FROM known GROUP BY o_orderkey"""


@CATALOG.add("x4_validate_fix", f"""WITH {DAMAGED}, fixed AS (SELECT o_orderkey, MAX(o_custkey) AS o_custkey,
    MAX(o_orderstatus) AS o_orderstatus FROM damaged WHERE o_custkey IS NOT NULL GROUP BY o_orderkey)
  SELECT 'good' AS fix, 'not_null_o_custkey' AS name,
    (SELECT COUNT(*) FROM fixed WHERE o_custkey IS NULL) AS failures
  UNION ALL SELECT 'good', 'unique_o_orderkey',
    (SELECT COUNT(*) FROM (SELECT 1 FROM fixed GROUP BY o_orderkey HAVING COUNT(*) > 1))
  UNION ALL SELECT 'lazy', 'not_null_o_custkey', (SELECT COUNT(*) FROM damaged WHERE o_custkey IS NULL)
  UNION ALL SELECT 'lazy', 'unique_o_orderkey',
    (SELECT COUNT(*) FROM (SELECT 1 FROM damaged GROUP BY o_orderkey HAVING COUNT(*) > 1))
  UNION ALL SELECT 'broken', 'sql_execution', -1
  UNION ALL SELECT 'unsafe', 'sql_execution', -1""")
def x4(spark, folder):
    tests = [
        {"test_type": "not_null", "column_name": "o_custkey"},
        {"test_type": "unique", "column_name": "o_orderkey"},
    ]
    fixes = {
        "good": FIX,
        "lazy": "SELECT * FROM orders_raw",
        "broken": "SELECT no_such_column FROM orders_raw",
        "unsafe": "DROP VIEW orders_raw",
    }
    box = sandbox.Sandbox(spark)
    box.load_table("orders_raw", damaged_orders(spark, folder))
    parts = None
    for name, sql in fixes.items():
        details = sandbox.validate_fix(box, sql, tests).details.select(
            F.lit(name).alias("fix"), "name", "failures"
        )
        parts = details if parts is None else parts.unionByName(details)
    return parts


# Lineage made of the data: an order is built from the customer's order before it.
CHAIN = """edges AS (SELECT CAST(before AS VARCHAR) AS src, CAST(o_orderkey AS VARCHAR) AS dst FROM (
    SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
  WHERE before IS NOT NULL),
  roots AS (SELECT CAST(MAX(o_orderkey) AS VARCHAR) AS root FROM orders GROUP BY o_custkey)"""


def chain(spark, folder):
    """(edges, roots): each customer's orders as a chain, the latest one as root."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    linked = ordered.previous_value(o, "o_orderkey", "before", keys=["o_custkey"], order=["o_orderkey"])
    edges = linked.where("before is not null").select(
        F.col("before").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst")
    )
    roots = o.groupBy("o_custkey").agg(F.max("o_orderkey").cast("string").alias("root")).select("root")
    return edges, roots


def walked(limit: str) -> str:
    return f"""walked AS (
    SELECT root, src AS "table", 1 AS depth FROM roots JOIN edges ON dst = root
    UNION ALL SELECT root, src, depth + 1 FROM walked JOIN edges ON dst = "table" {limit})"""


@CATALOG.add("j2_lineage_upstream", f"""WITH RECURSIVE {CHAIN}, {walked('')}
  SELECT root, "table", MAX(depth) AS depth FROM walked GROUP BY ALL""")
def j2(spark, folder):
    edges, roots = chain(spark, folder)
    return lineage.upstream(edges, roots)


@CATALOG.add("j2_lineage_closure", f"""WITH RECURSIVE {CHAIN}, {walked('')}
  SELECT root, COUNT(*) AS ancestors, MAX(depth) AS deepest FROM walked GROUP BY root""")
def j2_closure(spark, folder):
    edges, roots = chain(spark, folder)
    whole = lineage.upstream(edges, roots, max_depth=None)
    return whole.groupBy("root").agg(
        F.count(F.lit(1)).alias("ancestors"), F.max("depth").alias("deepest")
    )


@CATALOG.add("l8_first_suspect", f"""WITH RECURSIVE {CHAIN}, {walked('')},
  rates AS (SELECT CAST(l_orderkey AS VARCHAR) AS "table", AVG(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END) AS r
    FROM lineitem GROUP BY 1),
  suspects AS (SELECT root, arg_min("table", (-depth, "table")) AS suspect FROM walked JOIN rates USING ("table")
    WHERE r > 0.05 GROUP BY root)
  SELECT w.root, COALESCE(suspect, w.root) AS root_cause_table FROM (SELECT DISTINCT root FROM walked) w
  LEFT JOIN suspects s ON s.root = w.root""")
def l8(spark, folder):
    """Orders as tables; the share of undiscounted lines stands for the null rate."""
    edges, roots = chain(spark, folder)
    lines = table(spark, folder, "lineitem")
    rates = lines.groupBy(F.col("l_orderkey").cast("string").alias("table")).agg(
        F.avg((F.col("l_discount") == 0).cast("int")).alias("null_rate")
    )
    return lineage.first_suspect(lineage.upstream(edges, roots), rates)


@CATALOG.add("s9_scan_lineage", f"""WITH {CHAIN} SELECT src, dst FROM edges""")
def s9(spark, folder):
    """Lineage documents written from the chains, one per edge, and read back."""
    edges, _ = chain(spark, folder)
    named = F.struct(F.col("src").alias("fullyQualifiedName"))
    target = F.struct(F.col("dst").alias("fullyQualifiedName"))
    document = F.to_json(F.struct(
        F.array(named, target).alias("nodes"),
        F.array(F.struct(named.alias("fromEntity"), target.alias("toEntity"))).alias("upstreamEdges"),
    ))
    path = scratch_path(spark, "lineage")
    edges.select(document.alias("value")).write.text(path)
    _, read = tables.scan_lineage(spark, path, multiline=False)
    return read


LINEAGE = [("raw.orders", "staging.orders"), ("staging.orders", "orders")]


def _versions(spark, folder):
    """Three stages of `orders`; customers are missing from the first on."""
    raw = damaged_orders(spark, folder)
    return {"raw.orders": raw, "staging.orders": raw.where("o_totalprice > 1000"),
            "orders": raw.where("o_orderstatus is not null")}


RATES = """rates AS (
    SELECT 1 AS place, 'raw.orders' AS t, AVG(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM damaged
    UNION ALL SELECT 2, 'staging.orders', AVG(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END) FROM damaged
      WHERE o_totalprice > 1000)"""
ROOT_CAUSE = "COALESCE((SELECT t FROM rates WHERE r > 0.05 ORDER BY place LIMIT 1), 'orders')"


@CATALOG.add("x2_trace_root_cause", f"""WITH {DAMAGED}, {RATES}
  SELECT 'orders' AS root, {ROOT_CAUSE} AS root_cause_table, 'o_custkey' AS root_cause_column""")
def x2(spark, folder):
    edges = spark.createDataFrame(LINEAGE, "src string, dst string")
    return lineage.trace_root_cause(edges, _versions(spark, folder), "orders", "o_custkey")


@CATALOG.add("j5_join_profiles", f"""WITH {DAMAGED} SELECT 'orders' AS root, t AS "table", d AS depth, 'o_custkey' AS column_name,
    row_count, null_count FROM (
  SELECT 'raw.orders' AS t, 2 AS d, COUNT(*) AS row_count, COUNT(*) - COUNT(o_custkey) AS null_count FROM damaged
  UNION ALL SELECT 'staging.orders', 1, COUNT(*), COUNT(*) - COUNT(o_custkey) FROM damaged WHERE o_totalprice > 1000)""")
def j5(spark, folder):
    edges = spark.createDataFrame(LINEAGE, "src string, dst string")
    ancestors = lineage.upstream(edges, spark.createDataFrame([("orders",)], "root string"))
    profiles = profile.profile_tables(_versions(spark, folder))
    return lineage.side_by_side(ancestors, profiles, ["o_custkey"]).drop("null_rate")


BIN = "LEAST(GREATEST(FLOOR({v} / 50000), 0), 9)"


@CATALOG.add("x3_classify_anomaly", """WITH cases AS (
    SELECT c, o.o_totalprice AS old, CASE c WHEN 'volume' THEN CASE WHEN o_orderpriority < '3' THEN o_totalprice END
      WHEN 'nulls' THEN CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END
      WHEN 'shift' THEN o_totalprice * 0.4 ELSE o_totalprice END AS new,
      c <> 'volume' OR o_orderpriority < '3' AS kept
    FROM orders o, (VALUES ('volume'), ('nulls'), ('shift'), ('same')) t(c)),
  figures AS (SELECT c, COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE kept) AS rows_after,
      COUNT(*) FILTER (WHERE kept AND new IS NULL) / COUNT(*) FILTER (WHERE kept) AS null_rate_after
    FROM cases GROUP BY c),
  olds AS (SELECT c, LEAST(GREATEST(FLOOR(old / 50000), 0), 9) AS b, COUNT(*) AS n FROM cases GROUP BY ALL),
  news AS (SELECT c, LEAST(GREATEST(FLOOR(new / 50000), 0), 9) AS b, COUNT(*) AS n FROM cases
    WHERE kept AND new IS NOT NULL GROUP BY ALL),
  bins AS (SELECT c, b, COALESCE(o.n, 0) AS o, COALESCE(n.n, 0) AS n FROM olds o FULL JOIN news n USING (c, b)),
  shares AS (SELECT c, GREATEST(o, 0.5) / SUM(o) OVER (PARTITION BY c) AS os,
    GREATEST(n, 0.5) / SUM(n) OVER (PARTITION BY c) AS ns FROM bins),
  psi AS (SELECT c, SUM((ns - os) * LN(ns / os)) AS psi FROM shares GROUP BY c)
  SELECT c AS "case", rows_before, rows_after, ROUND(null_rate_after, 9) AS null_rate_after, ROUND(psi, 6) AS psi,
    CASE WHEN rows_after / rows_before < 0.5 THEN 'volume_drop' WHEN null_rate_after > 0.05 THEN 'null_spike'
      WHEN psi > 0.2 THEN 'distribution_shift' ELSE 'logic_error' END AS anomaly_type
  FROM figures JOIN psi USING (c)
  UNION ALL SELECT 'schema', COUNT(*), COUNT(*), 1.0, 0.0, 'schema_drift' FROM orders""")
def x3(spark, folder):
    before = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    after = {
        "volume": before.where("o_orderpriority < '3'"),
        "nulls": before.withColumn("o_totalprice", F.when(key % 8 != 0, price)),
        "shift": before.withColumn("o_totalprice", price * 0.4),
        "same": before,
        "schema": before.withColumnRenamed("o_totalprice", "total"),
    }
    bins = profile.equal_width_bin(price, 0.0, 500000.0, 10)
    whole = None
    for name, rows in after.items():
        found = profile.classify_anomaly(before, rows, "o_totalprice", bins).select(
            F.lit(name).alias("case"), "rows_before", "rows_after",
            F.round("null_rate_after", 9).alias("null_rate_after"),
            F.round("stability_index", 6).alias("psi"), "anomaly_type",
        )
        whole = found if whole is None else whole.unionByName(found)
    return whole


# An incident per order: its events are written at the order's date, one per line item.
STATUSES = ("observing", "tracing", "diagnosing", "fixing", "sandbox", "pending_approval", "resolved")
EVENTS = """log AS (SELECT 'inc-' || l_orderkey AS incident_id, CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 100000000
      + CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS seq,
    'table-' || l_partkey AS table_name, 'null_spike' AS anomaly_type, l_returnflag AS root_cause,
    'supplier-' || l_suppkey AS root_cause_table,
    list_extract(['observing','tracing','diagnosing','fixing','sandbox','pending_approval','resolved'], l_linenumber)
      AS status, l_linestatus AS proposed_fix, epoch_us(l_shipdate) AS at_us
  FROM lineitem),
  ordered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY incident_id ORDER BY seq) AS a,
    ROW_NUMBER() OVER (PARTITION BY incident_id ORDER BY seq DESC) AS z,
    LAG(status) OVER (PARTITION BY incident_id ORDER BY seq) AS previous_status FROM log),
  state AS (SELECT f.incident_id, f.table_name, f.at_us AS created_us, l.status, l.root_cause, l.root_cause_table,
      l.proposed_fix, CASE WHEN l.status = 'resolved' THEN (SELECT MAX(r.at_us) FROM log r
        WHERE r.incident_id = f.incident_id AND r.status = 'resolved') END AS resolved_us
    FROM ordered f JOIN ordered l ON l.incident_id = f.incident_id AND f.a = 1 AND l.z = 1)"""


def incident_log(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.concat(F.lit("inc-"), F.col("l_orderkey").cast("string")).alias("incident_id"),
        (F.col("l_linenumber").cast("long") * 10**15 + F.col("l_partkey") * 10**8
         + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("seq"),
        F.concat(F.lit("table-"), F.col("l_partkey").cast("string")).alias("table_name"),
        F.lit("null_spike").alias("anomaly_type"),
        F.col("l_returnflag").alias("root_cause"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("root_cause_table"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("l_linenumber")).alias("status"),
        F.col("l_linestatus").alias("proposed_fix"),
        F.lit("{}").alias("sandbox_result"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def _state_view(state):
    return state.select(
        "incident_id", "table_name", F.unix_micros("created_at").alias("created_us"), "status", "root_cause",
        "root_cause_table", "proposed_fix", F.unix_micros("resolved_at").alias("resolved_us"),
    )


@CATALOG.add("k6_upsert_incidents", f"WITH {EVENTS} SELECT * FROM state")
def k6(spark, folder):
    return _state_view(incidents.current_state(incident_log(spark, folder)))


@CATALOG.add("x9_incident_state", f"""WITH {EVENTS} SELECT incident_id, seq, status, previous_status FROM ordered
  WHERE previous_status IS NOT NULL AND previous_status <> status AND NOT (
    (previous_status = 'observing' AND status = 'tracing') OR (previous_status = 'tracing' AND status = 'diagnosing')
    OR (previous_status = 'diagnosing' AND status = 'fixing') OR (previous_status = 'fixing' AND status = 'sandbox')
    OR (previous_status = 'sandbox' AND status IN ('pending_approval', 'fixing', 'escalated'))
    OR (previous_status = 'pending_approval' AND status IN ('resolved', 'escalated')))""")
def x9(spark, folder):
    return incidents.illegal_transitions(incident_log(spark, folder))


@CATALOG.add("l3_pending_incidents", f"""WITH {EVENTS} SELECT incident_id, created_us FROM state
  WHERE status = 'pending_approval'""")
def l3(spark, folder):
    waiting = incidents.pending(incidents.current_state(incident_log(spark, folder)))
    return waiting.select("incident_id", F.unix_micros("created_at").alias("created_us"))


@CATALOG.add("f13_filter_status", f"""WITH {EVENTS} SELECT incident_id, status FROM state
  WHERE status IN ('sandbox', 'resolved')""")
def f13(spark, folder):
    state = incidents.current_state(incident_log(spark, folder))
    resolved = incidents.with_status(state, "resolved")
    return incidents.with_status(state, "sandbox").unionByName(resolved).select("incident_id", "status")


@CATALOG.add("x9_decisions", f"""WITH {EVENTS} SELECT incident_id, CASE incident_id WHEN 'inc-7' THEN 'resolved'
  WHEN 'inc-8' THEN 'escalated' ELSE status END AS status FROM state""")
def x9_decisions(spark, folder):
    log = incident_log(spark, folder)
    state = incidents.current_state(log)
    at, seq = F.lit("2026-01-01").cast("timestamp"), F.lit(10**17)
    yes = incidents.decide(state, "inc-7", approve=True, seq=seq, at=at)
    no = incidents.decide(state, "inc-8", approve=False, seq=seq, at=at)
    decided = incidents.current_state(log.unionByName(yes).unionByName(no))
    return decided.select("incident_id", "status")


FAILING = "(SELECT COUNT(*) FROM checks WHERE failures > 0)"
PROFILED = f"""counts AS (SELECT COUNT(*) AS r, COUNT(*) - COUNT(o_orderkey) AS a,
    COUNT(*) - COUNT(o_custkey) AS b, COUNT(*) - COUNT(o_orderstatus) AS c FROM damaged)"""


def _observed(spark, folder):
    rows = damaged_orders(spark, folder).select("o_orderkey", "o_custkey", "o_orderstatus")
    tests = _details(spark, folder).where("not passed").select(
        F.col("name").alias("unique_id"), F.lit("fail").alias("status"), "failures"
    )
    return incidents.observe(
        profile.profile_columns(rows, "orders"), "orders", tests, incident_id="incident-1"
    ), tests


@CATALOG.add("x1_observe", f"""{ASSERTED}, {PROFILED} SELECT 'incident-1' AS incident_id, 'orders' AS table_name,
  r AS row_count, {FAILING} AS failing, b AS missing_customers, 'tracing' AS status FROM counts""")
def x1(spark, folder):
    observed, _ = _observed(spark, folder)
    return observed.select(
        "incident_id", "table_name", "row_count",
        F.json_array_length("failing_tests").cast("long").alias("failing"),
        F.get_json_object("column_stats", "$.o_custkey.null_count").cast("long").alias("missing_customers"),
        "status",
    )


@CATALOG.add("x10_incident_report", f"""{ASSERTED}, {PROFILED}, {RATES},
  edges(src, dst) AS (VALUES {", ".join(map(str, LINEAGE))}),
  shares AS (SELECT (SELECT AVG(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END) FROM damaged) AS now,
    (SELECT AVG(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END) FROM orders) AS before)
  SELECT 'orders' AS failing_table, {ROOT_CAUSE} AS root_cause_table, 'o_custkey' AS root_cause_column,
    (SELECT CASE WHEN now - before > 0.05 THEN 'null_spike' END FROM shares) AS anomaly_type, {FAILING} AS tests,
    (SELECT COUNT(*) FROM edges) AS edges, r AS row_count FROM counts""")
def x10(spark, folder):
    observed, tests = _observed(spark, folder)
    edges = spark.createDataFrame(LINEAGE, "src string, dst string")
    cause = lineage.trace_root_cause(edges, _versions(spark, folder), "orders", "o_custkey")
    clean = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    now = damaged_orders(spark, folder).select("o_orderkey", "o_custkey")
    kind = profile.classify_anomaly(
        clean, now, "o_custkey", profile.equal_width_bin(F.col("o_custkey"), 0.0, 1e9, 10)
    )
    made = incidents.report(observed, cause, edges, tests, kind)

    def part(name):
        return F.get_json_object("report", f"$.{name}").alias(name)

    return made.select(
        part("failing_table"), part("root_cause_table"), part("root_cause_column"), part("anomaly_type"),
        F.json_array_length(F.get_json_object("report", "$.tests")).cast("long").alias("tests"),
        F.json_array_length(F.get_json_object("report", "$.edges")).cast("long").alias("edges"),
        part("row_count").cast("long"),
    )


@CATALOG.add("l9_first_failing_column", """SELECT o_custkey, COALESCE(arg_min(column_name, o_orderkey)
    FILTER (WHERE column_name <> ''), '') AS column_name
  FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'column-' || (o_orderkey % 7) END
    AS column_name FROM orders) GROUP BY o_custkey""")
def l9(spark, folder):
    """The tests of a run are the orders of a customer."""
    key = F.col("o_orderkey")
    tests = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey",
        F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("column-"), (key % 7).cast("string")))
        .alias("column_name"),
    )
    return lineage.first_failing_column(tests, "o_orderkey", by=["o_custkey"])


@CATALOG.add("l2_pass_rate_history", """WITH runs AS (SELECT DATE_TRUNC('month', o_orderdate) AS run_at, COUNT(*) AS total,
    COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1)
  SELECT epoch_us(run_at) AS run_us, ROUND((total - failed) / total, 9) AS pass_rate, total AS total_records,
    failed AS failed_records FROM runs ORDER BY run_at DESC LIMIT 30""")
def l2(spark, folder):
    """One run a month over `orders`, open orders passing."""
    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp")
    runs = table(spark, folder, "orders").groupBy(month.alias("run_at")).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("o_orderstatus") == "F").alias("failed_records"),
    ).select(
        "*", F.lit("orders").alias("suite_name"), F.lit("o_orderstatus").alias("column_name"),
        F.lit("open").alias("expectation"),
        ((F.col("total_records") - F.col("failed_records")) / F.col("total_records")).alias("pass_rate"),
    )
    other = runs.withColumn("suite_name", F.lit("lineitem"))
    shown = reports.pass_rate_history(runs.unionByName(other), "orders", "o_orderstatus", "open")
    return shown.select(F.unix_micros("run_at").alias("run_us"), F.round("pass_rate", 9).alias("pass_rate"),
                        "total_records", "failed_records")
