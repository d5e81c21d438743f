"""The store, dbt artifacts, and scalar helpers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from catalog import CATALOG
from catalog.frames import FEED, FOUND, STATISTICAL, TOPIC, feed, found, rule_set, settled, table
from catalog.tables import EVENTS, _state_view, incident_log
from catalog.texts import RUN, SUITE, _run
from catalog.windows import fold_sql
from plumbline.functions import values
from plumbline.operators import baseline
from plumbline.session import scratch_path
from plumbline.sources import dbt
from plumbline.sources.store import Store, latest_per_key


def new_store(spark) -> Store:
    return Store(spark, scratch_path(spark, "store"))


@CATALOG.add("k2_sink_violations", f"""WITH {FOUND} SELECT rule_name, COALESCE(value, '') AS value, COUNT(*) AS rows
  FROM found GROUP BY ALL""")
def k2(spark, folder):
    """The same batch saved twice is stored once."""
    store = new_store(spark)
    for _ in range(2):
        store.save_violations(found(spark, folder), batch_id=0)
    return store.violations().groupBy("rule_name", "value").agg(F.count(F.lit(1)).alias("rows"))


@CATALOG.add("s10_scan_store", f"""WITH {FOUND} SELECT CAST(make_timestamp(at_us) AS DATE)::VARCHAR AS day, rule_name,
  COUNT(*) AS violations FROM found WHERE at_us >= epoch_us(TIMESTAMP '2024-01-10') GROUP BY ALL""")
def s10(spark, folder):
    store = new_store(spark)
    store.save_violations(found(spark, folder))
    late = store.violations().where(F.col("date") >= F.lit("2024-01-10").cast("date"))
    return late.groupBy(F.col("date").cast("string").alias("day"), "rule_name").agg(
        F.count(F.lit(1)).alias("violations")
    )


SNAPSHOTS = f"""{FEED}, {fold_sql('value', 10, 'user_id')},
  halves AS (SELECT user_id, 'first' AS h, MAX(i) AS n FROM series WHERE event_id < (SELECT COUNT(*) / 2 FROM events)
      GROUP BY user_id
    UNION ALL SELECT user_id, 'second', MAX(i) FROM series GROUP BY user_id)"""


@CATALOG.add("k3_upsert_baselines", f"""WITH RECURSIVE {SNAPSHOTS}
  SELECT '{TOPIC}' AS topic, 'value_jump-' || user_id AS rule_name, MAX(n) AS sample_count FROM halves GROUP BY user_id""")
def k3(spark, folder):
    """A baseline per user, saved half way and at the end; the latest one is read."""
    rule = rule_set({**STATISTICAL, "min_samples": 10}).statistical[0]
    rows = feed(spark, folder).select("event_id", "user_id", "value")
    half = rows.agg(F.count(F.lit(1)) / 2).scalar()
    learned = baseline.learn_baseline(rows, "value", order=["event_id"], keys=["user_id"], min_samples=10)
    store = new_store(spark)
    for moment, part in (("2026-01-01", learned.where(F.col("event_id") < half)), ("2026-01-02", learned)):
        at = F.lit(moment).cast("timestamp")
        snapshot = baseline.baseline_snapshot(
            part, TOPIC, rule, order=["event_id"], keys=["user_id"], at=at
        )
        named = snapshot.withColumn("rule_name", F.concat_ws("-", "rule_name", F.col("user_id").cast("string")))
        store.save_baselines(named.drop("user_id"))
    return store.baselines().select("topic", "rule_name", "sample_count")


@CATALOG.add("w7_latest_per_key", """SELECT o_custkey, MAX(o_orderkey) AS o_orderkey,
  arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def w7(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return latest_per_key(rows, ["o_custkey"], "o_orderkey")


@CATALOG.add("k4_sink_results", f"""WITH {SUITE} SELECT 'run-1' AS run_id, 'products' AS suite_name, expectation,
  total_records, passed_records, '2026-01-01' AS day FROM results""")
def k4(spark, folder):
    store = new_store(spark)
    store.save_run(_run(spark, folder))
    return store.read("results").select(
        "run_id", "suite_name", "expectation", "total_records", "passed_records",
        F.col("date").cast("string").alias("day"),
    )


@CATALOG.add("k5_sink_verdicts", f"""WITH {SUITE} SELECT 'run-1' AS run_id, expectation, p_partkey AS record_index, passed
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY expectation ORDER BY p_partkey) AS rn FROM judged WHERE NOT passed)
  WHERE rn <= 100""")
def k5(spark, folder):
    store = new_store(spark)
    store.save_run(_run(spark, folder))
    return store.read("verdicts").select("run_id", "expectation", "record_index", "passed")


@CATALOG.add("k6_upsert_incidents_store", f"WITH {EVENTS} SELECT * FROM state")
def k6_store(spark, folder):
    store = new_store(spark)
    store.save_incident_events(incident_log(spark, folder))
    return _state_view(store.incident_states())


# Artifacts of a dbt project, made of the tables: a run per stretch of orders, a manifest per stretch of customers.
DBT_STATUS = {"F": "fail", "P": "error", "O": "pass"}


def _artifacts(spark, folder):
    """(run results, manifest) as folders of JSON lines; each document holds at most 32 entries."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "error").otherwise("pass")
    result = F.struct(
        F.concat(F.lit("test."), F.col("o_custkey").cast("string")).alias("unique_id"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 100).alias("failures"),
        F.col("o_orderpriority").alias("message"),
    )
    runs = o.groupBy(F.floor(F.col("o_orderkey") / 32).alias("g")).agg(F.collect_list(result).alias("results"))
    node = F.struct(
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 4 == 0, "model").otherwise("test").alias("resource_type"),
        F.when(F.col("c_custkey") % 4 != 1, F.struct(F.lit("not_null").alias("name"))).alias("test_metadata"),
        F.concat(F.lit("model."), F.col("c_nationkey").cast("string")).alias("attached_node"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("c_name")).alias("column_name"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("compiled_code"),
        F.lit("select 1").alias("compiled_sql"),
    )
    known = c.where(F.col("c_mktsegment") != "BUILDING")
    manifests = known.groupBy(F.floor(F.col("c_custkey") / 32).alias("g")).agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat(F.lit("test."), F.col("c_custkey").cast("string")), node)
    )).alias("nodes"))
    paths = scratch_path(spark, "run-results"), scratch_path(spark, "manifest")
    runs.select(F.to_json(F.struct("results"))).write.text(paths[0])
    manifests.select(F.to_json(F.struct("nodes"))).write.text(paths[1])
    return paths


FAILING = """failing AS (SELECT 'test.' || o_custkey AS unique_id, CASE o_orderstatus WHEN 'F' THEN 'fail' ELSE 'error' END
    AS status, COALESCE(c_name, 'test.' || o_custkey) AS node_name,
    CASE WHEN c_custkey IS NULL OR c_custkey % 4 = 1 THEN 'generic' ELSE 'not_null' END AS test_type,
    COALESCE('model.' || c_nationkey, '') AS model,
    CASE WHEN c_custkey % 2 = 0 THEN 'c_name' ELSE '' END AS column_name,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 ELSE 0 END AS failures, o_orderpriority AS message,
    CASE WHEN c_custkey IS NULL THEN '' WHEN c_custkey % 3 = 0 THEN 'select 1' ELSE c_mktsegment END AS compiled_code
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey
  WHERE o_orderstatus IN ('F', 'P'))"""


@CATALOG.add("s5_scan_dbt_run_results", f"WITH {FAILING} SELECT * FROM failing")
def s5(spark, folder):
    results, manifest = _artifacts(spark, folder)
    failing = dbt.failing_tests(
        dbt.scan_run_results(spark, results, multiline=False), dbt.scan_manifest(spark, manifest, multiline=False)
    )
    return failing.drop("accepted_values")


@CATALOG.add("j1_join_results_manifest", f"WITH {FAILING} SELECT test_type, model, COUNT(*) AS tests, CAST(SUM(failures) "
             "AS BIGINT) AS failures FROM failing GROUP BY ALL")
def j1(spark, folder):
    results, manifest = _artifacts(spark, folder)
    failing = dbt.failing_tests(
        dbt.scan_run_results(spark, results, multiline=False), dbt.scan_manifest(spark, manifest, multiline=False)
    )
    return failing.groupBy("test_type", "model").agg(
        F.count(F.lit(1)).alias("tests"), F.sum("failures").alias("failures")
    )


@CATALOG.add("s6_scan_dbt_model", """SELECT c_name AS model, CASE WHEN c_custkey % 3 = 0 THEN 'select 1'
  ELSE c_mktsegment END AS sql FROM customer WHERE c_custkey % 4 = 0 AND c_mktsegment <> 'BUILDING'""")
def s6(spark, folder):
    _, manifest = _artifacts(spark, folder)
    return dbt.models(dbt.scan_manifest(spark, manifest, multiline=False)).select("model", "sql")


@CATALOG.add("n1_float_coercion", f"""WITH {FEED} SELECT event_id,
  CASE WHEN event_id % 29 = 0 THEN 1000.0::DOUBLE WHEN event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0
    THEN NULL WHEN event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL ELSE value END AS number FROM feed""")
def n1(spark, folder):
    """Blanks and exponents are numbers; suffixes, digit groups and words are not."""
    key = F.col("event_id")
    text = (
        F.when(key % 29 == 0, F.lit("  1e3 ")).when(key % 31 == 0, F.lit("1_000"))
        .when(key % 37 == 0, F.lit("1.0d")).when(key % 41 == 0, F.lit("")).otherwise(F.col("speed"))
    )
    rows = feed(spark, folder).select("event_id", text.alias("t"))
    return rows.select("event_id", values.to_number(F.col("t"), rows.schema["t"].dataType).alias("number"))


@CATALOG.add("n2_stringification", """SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price,
  CAST(o_custkey AS VARCHAR) AS customer FROM orders""")
def n2(spark, folder):
    """Through a rule that every value breaks, as that is where values become text."""
    from plumbline.operators import rowchecks
    from plumbline.rules import RuleSet

    rules = RuleSet.from_dict({"topic": "orders", "rules": [
        {"name": "price", "type": "range", "column": "o_totalprice", "max": -1},
        {"name": "customer", "type": "range", "column": "o_custkey", "max": -1},
    ]})
    orders = table(spark, folder, "orders")
    listed = rowchecks.with_violations(orders, rules, id_columns=["o_orderkey"])
    return listed.select("o_orderkey", F.col("violations")[0]["value"].alias("price"),
                         F.col("violations")[1]["value"].alias("customer"))


@CATALOG.add("n3_null_coalescing", f"""WITH {FEED} SELECT event_id, COALESCE(NULLIF(device_id, ''), NULLIF(speed, ''), '')
  AS first_text FROM feed""")
def n3(spark, folder):
    rows = feed(spark, folder)
    return rows.select("event_id", values.first_truthy(rows.schema, ["device_id", "speed"]).alias("first_text"))


@CATALOG.add("n4_truncation", """SELECT doc_id, LEFT(text, 300) AS clipped, CASE WHEN LENGTH(text) > 500 THEN
  LEFT(text, 500) || '…' ELSE text END AS shown FROM documents""")
def n4(spark, folder):
    docs = table(spark, folder, "documents")
    text = F.col("text")
    return docs.select("doc_id", values.clip(text, 300).alias("clipped"), values.ellipsize(text, 500).alias("shown"))


@CATALOG.add("n5_regex_extract", r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
  len(regexp_extract_all(html, '(?i)href=')) AS links FROM pages""")
def n5(spark, folder):
    pages = table(spark, folder, "pages")
    links = F.regexp_extract_all("html", F.lit("(?i)href="), F.lit(0))
    return pages.select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
                        F.size(links).cast("long").alias("links"))


@CATALOG.add("n6_rounding_text", """SELECT l_returnflag, l_linestatus, printf('%.3f', ROUND(AVG(l_discount), 6)) AS mean,
  printf('%.1f%%', ROUND(COUNT(*) FILTER (WHERE l_tax > 0.04) / COUNT(*) * 100 + 1e-9, 1)) AS taxed FROM lineitem GROUP BY ALL""")
def n6(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus")
    taxed = values.ratio(F.count_if(F.col("l_tax") > 0.04), F.count(F.lit(1)))
    return lines.agg(F.format_string("%.3f", F.round(F.avg("l_discount"), 6)).alias("mean"),
                     values.percent_text(taxed).alias("taxed"))


@CATALOG.add("n7_guarded_arithmetic", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END
  AS share, SQRT(ABS(l_discount - l_tax)) AS spread FROM lineitem""")
def n7(spark, folder):
    lines = table(spark, folder, "lineitem")
    spread = F.sqrt(F.abs(F.col("l_discount") - F.col("l_tax")))
    return lines.select("l_orderkey", "l_linenumber",
                        values.ratio(F.col("l_discount"), F.col("l_tax")).alias("share"), spread.alias("spread"))


@CATALOG.add("n9_time_arithmetic", """SELECT event_id, epoch_us(date_trunc('minute', ts)) AS minute_us,
  CAST((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 1000000 AS BIGINT) AS age FROM events""")
def n9(spark, folder):
    rows = feed(spark, folder)
    now = F.lit("2024-02-01").cast("timestamp")
    return rows.select("event_id", F.unix_micros(values.minute_floor(F.col("ts"))).alias("minute_us"),
                       values.age_seconds(F.col("ts"), now).alias("age"))


@CATALOG.add("n10_json_columns", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  '{"event_type":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS packed FROM events""")
def n10(spark, folder):
    events = table(spark, folder, "events")
    read = F.from_json("props", "k long")["k"]
    return events.select("event_id", read.alias("k"), F.to_json(F.struct("event_type", read.alias("k"))).alias("packed"))


@CATALOG.add("n11_name_parts", """WITH named AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name
    ELSE lower(p_brand) || '.' || p_type || '.' || p_name END AS fqn FROM part)
  SELECT p_partkey, list_extract(string_split(fqn, '.'), -1) AS last_part,
    CASE WHEN contains(fqn, '.') THEN string_split(fqn, '.')[1] ELSE 'analytics' END AS schema_part FROM named""")
def n11(spark, folder):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(
        F.concat_ws(".", F.lower("p_brand"), "p_type", "p_name"))
    parts = table(spark, folder, "part").select("p_partkey", name.alias("fqn"))
    return parts.select("p_partkey", values.last_name_part(F.col("fqn")).alias("last_part"),
                        values.first_name_part(F.col("fqn"), "analytics").alias("schema_part"))


@CATALOG.add("n14_nested_defaults", """SELECT event_id, COALESCE(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k,
  'none' AS missing FROM events""")
def n14(spark, folder):
    read = F.from_json("props", "k long, deep struct<name string>")
    events = table(spark, folder, "events").select("event_id", read.alias("p"))
    return events.select("event_id", F.coalesce("p.k", F.lit(0)).alias("k"),
                         F.coalesce("p.deep.name", F.lit("none")).alias("missing"))


@CATALOG.add("n15_map_text", """SELECT c_custkey, 'name=' || c_name || '; nation=' || c_nationkey AS described FROM customer""")
def n15_map(spark, folder):
    pairs = F.create_map(F.lit("name"), "c_name", F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, folder, "customer").select("c_custkey", values.map_as_text(pairs).alias("described"))


@CATALOG.add("n16_uuid", "SELECT COUNT(*) AS ids, COUNT(*) AS distinct_ids FROM orders")
def n16_uuid(spark, folder):
    ids = table(spark, folder, "orders").select(F.uuid().alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("ids"), F.count_distinct("id").alias("distinct_ids"))
