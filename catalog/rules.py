"""Row rules: the F, K1, U0a, E3 and E4 operators, and scalar helpers they rest on."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import functions as F

from catalog import CATALOG
from catalog.frames import (
    COLUMNS,
    FEED,
    FOUND,
    NOT_NULL_FOUND,
    RANGE_FOUND,
    REGEX_FOUND,
    TOPIC,
    feed,
    flat,
    found,
    plan,
    rule_set,
)
from plumbline.operators import rowchecks
from plumbline.rules import Rule, RuleSet, register_rule_type

ROW = {"time_column": "ts"}


def _only(kind: str) -> RuleSet:
    return RuleSet(TOPIC, rule_set().of(kind))


@CATALOG.add("f1_rule_not_null", f"WITH {FEED} {NOT_NULL_FOUND}")
def f1(spark, folder):
    return flat(rowchecks.violations(feed(spark, folder), _only("not_null"), **ROW))


@CATALOG.add("f2_rule_range", f"WITH {FEED} {RANGE_FOUND}")
def f2(spark, folder):
    return flat(rowchecks.violations(feed(spark, folder), _only("range"), **ROW))


@CATALOG.add("f3_rule_regex", f"WITH {FEED} {REGEX_FOUND}")
def f3(spark, folder):
    return flat(rowchecks.violations(feed(spark, folder), _only("regex"), **ROW))


@CATALOG.add("f6_make_violation", f"""WITH {FEED} SELECT 'violation' AS type, rule_name, record_id FROM (
  SELECT 'device_present' AS rule_name, COALESCE(NULLIF(device_id, ''), CASE WHEN user_id <> 0
    THEN CAST(user_id AS VARCHAR) END, '') AS record_id FROM feed WHERE device_id IS NULL OR device_id = ''
  UNION ALL SELECT 'known_type', COALESCE(NULLIF(device_id, ''), CASE WHEN user_id <> 0
    THEN CAST(user_id AS VARCHAR) END, '') FROM feed
    WHERE NOT regexp_matches(event_type, '^(click|view|purchase)$'))""")
def f6(spark, folder):
    rules = RuleSet(TOPIC, rule_set().of("not_null", "regex"))
    made = rowchecks.violations(feed(spark, folder), rules, id_columns=["device_id", "user_id"], **ROW)
    return made.select("type", "rule_name", "record_id")


@CATALOG.add("f7_validate", f"WITH {FOUND} SELECT {COLUMNS} FROM found")
def f7(spark, folder):
    return flat(found(spark, folder))


@CATALOG.add("f10_drop_clean", f"""WITH {FOUND}
  SELECT record_id, COUNT(*) AS violations, MIN(rule_name) AS first_rule FROM found GROUP BY record_id""")
def f10(spark, folder):
    listed = rowchecks.with_violations(feed(spark, folder), rule_set(), **ROW)
    broken = listed.where(F.size("violations") > 0)
    return broken.select(
        F.col("id").alias("record_id"),
        F.size("violations").cast("long").alias("violations"),
        F.array_min(F.transform("violations", lambda v: v["rule_name"])).alias("first_rule"),
    )


@CATALOG.add("f11_require_column", """SELECT doc_id, 0 AS missing_known,
  LENGTH(lang) AS known_length FROM documents""")
def f11(spark, folder):
    from catalog.frames import table
    from plumbline.operators.expectations import optional_column

    docs = table(spark, folder, "documents")
    rowchecks.require_column(docs, "lang")
    return docs.select(
        "doc_id",
        F.length(optional_column(docs, "no_such_column")).alias("missing_known"),
        F.length(optional_column(docs, "lang")).cast("long").alias("known_length"),
    )


@CATALOG.add("f12_filter_violations", f"""WITH {FOUND}, both_topics AS (
  SELECT * FROM found UNION ALL SELECT * REPLACE ('mirror' AS topic) FROM found)
  SELECT topic, record_id, rule_name FROM both_topics WHERE topic = 'mirror'""")
def f12(spark, folder):
    mine = found(spark, folder)
    both = mine.unionByName(mine.withColumn("topic", F.lit("mirror")))
    return rowchecks.of_topic(both, "mirror").select("topic", "record_id", "rule_name")


@CATALOG.add("f14_quarantine_split", f"""WITH {FOUND}
  SELECT event_id, id IN (SELECT record_id FROM found) AS quarantined FROM feed""")
def f14(spark, folder):
    clean, flagged = rowchecks.quarantine(feed(spark, folder), rule_set())
    return clean.select("event_id", F.lit(False).alias("quarantined")).unionByName(
        flagged.select("event_id", F.lit(True).alias("quarantined"))
    )


@CATALOG.add("k1_violation_messages", f"""WITH {FOUND}
  SELECT record_id AS key, COUNT(*) AS violations,
    string_agg(rule_name, ',' ORDER BY CASE rule_name WHEN 'device_present' THEN 1
      WHEN 'speed_in_range' THEN 2 ELSE 3 END) AS rules FROM found GROUP BY record_id""")
def k1(spark, folder):
    sent = rowchecks.violation_messages(feed(spark, folder), rule_set(), **ROW)
    read = F.from_json("value", "array<struct<rule_name string>>")
    return sent.select(
        "key",
        F.size(read).cast("long").alias("violations"),
        F.array_join(F.transform(read, lambda v: v["rule_name"]), ",").alias("rules"),
    )


@dataclass(frozen=True, kw_only=True)
class LengthRule(Rule):
    """A rule type of the user's own: text no longer than `longest`."""

    longest: int
    kind: ClassVar[str] = "length"


def _check_length(rule, value, data_type):
    text = value.cast("string")
    return rowchecks.Finding(
        F.coalesce(F.length(text) > rule.longest, F.lit(False)),
        F.lit(f"at most {rule.longest} characters"),
        text,
    )


@CATALOG.add("e4_rule_registry", """SELECT CAST(doc_id AS VARCHAR) AS record_id, 'short_text' AS rule_name,
  'at most 1000 characters' AS expected, LENGTH(text) AS value_length
  FROM documents WHERE LENGTH(text) > 1000""")
def e4(spark, folder):
    from catalog.frames import table

    register_rule_type(LengthRule)
    rowchecks.register_row_check("length", _check_length)
    rules = RuleSet.from_dict({"topic": "documents", "rules": [
        {"name": "short_text", "type": "length", "column": "text", "longest": 1000},
    ]})
    docs = table(spark, folder, "documents").withColumn("id", F.col("doc_id").cast("string"))
    return rowchecks.violations(docs, rules).select(
        "record_id", "rule_name", "expected", F.length("value").cast("long").alias("value_length")
    )


@CATALOG.add("e3_multi_output_check", f"""WITH {FOUND}
  SELECT record_id, rule_name, severity FROM found
  WHERE record_id IN (SELECT record_id FROM found GROUP BY record_id HAVING COUNT(*) > 1)""")
def e3(spark, folder):
    listed = rowchecks.with_violations(feed(spark, folder), rule_set(), **ROW)
    several = listed.where(F.size("violations") > 1)
    return several.select(F.inline("violations")).select("record_id", "rule_name", "severity")


@CATALOG.add("f8_compile_rules", f"""WITH {FOUND}
  SELECT rule_name, severity, COUNT(*) AS violations FROM found GROUP BY rule_name, severity""")
def f8(spark, folder):
    compiled = plan()
    return compiled.violations(feed(spark, folder)).groupBy("rule_name", "severity").agg(
        F.count(F.lit(1)).alias("violations")
    )


@CATALOG.add("s7_load_ruleset", f"""WITH {FOUND}
  SELECT rule_name, MIN(at_us) AS first_at_us, COUNT(*) AS violations FROM found GROUP BY rule_name""")
def s7(spark, folder):
    import tempfile

    import yaml

    from catalog.frames import RULES

    with tempfile.NamedTemporaryFile("w", suffix=".yml") as file:
        yaml.safe_dump(RULES, file)
        file.flush()
        rules = RuleSet.from_yaml(file.name)
    return flat(rowchecks.violations(feed(spark, folder), rules, **ROW)).groupBy("rule_name").agg(
        F.min("at_us").alias("first_at_us"), F.count(F.lit(1)).alias("violations")
    )
