"""Incidents and reports over violations (W5, G7-G13, L1, L6, L7, N12, N13, T8, T9 batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import CATALOG
from catalog.frames import COLUMNS, FEED, FOUND, TOPIC, feed, flat, found, rule_set, settled
from plumbline.operators import reports, rowchecks, sessions, volume

GAP = 300

# The session of every violation: a new one starts after a pause of the gap or more.
SESSIONS = f"""{FOUND}, paused AS (
  SELECT *, CASE WHEN at_us - LAG(at_us) OVER w < {GAP} * 1000000 THEN 0 ELSE 1 END AS starts
  FROM found WINDOW w AS (PARTITION BY topic, "column" ORDER BY at_us, record_id, rule_name)),
  placed AS (
  SELECT *, SUM(starts) OVER (PARTITION BY topic, "column" ORDER BY at_us, record_id, rule_name
    ROWS UNBOUNDED PRECEDING) AS session FROM paused),
  sessions AS (
  SELECT topic, "column", session, MIN(at_us) AS first_us, MAX(at_us) AS last_us, COUNT(*) AS violation_count,
    CASE MAX(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END)
      WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity
  FROM placed GROUP BY topic, "column", session),
  rule_order AS (
  SELECT topic, "column", session, string_agg(rule_name, ',' ORDER BY seen_us, seen_id, rule_name) AS rules
  FROM (SELECT topic, "column", session, rule_name, MIN(at_us) AS seen_us,
          arg_min(record_id, (at_us, record_id)) AS seen_id
        FROM placed GROUP BY topic, "column", session, rule_name)
  GROUP BY topic, "column", session)"""


@CATALOG.add("w5_sessionize", f"""WITH {SESSIONS}
  SELECT topic, "column", first_us, last_us, violation_count FROM sessions""")
def w5(spark, folder):
    folded = sessions.incidents(found(spark, folder), GAP, samples=0)
    return folded.select(
        "topic", "column", F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"), "violation_count",
    )


@CATALOG.add("w5_sessionize_blocks", f"""WITH {SESSIONS}
  SELECT topic, "column", first_us, last_us, violation_count FROM sessions""")
def w5_blocks(spark, folder):
    """The plan for more time buckets than one task should sort."""
    folded = sessions.incidents(found(spark, folder), GAP, samples=0, rows_per_task=100)
    return folded.select(
        "topic", "column", F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"), "violation_count",
    )


@CATALOG.add("g12_incident_aggregate", f"""WITH {SESSIONS}, top AS (
  SELECT topic, "column", session, string_agg(record_id, ',' ORDER BY at_us, record_id, rule_name) AS samples
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, "column", session
          ORDER BY at_us, record_id, rule_name) AS rn FROM placed) WHERE rn <= 5
  GROUP BY topic, "column", session)
  SELECT topic, "column", first_us, last_us, violation_count, severity, rules, samples
  FROM sessions JOIN rule_order USING (topic, "column", session) JOIN top USING (topic, "column", session)""")
def g12(spark, folder):
    folded = sessions.incidents(found(spark, folder), GAP)
    return folded.select(
        "topic", "column", F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"), "violation_count", "severity",
        F.array_join("rule_names", ",").alias("rules"),
        F.array_join(F.transform("sample_violations", lambda v: v["record_id"]), ",").alias("samples"),
    )


@CATALOG.add("n16_sequence_ids", f"""WITH {SESSIONS}
  SELECT printf('stream-%06d', ROW_NUMBER() OVER (ORDER BY last_us, topic, "column")) AS incident_id,
    "column", last_us FROM sessions""")
def n16(spark, folder):
    folded = sessions.numbered(sessions.incidents(found(spark, folder), GAP, samples=0))
    return folded.select("incident_id", "column", F.unix_micros("last_seen").alias("last_us"))


@CATALOG.add("t8_cross_topic_incidents", f"""WITH {SESSIONS.replace("found AS (", "found AS (", 1)},
  by_column AS (SELECT "column" AS topic, first_us, last_us, violation_count, severity FROM sessions),
  reach AS (SELECT *, MAX(last_us) OVER (ORDER BY first_us, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS reached FROM by_column),
  grouped AS (SELECT *, SUM(CASE WHEN reached IS NULL OR first_us - reached >= 60 * 1000000 THEN 1 ELSE 0 END)
    OVER (ORDER BY first_us, topic ROWS UNBOUNDED PRECEDING) AS g FROM reach)
  SELECT MIN(first_us) AS first_us, MAX(last_us) AS last_us, COUNT(*) AS incident_count,
    CAST(SUM(violation_count) AS BIGINT) AS violation_count, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics
  FROM grouped GROUP BY g HAVING COUNT(DISTINCT topic) >= 2""")
def t8(spark, folder):
    """Each checked column taken as a topic of its own, as the feed has one topic only."""
    mine = found(spark, folder).withColumn("topic", F.col("column"))
    folded = sessions.incidents(mine, GAP, samples=0)
    crossed = sessions.cross_topic_incidents(folded, 60.0)
    return crossed.select(
        F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"),
        "incident_count", "violation_count", F.array_join("topics", ",").alias("topics"),
    )


@CATALOG.add("g7_violation_kpis", f"""WITH {FOUND} SELECT COUNT(*) AS total,
  COUNT(*) FILTER (WHERE severity = 'critical') AS critical, COUNT(DISTINCT topic) AS topics,
  CAST((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - MAX(at_us)) // 1000000 AS BIGINT) AS last_seen_seconds
  FROM found""")
def g7(spark, folder):
    return reports.kpis(found(spark, folder), F.lit("2024-03-01 00:00:00").cast("timestamp"))


@CATALOG.add("g8_violation_timeline", f"""WITH {FOUND}
  SELECT at_us // 60000000 AS minute, severity, COUNT(*) AS violations FROM found GROUP BY ALL""")
def g8(spark, folder):
    counted = reports.timeline(found(spark, folder))
    return counted.withColumn("minute", (F.unix_seconds("minute") / 60).cast("long"))


@CATALOG.add("g9_violations_by_topic", f"""WITH {FOUND}
  SELECT "column" AS topic, COUNT(*) AS violations FROM found GROUP BY ALL""")
def g9(spark, folder):
    return reports.by_topic(found(spark, folder).withColumn("topic", F.col("column")))


@CATALOG.add("g10_violations_by_rule", f"""WITH {FOUND}, per_device AS (
  SELECT rule_name || '-' || CAST(user_id % 20 AS VARCHAR) AS rule_name FROM found
  JOIN feed ON feed.id = found.record_id)
  SELECT rule_name, COUNT(*) AS violations FROM per_device GROUP BY rule_name
  ORDER BY violations DESC, rule_name LIMIT 10""")
def g10(spark, folder):
    """Rule names made more numerous, so that the top 10 leaves some out."""
    rows = feed(spark, folder)
    suffix = rows.select(F.col("id").alias("record_id"), (F.col("user_id") % 20).cast("string").alias("d"))
    named = found(spark, folder).join(suffix, "record_id").withColumn(
        "rule_name", F.concat_ws("-", "rule_name", "d")
    )
    return reports.by_rule(named)


@CATALOG.add("g13_topic_quality_score", f"""WITH {FOUND},
  marked AS (SELECT event_type AS topic, epoch_us(ts) // 3600000000 AS hour,
    id IN (SELECT record_id FROM found) AS bad FROM feed)
  SELECT topic, hour, COUNT(*) AS records, COUNT(*) FILTER (WHERE bad) AS bad_records,
    ROUND(1.0 - COUNT(*) FILTER (WHERE bad) / COUNT(*), 9) AS score FROM marked GROUP BY topic, hour""")
def g13(spark, folder):
    listed = rowchecks.with_violations(feed(spark, folder), rule_set(), time_column="ts")
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour")
    scored = reports.quality_score(
        listed, F.size("violations") > 0, by=[F.col("event_type").alias("topic"), hour]
    )
    return scored.withColumn("score", F.round("score", 9))


@CATALOG.add("l1_recent_violations", f"""WITH {FOUND} SELECT record_id, rule_name, at_us FROM found
  WHERE topic = '{TOPIC}' ORDER BY at_us DESC, record_id, rule_name LIMIT 200""")
def l1(spark, folder):
    return flat(reports.recent(found(spark, folder), TOPIC)).select("record_id", "rule_name", "at_us")


@CATALOG.add("l7_violation_feed", f"""WITH {FOUND}
  SELECT at_us, topic, rule_name, "column", value, expected, severity FROM found
  ORDER BY at_us DESC, record_id, rule_name LIMIT 50""")
def l7(spark, folder):
    shown = reports.feed(found(spark, folder))
    return shown.select(F.unix_micros("timestamp").alias("at_us"), *shown.columns[1:])


@CATALOG.add("l6_truncate_samples", f"""WITH {SESSIONS}
  SELECT "column", first_us, LEAST(violation_count, 5) AS samples FROM sessions""")
def l6(spark, folder):
    folded = sessions.incidents(found(spark, folder), GAP)
    return folded.select("column", F.unix_micros("first_seen").alias("first_us"),
                         F.size("sample_violations").cast("long").alias("samples"))


@CATALOG.add("n12_max_severity", f"""WITH {FOUND} SELECT record_id,
  CASE MAX(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM found GROUP BY record_id""")
def n12(spark, folder):
    from plumbline.functions.values import rank_of_severity, severity_of_rank

    worst = found(spark, folder).groupBy("record_id").agg(F.max(rank_of_severity(F.col("severity"))).alias("r"))
    return worst.select("record_id", severity_of_rank(F.col("r")).alias("severity"))


@CATALOG.add("n13_ordered_distinct", f"""WITH {SESSIONS}
  SELECT "column", session, rules FROM rule_order""")
def n13(spark, folder):
    from pyspark.sql import Window

    folded = sessions.incidents(found(spark, folder), GAP, samples=0)
    number = F.row_number().over(Window.partitionBy("column").orderBy("first_seen"))
    return folded.select("column", number.cast("long").alias("session"),
                         F.array_join("rule_names", ",").alias("rules"))


@CATALOG.add("t9_volume_baseline", """WITH RECURSIVE counted AS (
    SELECT event_type AS topic, epoch_us(ts) // 21600000000 AS interval, COUNT(*) AS c FROM events
    WHERE TRUE GROUP BY ALL),
  spans AS (SELECT topic, UNNEST(range(MIN(interval), MAX(interval) + 1)) AS interval FROM counted GROUP BY topic),
  filled AS (SELECT topic, interval, COALESCE(c, 0) AS c FROM spans LEFT JOIN counted USING (topic, interval)),
  series AS (SELECT *, CAST(c AS DOUBLE) AS x, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY interval) AS i,
    AVG(c) OVER (PARTITION BY topic ORDER BY interval) AS rm,
    VAR_POP(c) OVER (PARTITION BY topic ORDER BY interval) AS rv FROM filled),
  fold AS (
    SELECT topic, interval, x, i, rm AS m, CASE WHEN rv > 0 THEN rv ELSE 1.0 END AS v,
      CAST(NULL AS DOUBLE) AS mb, CAST(NULL AS DOUBLE) AS vb FROM series WHERE i = 10
    UNION ALL
    SELECT s.topic, s.interval, s.x, s.i, 0.05 * s.x + 0.95 * f.m,
      0.05 * (s.x - (0.05 * s.x + 0.95 * f.m)) * (s.x - (0.05 * s.x + 0.95 * f.m)) + 0.95 * f.v, f.m, f.v
    FROM fold f JOIN series s ON s.topic = f.topic AND s.i = f.i + 1),
  z AS (SELECT *, CASE WHEN vb > 0 THEN SQRT(vb) ELSE 1.0 END AS sd FROM fold WHERE mb IS NOT NULL)
  SELECT topic, interval, CAST(x AS BIGINT) AS records, ROUND(mb + 3e-8, 6) AS mean, ROUND(ABS(x - mb) / sd, 6) AS z
  FROM z WHERE x < mb AND ABS(x - mb) / sd > 1.0""")
def t9(spark, folder):
    series = volume.volume_series(feed(spark, folder), "ts", 21600, F.col("event_type"))
    drops = volume.volume_drops(series, z_score_threshold=1.0)
    return drops.select("topic", "interval", "records", settled("mean_before", 6).alias("mean"),
                        F.round("z", 6).alias("z"))
