"""Ordered state: rolling null rates and learned baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import CATALOG
from catalog.frames import COLUMNS, FEED, FOUND, NULL_RATE, STATISTICAL, TOPIC, feed, flat, plan, rule_set, settled
from plumbline.operators import baseline, ordered

NULL_RATE_SQL = """rated AS (
  SELECT *, AVG(CASE WHEN reading IS NULL THEN 1.0 ELSE 0.0 END) OVER w AS rate, COUNT(*) OVER w AS n
  FROM feed WINDOW w AS (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
NULL_RATE_FOUND = f"""SELECT 'violation' AS type, '{TOPIC}' AS topic, 'reading_gaps' AS rule_name,
  'reading' AS "column", CAST(ROUND(rate, 4) AS VARCHAR) AS value, 'null_rate < 0.2' AS expected,
  'critical' AS severity, CAST(NULL AS DOUBLE) AS z_score, epoch_us(ts) AS at_us, id AS record_id
  FROM rated WHERE n >= 10 AND rate > 0.2"""


def fold_sql(value: str, min_samples: int, keys: str = "", source: str = "feed") -> str:
    """The sequential fold as a recursive query, one step per row and series."""
    key = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    same = f" AND s.{keys} = f.{keys}" if keys else ""
    key_of = f"s.{keys}, " if keys else ""
    return f"""series AS (
    SELECT {key}event_id, id, ts, CAST({value} AS DOUBLE) AS x,
      ROW_NUMBER() OVER ({part}ORDER BY event_id) AS i,
      AVG(CAST({value} AS DOUBLE)) OVER ({part}ORDER BY event_id) AS run_mean,
      VAR_POP(CAST({value} AS DOUBLE)) OVER ({part}ORDER BY event_id) AS run_var
    FROM {source} WHERE {value} IS NOT NULL),
  fold AS (
    SELECT {key}event_id, id, ts, x, i, run_mean, run_var, run_mean AS m,
      CASE WHEN run_var > 0 THEN run_var ELSE 1.0 END AS v,
      CAST(NULL AS DOUBLE) AS m_before, CAST(NULL AS DOUBLE) AS v_before
    FROM series WHERE i = {min_samples}
    UNION ALL
    SELECT {key_of}s.event_id, s.id, s.ts, s.x, s.i, s.run_mean, s.run_var, 0.05 * s.x + 0.95 * f.m,
      0.05 * (s.x - (0.05 * s.x + 0.95 * f.m)) * (s.x - (0.05 * s.x + 0.95 * f.m)) + 0.95 * f.v, f.m, f.v
    FROM fold f JOIN series s ON s.i = f.i + 1{same}),
  scored AS (SELECT *, CASE WHEN v > 0 THEN SQRT(v) ELSE 1.0 END AS sd FROM fold)"""


def statistical_found(rule: str, column: str) -> str:
    return f"""SELECT 'violation' AS type, '{TOPIC}' AS topic, '{rule}' AS rule_name,
  '{column}' AS "column", CAST(x AS VARCHAR) AS value,
  printf('within 3.0 std dev of baseline (mean=%.3f, std=%.3f)', m, sd) AS expected,
  'warning' AS severity, ROUND(ABS(x - m) / sd, 3) AS z_score, epoch_us(ts) AS at_us, id AS record_id
  FROM scored WHERE ABS(x - m) / sd > 3.0"""


@CATALOG.add("f4_rule_null_rate", f"WITH {FEED}, {NULL_RATE_SQL} {NULL_RATE_FOUND}")
def f4(spark, folder):
    rule = rule_set(NULL_RATE).of("null_rate")[0]
    return flat(ordered.null_rate_violations(
        feed(spark, folder), TOPIC, rule, order=["event_id"], time_column="ts"
    ))


@CATALOG.add("f5_rule_statistical",
             f"WITH RECURSIVE {FEED}, {fold_sql('value', 100)} {statistical_found('value_jump', 'value')}")
def f5(spark, folder):
    rule = rule_set(STATISTICAL).statistical[0]
    return flat(baseline.statistical_violations(
        feed(spark, folder), TOPIC, rule, order=["event_id"], time_column="ts"
    ))


RATED = ("SELECT event_id, ROUND(rate, 9) AS rate, n AS rows_in_window FROM rated")


@CATALOG.add("w1_rolling_null_rate", f"WITH {FEED}, {NULL_RATE_SQL} {RATED}")
def w1(spark, folder):
    rows = feed(spark, folder).select("event_id", "reading")
    rated = ordered.rolling_rate(rows, F.col("reading").isNull(), 50, order=["event_id"])
    return rated.select("event_id", F.round("rate", 9).alias("rate"),
                        F.col("rows_in_window").cast("long").alias("rows_in_window"))


@CATALOG.add("w1_rolling_null_rate_blocks", f"WITH {FEED}, {NULL_RATE_SQL} {RATED}")
def w1_blocks(spark, folder):
    """The plan for series too long for one task, at a size where both can be compared."""
    rows = feed(spark, folder).select("event_id", "reading")
    rated = ordered.rolling_rate(
        rows, F.col("reading").isNull(), 50, order=["event_id"], rows_per_task=2000
    )
    return rated.select("event_id", F.round("rate", 9).alias("rate"),
                        F.col("rows_in_window").cast("long").alias("rows_in_window"))


@CATALOG.add("w1_rolling_null_rate_keyed", f"""WITH {FEED}, rated AS (
  SELECT event_id, AVG(CASE WHEN reading IS NULL THEN 1.0 ELSE 0.0 END) OVER w AS rate, COUNT(*) OVER w AS n
  FROM feed WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
  {RATED}""")
def w1_keyed(spark, folder):
    rows = feed(spark, folder).select("event_id", "event_type", "reading")
    rated = ordered.rolling_rate(
        rows, F.col("reading").isNull(), 1000, order=["event_id"], keys=["event_type"]
    )
    return rated.select("event_id", F.round("rate", 9).alias("rate"),
                        F.col("rows_in_window").cast("long").alias("rows_in_window"))


@CATALOG.add("w2_running_welford", f"""WITH {FEED}
  SELECT event_id, COUNT(reading) OVER w AS n, ROUND(AVG(reading) OVER w + 3e-8, 6) AS run_mean,
    ROUND(VAR_POP(reading) OVER w + 3e-6, 4) AS run_var
  FROM feed WHERE reading IS NOT NULL WINDOW w AS (ORDER BY event_id)""")
def w2(spark, folder):
    rows = feed(spark, folder).select("event_id", "reading")
    learned = baseline.learn_baseline(rows, "reading", order=["event_id"], min_samples=100)
    return learned.where(F.col("n").isNotNull()).select(
        "event_id", "n", settled("run_mean", 6), settled("run_var", 4)
    )


SCORED = "SELECT event_id, ROUND(m + 3e-8, 6) AS mean, ROUND(ABS(x - m) / sd, 6) AS z FROM scored"


def _z(rows, **options):
    scored = baseline.z_scores(rows, "value", order=["event_id"], **options)
    return scored.where("z is not null").select(
        "event_id", settled("mean", 6), F.round("z", 6).alias("z")
    )


@CATALOG.add("w3_ema_zscore", f"WITH RECURSIVE {FEED}, {fold_sql('value', 100)} {SCORED}")
def w3(spark, folder):
    return _z(feed(spark, folder).select("event_id", "value"), min_samples=100)


@CATALOG.add("w3_ema_zscore_blocks", f"WITH RECURSIVE {FEED}, {fold_sql('value', 100)} {SCORED}")
def w3_blocks(spark, folder):
    """The two-pass block scan, at a size where the sequential fold can be compared."""
    return _z(feed(spark, folder).select("event_id", "value"), min_samples=100, rows_per_task=2000)


@CATALOG.add("w3_ema_zscore_keyed",
             f"WITH RECURSIVE {FEED}, {fold_sql('value', 10, 'user_id')} {SCORED}")
def w3_keyed(spark, folder):
    return _z(feed(spark, folder).select("event_id", "user_id", "value"), keys=["user_id"], min_samples=10)


@CATALOG.add("w3_ema_zscore_before_update", f"""WITH RECURSIVE {FEED}, {fold_sql('value', 100)}
  SELECT event_id, ROUND(m + 3e-8, 6) AS mean,
    ROUND(ABS(x - m_before) / CASE WHEN v_before > 0 THEN SQRT(v_before) ELSE 1.0 END, 6) AS z
  FROM scored WHERE m_before IS NOT NULL""")
def w3_before(spark, folder):
    return _z(feed(spark, folder).select("event_id", "value"), min_samples=100, score="before_update")


@CATALOG.add("w4_baseline_snapshot", f"""WITH RECURSIVE {FEED}, {fold_sql('value', 10, 'user_id')},
  latest AS (SELECT user_id, MAX(i) AS n FROM series GROUP BY user_id)
  SELECT '{TOPIC}' AS topic, 'value_jump' AS rule_name, l.user_id, l.n AS sample_count,
    ROUND(COALESCE(f.m, s.run_mean), 4) AS mean_value,
    ROUND(COALESCE(f.sd, CASE WHEN s.run_var > 0 THEN SQRT(s.run_var) ELSE 1.0 END), 4) AS std_value,
    f.m IS NOT NULL AS warmed_up
  FROM latest l JOIN series s ON s.user_id = l.user_id AND s.i = l.n
  LEFT JOIN scored f ON f.user_id = l.user_id AND f.i = l.n""")
def w4(spark, folder):
    rule = rule_set({**STATISTICAL, "min_samples": 10}).statistical[0]
    rows = feed(spark, folder).select("event_id", "user_id", "value")
    learned = baseline.learn_baseline(
        rows, "value", order=["event_id"], keys=["user_id"], min_samples=rule.min_samples
    )
    return baseline.baseline_snapshot(
        learned, TOPIC, rule, order=["event_id"], keys=["user_id"]
    ).drop("snapshot_at")


ALL_FOUND = f"""{FOUND}, {NULL_RATE_SQL}, {fold_sql('value', 100)}, every_found AS (
  SELECT {COLUMNS} FROM found UNION ALL {NULL_RATE_FOUND} UNION ALL {statistical_found('value_jump', 'value')})"""


@CATALOG.add("f9_concat_checks", f"WITH RECURSIVE {ALL_FOUND} SELECT {COLUMNS} FROM every_found")
def f9(spark, folder):
    return flat(plan(NULL_RATE, STATISTICAL).violations(feed(spark, folder)))


@CATALOG.add("u0a_union_violations", f"""WITH {FOUND}, {NULL_RATE_SQL} SELECT rule_name, COUNT(*) AS violations
  FROM (SELECT rule_name FROM found UNION ALL SELECT 'reading_gaps' FROM rated WHERE n >= 10 AND rate > 0.2)
  GROUP BY rule_name""")
def u0a(spark, folder):
    checks = plan(NULL_RATE)
    rows = feed(spark, folder)
    whole = checks.row_violations(rows)
    for part in checks.window_violations(rows):
        whole = whole.unionByName(part)
    return whole.groupBy("rule_name").agg(F.count(F.lit(1)).alias("violations"))
