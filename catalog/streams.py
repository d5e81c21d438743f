"""Streams (S4, T1-T7): the event feed split into files, run to the end, and read back.

A streaming run must give the rows the batch query gives, so both share one SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import CATALOG
from catalog.frames import COLUMNS, FEED, FOUND, NULL_RATE, STATISTICAL, feed, flat, rule_set
from catalog.sessions import GAP, SESSIONS
from catalog.stores import new_store
from catalog.windows import ALL_FOUND, NULL_RATE_FOUND, NULL_RATE_SQL, fold_sql, statistical_found
from plumbline.operators import rowchecks
from plumbline.session import scratch_path
from plumbline.sources import topic
from plumbline.streaming import bursts, checks, sessions, source
from plumbline.streaming.state import state_settings

#: Micro-batches the feed comes in, and rows of one of its files.
PARTS, ROWS_PER_FILE = 5, 250_000
#: Rows of a micro-batch on average, where one task holds all of them: a longer feed comes in more of them.
ROWS_PER_BATCH = 1_000_000
#: State partitions of the queries here.
STATE_PARTS = 4


def arriving(rows, path, part, *, write="parquet"):
    """Write rows part by part, as a file stream takes files in the order they were changed; files of one part.

    `part` numbers the parts from 0. Every part has the same number of files, bounded in rows.
    """
    files = max(1, -(-rows.count() // (PARTS * ROWS_PER_FILE)))
    for i in range(PARTS):
        rows.where(part == i).drop("_part").repartition(files).write.mode("append").format(write).save(path)
    return files


def fifths(rows):
    """Which fifth of the event ids a row belongs to."""
    highest = rows.agg(F.max("event_id")).first()[0] + 1
    return F.floor(F.col("event_id") * PARTS / highest)


def arriving_bounded(rows, path, columns, *, write="parquet"):
    """Write `columns` of the rows in order of `event_id`, in as many parts as keep each near `ROWS_PER_BATCH`; files of one part.

    Columns may be expressions: rows are counted and cut by their ids before any is made.
    Parts are cut where the ids are, whatever gaps they have. Rows are laid out by part once, so many parts are not many scans.
    """
    parts = max(PARTS, -(-rows.count() // ROWS_PER_BATCH))
    cuts = rows.agg(F.percentile_approx("event_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("event_id"))) if cuts else F.lit(0)
    staged, files = scratch_path(rows.sparkSession, "parts"), 1 if parts == PARTS else -(-ROWS_PER_BATCH // ROWS_PER_FILE)
    rows.select(*columns, part.alias("_part")).repartition("_part").write.partitionBy("_part").parquet(staged)
    schema = T.StructType([*rows.select(*columns).schema, T.StructField("_part", T.IntegerType())])
    laid = rows.sparkSession.read.schema(schema).parquet(staged)
    for i in range(parts):
        laid.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").format(write).save(path)
    return files


def feed_stream(spark, folder, part=None):
    rows, path = feed(spark, folder), scratch_path(spark, "feed")
    files = arriving(rows, path, fifths(rows) if part is None else part(fifths(rows)))
    return source.file_source(spark, path, rows.schema, files_per_batch=files)


def bounded_stream(spark, folder):
    """The feed in micro-batches of bounded size."""
    rows, path = feed(spark, folder), scratch_path(spark, "feed")
    return source.file_source(spark, path, rows.schema, files_per_batch=arriving_bounded(rows, path, rows.columns))


def to_the_end(stream, name, *, mode="append", checkpoint=None, out=None):
    """Run a stream over everything there is into a Parquet folder; the folder's rows and the query."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)
    with state_settings(spark, STATE_PARTS):
        query = (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
            .option("path", out).trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


@CATALOG.add("s4_stream_source_json", """SELECT event_type, COUNT(*) AS records FROM (SELECT CASE
    WHEN event_id % 9 = 0 OR event_id % 10 = 0 OR event_id % 12 = 0 THEN 'malformed' ELSE event_type END AS event_type
  FROM events) GROUP BY event_type""")
def s4(spark, folder):
    """Records as JSON lines; some are cut short, some are arrays, some are bare numbers."""
    rows = feed(spark, folder)
    key = F.col("event_id")
    good = F.to_json(F.struct("id", "event_type", "value"))
    raw = F.when(key % 9 == 0, F.substring(good, 1, 20)).when(key % 10 == 0, F.lit("[1, 2]")).when(
        key % 12 == 0, F.lit("17")).otherwise(good)
    path = scratch_path(spark, "json-lines")
    rows.select(raw.alias("value")).repartition(PARTS).write.text(path)
    stream = source.file_source(spark, path, "value string", format="text", files_per_batch=1)
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    records, malformed = source.decode(stream.withColumnRenamed("value", "raw"), schema)
    kinds = records.select("event_type").unionByName(malformed.select(F.lit("malformed").alias("event_type")))
    return to_the_end(kinds, "decoded")[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("records"))


@CATALOG.add("t1_stream_validate", f"WITH {FOUND} SELECT {COLUMNS} FROM found")
def t1(spark, folder):
    stream = checks.stream_violations(feed_stream(spark, folder), rule_set(), time_column="ts")
    return flat(to_the_end(stream, "violations")[0])


@CATALOG.add("k1_topic_messages", f"""WITH {FOUND} SELECT record_id AS key, COUNT(*) AS violations FROM found GROUP BY record_id""")
def k1_topic(spark, folder):
    """Offending records published to a topic without a broker, and read back from it as a stream."""
    path, checkpoint = scratch_path(spark, "topic"), scratch_path(spark, "topic-checkpoint")
    messages = rowchecks.violation_messages(feed_stream(spark, folder), rule_set(), time_column="ts")
    topic.topic_sink(messages, path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    read, _ = to_the_end(topic.topic_source(spark, path, "earliest"), "topic-read")
    return read.select("key", F.size(F.from_json("value", "array<struct<rule_name string>>")).cast("long").alias("violations"))


def _checked(spark, folder, rules, **options):
    store = new_store(spark)
    checks.run_checks(
        bounded_stream(spark, folder), rules, store, scratch_path(spark, "checks"),
        order=["event_id"], time_column="ts", state_parts=STATE_PARTS, **options,
    ).awaitTermination()
    return store


@CATALOG.add("t2_stream_null_rate", f"WITH {FEED}, {NULL_RATE_SQL} {NULL_RATE_FOUND}")
def t2(spark, folder):
    rules = rule_set(NULL_RATE)
    only = type(rules)(rules.topic, rules.of("null_rate"))
    return flat(_checked(spark, folder, only).violations())


@CATALOG.add("t2_stream_null_rate_keyed", f"""WITH {FEED}, rated AS (
    SELECT id, AVG(CASE WHEN reading IS NULL THEN 1.0 ELSE 0.0 END) OVER w AS rate, COUNT(*) OVER w AS n
    FROM feed WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
  SELECT id AS record_id, CAST(ROUND(rate, 4) AS VARCHAR) AS value FROM rated WHERE n >= 10 AND rate > 0.2""")
def t2_keyed(spark, folder):
    """A rolling null rate for every user, in the state store."""
    rules = rule_set(NULL_RATE)
    only = type(rules)(rules.topic, rules.of("null_rate"))
    return _checked(spark, folder, only, keys=["user_id"]).violations().select("record_id", "value")


@CATALOG.add("t3_stream_baseline",
             f"WITH RECURSIVE {FEED}, {fold_sql('value', 100)} {statistical_found('value_jump', 'value')}")
def t3(spark, folder):
    rules = rule_set(STATISTICAL)
    only = type(rules)(rules.topic, rules.statistical)
    return flat(_checked(spark, folder, only).violations())


@CATALOG.add("t3_stream_baseline_keyed", f"""WITH RECURSIVE {FEED}, {fold_sql('value', 10, 'user_id')}
  SELECT id AS record_id, ROUND(ABS(x - m) / sd, 3) AS z_score FROM scored WHERE ABS(x - m) / sd > 3.0""")
def t3_keyed(spark, folder):
    rules = rule_set({**STATISTICAL, "min_samples": 10})
    only = type(rules)(rules.topic, rules.statistical)
    return _checked(spark, folder, only, keys=["user_id"]).violations().select("record_id", "z_score")


@CATALOG.add("t6_json_stream_job", f"""WITH RECURSIVE {ALL_FOUND}
  SELECT rule_name, record_id, COUNT(*) AS messages FROM every_found GROUP BY ALL""")
def t6_json(spark, folder):
    """JSON lines, some of them broken, decoded, checked by all rules, stored and published as messages."""
    rows, path, sent = feed(spark, folder), scratch_path(spark, "json-feed"), scratch_path(spark, "messages")
    whole = F.to_json(F.struct(*rows.columns))
    # Every 50th record is sent a second time, cut short.
    lines = F.explode(F.when(F.col("event_id") % 50 == 0, F.array(whole, F.substring(whole, 1, 25))).otherwise(F.array(whole)))
    files = arriving_bounded(rows, path, [lines.alias("value")], write="text")
    stream = source.file_source(spark, path, "value string", format="text", files_per_batch=files)
    records, _ = source.decode(stream.withColumnRenamed("value", "raw"), rows.schema, typed=["event_id", "ts"])
    checks.run_checks(
        records, rule_set(NULL_RATE, STATISTICAL), new_store(spark), scratch_path(spark, "checks"),
        order=["event_id"], time_column="ts", state_parts=STATE_PARTS,
        messages=lambda found, batch: found.write.mode("overwrite").parquet(f"{sent}/batch={batch}"),
    ).awaitTermination()
    read = F.from_json("value", "array<struct<rule_name string, record_id string>>")
    each = spark.read.schema("key string, value string").parquet(sent).select(F.inline(read))
    return each.groupBy("rule_name", "record_id").agg(F.count(F.lit(1)).alias("messages"))


@CATALOG.add("t6_stream_job", f"""WITH RECURSIVE {ALL_FOUND}
  SELECT rule_name, severity, COALESCE(value, '') AS value, record_id FROM every_found""")
def t6(spark, folder):
    """All five rule types of one topic in one streaming query, stored per micro-batch."""
    store = _checked(spark, folder, rule_set(NULL_RATE, STATISTICAL))
    return store.violations().select("rule_name", "severity", "value", "record_id")


@CATALOG.add("t6_stored_baseline", f"""WITH RECURSIVE {FEED}, {fold_sql('value', 100)}
  SELECT 'value_jump' AS rule_name, i AS sample_count, ROUND(m, 4) AS mean_value, ROUND(sd, 4) AS std_value,
    TRUE AS warmed_up FROM scored ORDER BY i DESC LIMIT 1""")
def t6_baseline(spark, folder):
    store = _checked(spark, folder, rule_set(STATISTICAL))
    return store.baselines().select("rule_name", "sample_count", "mean_value", "std_value", "warmed_up")


def _violation_stream(spark, folder, part=None):
    return checks.stream_violations(feed_stream(spark, folder, part), rule_set(), time_column="ts")


RULE_NAMES = ("device_present", "speed_in_range", "known_type")
INCIDENTS = f"""WITH {SESSIONS} SELECT "column", first_us, last_us, violation_count, severity, rules
  FROM sessions JOIN rule_order USING (topic, "column", session)"""


def _incident_view(folded):
    return folded.select(
        "column", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"),
        "violation_count", "severity", F.array_join("rule_names", ",").alias("rules"),
    )


@CATALOG.add("t4_stream_sessions", f"""{INCIDENTS} WHERE last_us + {GAP} * 1000000 <= (SELECT MAX(at_us) FROM found)""")
def t4(spark, folder):
    """Closed incidents only: the watermark has passed their last violation by the gap."""
    found = _violation_stream(spark, folder)
    return _incident_view(to_the_end(sessions.stream_incidents(found, RULE_NAMES, gap_seconds=GAP), "incidents")[0])


def straggling(part):
    """Arrival in which every 40th event comes one micro-batch late, and every 97th two."""
    key = F.col("event_id")
    return F.least(part + F.when(key % 97 == 5, 2).when(key % 40 == 7, 1).otherwise(0), F.lit(PARTS - 1))


ARRIVALS = f"""WITH {FOUND}, arrived AS (
    SELECT f.*, LEAST(FLOOR(CAST(record_id AS BIGINT) * {PARTS} / (SELECT MAX(event_id) + 1 FROM events))
      + CASE WHEN CAST(record_id AS BIGINT) % 97 = 5 THEN 2 WHEN CAST(record_id AS BIGINT) % 40 = 7 THEN 1 ELSE 0 END, {PARTS - 1}) AS part
    FROM found f),
  highest AS (SELECT part, MAX(at_us) // 1000 * 1000 AS top FROM arrived GROUP BY part),
  behind AS (SELECT part, MAX(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM highest),
  late AS (SELECT a.*, at_us < watermark AS is_late FROM arrived a JOIN behind USING (part))"""


def _bursts(spark, folder, part=None):
    """Everything that comes out of the stream until its input has ended; late rows by micro-batch."""
    ends, checkpoint, out = (scratch_path(spark, name) for name in ("ends", "bursts-checkpoint", "bursts"))
    stream = bursts.stream_bursts(
        _violation_stream(spark, folder, part), ends=bursts.markers(spark, ends), gap_seconds=GAP)
    _, first = to_the_end(stream, "bursts", checkpoint=checkpoint, out=out)
    bursts.end_input(spark, ends, "2999-01-01")
    rows, last = to_the_end(stream, "bursts", checkpoint=checkpoint, out=out)
    return rows, bursts.late_counts([*first.recentProgress, *last.recentProgress])


@CATALOG.add("t4_late_rows", f"""{ARRIVALS} SELECT rule_name, record_id, severity, at_us FROM late WHERE is_late""")
def t4_late(spark, folder):
    """Violations behind the watermark, kept to the side."""
    rows = bursts.late_rows(_bursts(spark, folder, straggling)[0])
    return rows.select("rule_name", "record_id", "severity", F.unix_micros("timestamp").alias("at_us"))


@CATALOG.add("t4_late_counts", f"""{ARRIVALS} SELECT CAST(part AS BIGINT) AS batch, COUNT(*) FILTER (WHERE is_late) AS late_rows
  FROM late GROUP BY part HAVING late_rows > 0""")
def t4_counts(spark, folder):
    """Late rows of every micro-batch, as the query's progress counts them."""
    _, counts = _bursts(spark, folder, straggling)
    return spark.createDataFrame([(b, n) for b, n in counts.items() if n], "batch long, late_rows long")


@CATALOG.add("t5_flush_all", INCIDENTS)
def t5(spark, folder):
    """All incidents out of the stream itself: the end of input closes what is still open."""
    return _incident_view(bursts.closed(_bursts(spark, folder)[0]))


@CATALOG.add("t7_stream_timeline", f"""WITH {FOUND} SELECT at_us // 3600000000 AS hour, severity, COUNT(*) AS violations
  FROM found GROUP BY ALL""")
def t7(spark, folder):
    """The stream's own intervals, and those still open at the end of input."""
    from catalog.frames import found

    stream = sessions.stream_timeline(_violation_stream(spark, folder), interval="1 hour")
    counted, _ = to_the_end(stream, "timeline")
    counted = counted.unionByName(sessions.flush_timeline(found(spark, folder), counted, interval="1 hour"))
    return counted.select((F.unix_seconds("minute") / 3600).cast("long").alias("hour"), "severity", "violations")
