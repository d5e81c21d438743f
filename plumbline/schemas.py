"""Schemas of the frames that pass between operators and into the store."""

from pyspark.sql import types as T

VIOLATION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("record_id", T.StringType()),
])

INCIDENT = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("violation_count", T.LongType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rule_names", T.ArrayType(T.StringType())),
    T.StructField("sample_violations", T.ArrayType(VIOLATION)),
])

RESULT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("suite_name", T.StringType()),
    T.StructField("expectation", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("total_records", T.LongType()),
    T.StructField("passed_records", T.LongType()),
    T.StructField("failed_records", T.LongType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("run_at", T.TimestampType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

VERDICT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("expectation", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("record_index", T.LongType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
])

BASELINE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("mean_value", T.DoubleType()),
    T.StructField("std_value", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("warmed_up", T.BooleanType()),
    T.StructField("snapshot_at", T.TimestampType()),
])

INCIDENT_EVENT = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("root_cause_table", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("proposed_fix", T.StringType()),
    T.StructField("sandbox_result", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

EDGE = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
])
