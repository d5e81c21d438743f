"""Streams of JSON records: from Kafka, or from a folder new files appear in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: topic that violations are published to.
VIOLATIONS_TOPIC = "dq-violations"


def kafka_source(spark: SparkSession, bootstrap: str, topic: str, **options: str) -> DataFrame:
    """(raw, arrived_at) of a topic, from its latest records on. Needs Spark's Kafka connector."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .options(**options)
        .load()
    )
    return stream.select(F.col("value").cast("string").alias("raw"), F.col("timestamp").alias("arrived_at"))


def file_source(
    spark: SparkSession, folder: str, schema: T.StructType | str, *, format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def is_record(raw: Column) -> Column:
    """Whether a text is a JSON object; broken JSON, arrays and scalars are not."""
    # What is valid as a whole and opens with a brace is an object; its schema need not be made out.
    return F.coalesce(raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull(), F.lit(False))


def decode(
    raw: DataFrame, schema: T.StructType, raw_column: str = "raw", *, typed: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(records, malformed) of a frame of JSON texts.

    Every field of `schema` is read as text: a field that does not fit its type
    has to reach the rules as it is, not as null. Fields that only order or key records,
    `typed`, get their type instead: as text, 10 would come before 9. The fields are generated,
    so that a filter on them stays behind the parsing and does not parse again for each field it names.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    kept = [c for c in raw.columns if c != raw_column]
    ok = is_record(F.col(raw_column))
    fields = [
        (F.col(f"_r.`{f.name}`").try_cast(f.dataType) if f.name in typed else F.col(f"_r.`{f.name}`")).alias(f.name)
        for f in schema
    ]
    parsed = F.explode(F.array(F.from_json(raw_column, as_text))).alias("_r")
    records = raw.where(ok).select(*kept, parsed).select(*kept, *fields)
    return records, raw.where(~ok)


def kafka_sink(messages: DataFrame, bootstrap: str, topic: str = VIOLATIONS_TOPIC):
    """A writer of (key, value) messages to a topic; start it with a checkpoint location."""
    return (
        messages.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("topic", topic)
    )
