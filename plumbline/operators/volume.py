"""Record volume per interval, and alerts when a topic falls silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.baseline import z_scores

# Intervals filled in from one array.
STRETCH = 10_000


def volume_series(df: DataFrame, time_column: str, interval_seconds: int, topic: Column) -> DataFrame:
    """(topic, interval, records) without holes: intervals nothing arrived in count 0.

    `interval` is a running number of intervals since the epoch. The counts are
    map-side combined; what is filled in grows with time, not with records.
    """
    at = F.col(time_column).cast("timestamp")
    interval = F.floor(F.unix_micros(at) / (interval_seconds * 1_000_000))
    counted = df.groupBy(topic.alias("topic"), interval.alias("interval")).agg(
        F.count(F.lit(1)).alias("records")
    )
    spans = counted.groupBy("topic").agg(F.min("interval").alias("_a"), F.max("interval").alias("_b"))
    # In stretches, so that no array holds the whole time axis.
    starts = spans.select("topic", "_b", F.explode(F.sequence("_a", "_b", F.lit(STRETCH).cast("long"))).alias("_from"))
    ends = F.least(F.col("_b"), F.col("_from") + (STRETCH - 1))
    every = starts.select("topic", F.explode(F.sequence(F.col("_from"), ends)).alias("interval"))
    return every.join(counted, ["topic", "interval"], "left").fillna(0, ["records"])


def volume_drops(
    series: DataFrame, *, z_score_threshold: float = 3.0, min_samples: int = 10,
) -> DataFrame:
    """Intervals with far fewer records than the topic's baseline before them."""
    scored = z_scores(
        series, "records", keys=["topic"], order=["interval"], min_samples=min_samples,
        score="before_update",
    )
    low = (F.col("records") < F.col("mean_before")) & (F.col("z") > z_score_threshold)
    return scored.where(low).select("topic", "interval", "records", "mean_before", "std", "z")
