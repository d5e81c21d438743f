"""Embedding drift: how far the centre of a batch has moved from its baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import dot, norm
from plumbline.operators.baseline import learn_baseline

# Default limits, and the share of a new centroid in the baseline.
DRIFT_THRESHOLD = 0.15
LOOKBACK_DAYS = 7
BASELINE_SHARE = 0.1

MEASURES = ("cosine", "dot")


def text_vectors(df: DataFrame, text: str, into: str, dimensions: int = 1024) -> DataFrame:
    """Word counts hashed into `dimensions` buckets; a missing text counts as empty."""
    words = Tokenizer(inputCol="_text", outputCol="_words")
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions)
    filled = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    counted = hashed.transform(words.transform(filled))
    return counted.withColumn(into, vector_to_array("_counts")).drop("_text", "_words", "_counts")


def centroids(df: DataFrame, embedding: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the length-1 vectors and their number, per group.

    The summariser merges one vector per group and task, so no group meets in
    one task and rows are not multiplied by the dimension.
    """
    vectors = df.where(F.col(embedding).isNotNull()).select(
        *by, array_to_vector(F.col(embedding).cast("array<double>")).alias("_raw")
    )
    unit = Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(vectors)
    # A constant key where there is none: no input then means no row, not a failing mean.
    grouped = unit.groupBy(*by) if by else unit.groupBy(F.lit(0).alias("_all"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(F.col("_unit"))).alias("centroid"),
    ).select(*by, "n", "centroid")


def by_dimension(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and dimension: `vectors` in the group, `dim`, mean `c`."""
    return grouped.select(*by, F.col("n").alias("vectors"), F.posexplode("centroid").alias("dim", "c"))


def drift_columns(centroid: Column, baseline: Column) -> tuple[Column, Column]:
    """(1 - dot, 1 - cosine) of two centroids."""
    product = dot(centroid, baseline)
    lengths = norm(centroid) * norm(baseline)
    return 1.0 - product, 1.0 - F.when(lengths > 0, product / lengths)


def _drift_from_sums(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    """Drift per group from per-dimension pairs (c, b); null where there is no baseline."""
    summed = grouped.groupBy(*by).agg(
        F.max("vectors").alias("n"),
        F.sum(F.col("c") * F.col("b")).alias("_cb"),
        F.sum(F.when(F.col("b").isNotNull(), F.col("c") * F.col("c"))).alias("_cc"),
        F.sum(F.col("b") * F.col("b")).alias("_bb"),
    )
    lengths = F.sqrt(F.col("_cc") * F.col("_bb"))
    return summed.select(
        *by,
        "n",
        (1.0 - F.col("_cb")).alias("drift_dot"),
        (1.0 - F.when(lengths > 0, F.col("_cb") / lengths)).alias("drift_cosine"),
    )


def _judged(drifts: DataFrame, threshold: float, measure: str) -> DataFrame:
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    return drifts.withColumn(
        "passed", F.coalesce(F.col(f"drift_{measure}") <= threshold, F.lit(True))
    )


def drift_over_batches(
    df: DataFrame,
    embedding: str,
    batch: str,
    *,
    threshold: float = DRIFT_THRESHOLD,
    share: float = BASELINE_SHARE,
    measure: str = "cosine",
) -> DataFrame:
    """Each batch against the baseline the batches before it left behind.

    The first batch sets the baseline and passes; every batch then moves it by
    `share`. Each dimension of the baseline is a smoothed series over batches,
    so any number of batches runs on the ordered scan of `learn_baseline`.
    """
    dims = by_dimension(centroids(df, embedding, [batch]), [batch])
    learned = learn_baseline(
        dims, "c", keys=["dim"], order=[batch], min_samples=1, alpha=share
    ).withColumnRenamed("mean_before", "b")
    return _judged(_drift_from_sums(learned.select(batch, "vectors", "c", "b"), [batch]), threshold, measure)


def baseline_after_batches(
    df: DataFrame, embedding: str, batch: str, *, share: float = BASELINE_SHARE
) -> DataFrame:
    """The baseline centroid once every batch has moved it, per dimension."""
    dims = by_dimension(centroids(df, embedding, [batch]), [batch])
    learned = learn_baseline(dims, "c", keys=["dim"], order=[batch], min_samples=1, alpha=share)
    return learned.groupBy("dim").agg(F.max_by("mean", batch).alias("baseline"))


def drift_against_lookback(
    df: DataFrame,
    embedding: str,
    day: str,
    *,
    threshold: float = DRIFT_THRESHOLD,
    lookback_days: int = LOOKBACK_DAYS,
    measure: str = "cosine",
) -> DataFrame:
    """Each day against the centre of all vectors of the days before it, up to `lookback_days`.

    `day` is a whole number of days. The window sees one row per day and
    dimension, and is spread over the dimensions.
    """
    dims = by_dimension(centroids(df, embedding, [day]), [day])
    past = Window.partitionBy("dim").orderBy(day).rangeBetween(-lookback_days, -1)
    based = dims.withColumn("b", F.sum(F.col("c") * F.col("vectors")).over(past) / F.sum("vectors").over(past))
    return _judged(_drift_from_sums(based.select(day, "vectors", "c", "b"), [day]), threshold, measure)


def nearest_label(df: DataFrame, embedding: str, centres: DataFrame, label: str) -> DataFrame:
    """Adds `predicted`, the label whose centre points most nearly the same way, and its cosine.

    `centres` has one row per class, so it travels as one scalar value.
    """
    listed = centres.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid"))))
    vector = F.col(embedding)

    def closeness(centre: Column) -> Column:
        lengths = norm(vector) * norm(centre["centroid"])
        return F.struct(
            F.when(lengths > 0, dot(vector, centre["centroid"]) / lengths).alias("closeness"),
            centre["label"].alias("label"),
        )

    scored = df.withColumn("_centres", listed.scalar()).withColumn(
        "_best", F.array_max(F.transform("_centres", closeness))
    )
    return scored.select(
        *df.columns, F.col("_best.label").alias("predicted"), F.col("_best.closeness").alias("closeness")
    )


def word_frequencies(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """How often each word occurs in each batch: sparse, one row per word that does."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    words = df.select(*by, F.explode(found).alias("word"))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).cast("double").alias("frequency"))


def word_drift(batches: DataFrame, baseline: DataFrame, by: Sequence[str]) -> DataFrame:
    """1 - cosine of each batch's word frequencies to those of a baseline, by a join on the word."""
    known = baseline.select("word", F.col("frequency").alias("_known"))
    own = batches.join(known, "word", "left").groupBy(*by).agg(
        F.sum(F.col("frequency") * F.col("frequency")).alias("_squares"),
        F.coalesce(F.sum(F.col("frequency") * F.col("_known")), F.lit(0.0)).alias("_dot"),
    )
    length = known.agg(F.sum(F.col("_known") * F.col("_known"))).scalar()
    return own.select(*by, (F.lit(1) - F.col("_dot") / F.sqrt(F.col("_squares") * length)).alias("drift"))
