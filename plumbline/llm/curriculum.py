"""Mixing sources to target weights along a curriculum that changes over training time.

Every source has a weight and a schedule. The weights share out a number of words (`share` times all words); no
source gives more than `epochs` passes, and what it cannot give goes to the others by weight. The schedule says how
a source's weight moves between the start (time 0) and the end (time 1) of training. Its integral is the source's
cumulative demand for words; the documents of a source lie on that demand one after the other in a drawn order, and
inverting the integral at a document's first word gives its position in training. Documents are range-sorted by it.

Nothing is collected. Sources are summed per (source, cell of the draw) with map-side combine, so a source with a
third of all rows is spread over 65,536 cells; offsets of cells come from windows of at most 256 rows.

Defined results: a null text has size 0; a null source is a source of its own, last in rank; a null or repeated
doc_id is only a label (the draw also hashes the text); rows of size 0 get no words; an empty table gives no rows.
Ties in the draw (equal id and text) are interchangeable. Input columns with names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import SPACE, kept, packed, unpacked

FINE, COARSE = 1 << 16, 1 << 8


@dataclass(frozen=True)
class Curriculum:
    """Weights go round the sources in code-point order; so do the schedules (weight multipliers at even times)."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    schedules: tuple[tuple[float, ...], ...] = ((0.5, 1.0, 1.5), (1.5, 1.0, 0.5), (1.0, 1.0))
    share: float = 1.5
    epochs: int = 2
    seed: int = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _round_robin(rank: Column, values: tuple) -> Column:
    choice = F.lit(values[0])
    for i, value in enumerate(values[1:], 1):
        choice = F.when(rank % len(values) == i, F.lit(value)).otherwise(choice)
    return choice


def invert(fraction: Column, knots: tuple[float, ...]) -> Column:
    """The time by which a share of a source's words is due, for weights linear between evenly spaced knots."""
    step = 1.0 / (len(knots) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, time = sum(areas), 0.0, None
    for i, (low, high) in enumerate(zip(knots, knots[1:], strict=False)):
        due = F.greatest(fraction * total - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(low * low) + 2 * (high - low) / step * due, F.lit(0.0)))
        within = F.when(due <= 0, F.lit(0.0)).otherwise(2 * due / (F.lit(low) + root))
        here = F.lit(i * step) + F.least(within, F.lit(step))
        time = here if time is None else F.when(fraction * total > done, here).otherwise(time)
        done += areas[i]
    return time


def targets(sources: DataFrame, plan: Curriculum) -> DataFrame:
    """`source`, `source_size` -> also `rank` and `target`: levels of equal words per weight, capped per source.

    One row per source goes through one task: sources are the entries of a mixing plan, not data.
    """
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", _round_robin(F.col("rank"), plan.weights))
    cap = F.col("source_size") * F.lit(float(plan.epochs))
    ranked = ranked.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = W.orderBy("full_at", "rank")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    every = F.sum("source_size").over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (F.lit(plan.share) * every - before) / open_weight
    fits = ranked.withColumn("level", level)
    fits = fits.withColumn("level", F.when(F.col("level") <= F.col("full_at"), F.col("level")))
    first = F.first("level", ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    fits = fits.withColumn("target", F.coalesce(F.least("cap", first * F.col("weight")), F.col("cap")))
    return fits.select("source", "source_size", "rank", "target")


def planned(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """One row per document: `row` with its columns, size, source_size, target, before (words of the source drawn
    ahead of it), taken (words the mix takes over all passes) and position (time of its first word, null if none)."""
    drawn = F.md5(F.concat_ws(":", F.lit(plan.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=word_count(F.col("text")), draw=drawn)
    rows = rows.withColumn("cell", F.conv(F.substring("draw", 1, 4), 16, 10).cast("int"))
    cells = kept(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    cells = cells.withColumn("part", F.floor(F.col("cell") / COARSE).cast("int"))
    parts = cells.groupBy("source", "part").agg(F.sum("words").alias("words"))
    ahead = lambda *by: F.coalesce(F.sum("words").over(
        W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("source", "part", ahead("source", "part").alias("part_ahead"))
    parts = parts.withColumnsRenamed({"source": "part_source", "part": "part_at"})
    offsets = cells.withColumn("cell_ahead", ahead("source", "part", "cell"))
    offsets = offsets.join(parts, F.expr("source <=> part_source AND part = part_at"))
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), plan)
    sources = sources.withColumnRenamed("source", "its_source")
    offsets = offsets.join(sources, F.expr("source <=> its_source")).select(
        F.col("source").alias("key"), F.col("cell").alias("at"), "source_size", "rank", "target",
        (F.col("part_ahead") + F.col("cell_ahead")).alias("ahead"))
    inside = W.partitionBy("source", "cell").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.expr("source <=> key AND cell = at")).withColumn("before", F.col("ahead") + F.col("inside"))
    due = F.floor(F.col("target") + 0.5)
    taken = sum((take(due, n) for n in range(plan.epochs)), F.lit(0)).cast("long")
    time = _per_rank(F.try_divide("before", "target"), plan)
    return rows.select("row", "doc_id", "draw", "rank", "size", "source_size", "target", "before", taken.alias("taken"),
                       F.when(taken > 0, time).alias("position"))


def take(due: Column, epoch: int) -> Column:
    """Words of a document that pass number `epoch` still needs."""
    left = due - F.col("source_size") * epoch - F.col("before")
    return F.greatest(F.lit(0), F.least(left, F.col("size")))


def _per_rank(fraction: Column, plan: Curriculum) -> Column:
    time = invert(fraction, plan.schedules[0])
    for i, knots in enumerate(plan.schedules[1:], 1):
        time = F.when(F.col("rank") % len(plan.schedules) == i, invert(fraction, knots)).otherwise(time)
    return time


def training_order(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The mix itself: one row per copy taken (document columns, epoch, size, taken, position), sorted by position.

    The last document of a source is cut: of its copy only the first `taken` words belong to the mix.
    """
    rows = planned(docs, plan).where("taken > 0")
    rows = rows.withColumn("epoch", F.explode(F.array(*[F.lit(n) for n in range(plan.epochs)])))
    due = F.floor(F.col("target") + 0.5)
    left = due - F.col("source_size") * F.col("epoch") - F.col("before")
    rows = rows.withColumn("copy", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long")).where("copy > 0")
    at = _per_rank(F.try_divide(F.col("source_size") * F.col("epoch") + F.col("before"), "target"), plan)
    rows = rows.withColumn("position", at).orderBy("position", "draw", "epoch")
    return unpacked(rows, epoch=F.col("epoch"), size=F.col("size"), taken=F.col("copy"), position=F.col("position"))
