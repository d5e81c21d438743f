"""Strongly connected components of a directed graph, for lineage with cycles.

Two kinds of places are taken out first, in rounds that each shrink what is left: ends, which nothing leads into or
out of, and single steps, which one edge leads into and one out of. A step is bypassed by an edge between its
neighbours; no two neighbours go in the same round, so a ring or a chain of any length is gone in logarithmically many
rounds. A bypassed step shares a component with its neighbours exactly if these share one, which is settled last, in
the opposite order. What then remains is coloured: every place takes the largest name that reaches it, and those that
can reach the name's own place within their colour are its component. No table of reachable pairs is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stable


def _semi(left: DataFrame, column: str, right: DataFrame, its: str) -> DataFrame:
    return left.join(right.select(F.col(its).alias(column)).distinct(), column, "left_semi").select(*left.columns)


def _draw(name: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.col(name), F.lit(turn)), F.col(name))


def _stepped(edges: DataFrame, turn: int) -> DataFrame:
    """(step, before, after): places with one way in and one out, no two of them neighbours."""
    into = edges.groupBy(F.col("dst").alias("step")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("before"))
    out = edges.groupBy(F.col("src").alias("step")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("after"))
    steps = into.join(out, "step").where("ins = 1 AND outs = 1").select("step", "before", "after")
    for side in ("before", "after"):
        steps = steps.join(steps.select(F.col("step").alias(side), F.lit(True).alias(f"{side}_too")), side, "left")
    first = ~F.coalesce("before_too", F.lit(False)) | (_draw("step", turn) < _draw("before", turn))
    second = ~F.coalesce("after_too", F.lit(False)) | (_draw("step", turn) < _draw("after", turn))
    return steps.where(first & second).select("step", "before", "after")


def _shrunk(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges without ends and steps, and the steps taken out round by round."""
    history, size = [], edges.count()
    while size:
        steps = stable(_stepped(edges, len(history)))
        gone = steps.select("step")
        left = edges.join(gone, edges["src"] == gone["step"], "left_anti").join(gone, edges["dst"] == gone["step"], "left_anti")
        left = left.unionByName(steps.where("before <> after").select(F.col("before").alias("src"), F.col("after").alias("dst"))).distinct()
        left = _semi(_semi(left, "src", left, "dst"), "dst", left, "src")
        edges = stable(left)
        history.append(steps)
        if (now := edges.count()) == size:
            break
        size = now
    return edges, history


def _coloured(edges: DataFrame) -> DataFrame:
    """(table, place) of the components of a graph in which every place has ways in and out; one round per colour depth."""
    places = None
    while not edges.isEmpty():
        colours = stable(edges.select(F.col("src").alias("table")).unionByName(edges.select(F.col("dst").alias("table"))).distinct()
                         .withColumn("colour", F.col("table")))
        while True:
            reach = edges.join(colours, edges["src"] == colours["table"]).select(F.col("dst").alias("table"), F.col("colour").alias("its"))
            larger = reach.groupBy("table").agg(F.max("its").alias("its"))
            moved = colours.join(larger, "table", "left").withColumn("new", F.greatest("colour", F.coalesce("its", "colour")))
            moved = stable(moved.select("table", "colour", "new"))
            colours = moved.select("table", F.col("new").alias("colour"))
            if moved.where("new <> colour").isEmpty():
                break
        inside = edges.join(colours.withColumnsRenamed({"table": "src"}), "src")
        inside = inside.join(colours.withColumnsRenamed({"table": "dst", "colour": "its"}), "dst").where("colour = its")
        inside = stable(inside.select("src", "dst", "colour"))
        found = front = stable(colours.where("table = colour"))
        while not front.isEmpty():
            back = inside.join(front.select(F.col("table").alias("dst")), "dst").select(F.col("src").alias("table"), "colour").distinct()
            front = stable(back.join(found.select("table"), "table", "left_anti"))
            found = stable(found.unionByName(front))
        new = found.select("table", F.col("colour").alias("place"))
        places = new if places is None else places.unionByName(new)
        taken = found.select("table")
        left = inside.join(taken, inside["src"] == taken["table"], "left_anti").join(taken, inside["dst"] == taken["table"], "left_anti")
        edges = stable(left.select("src", "dst"))
    return places


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (table, place) of every table on a cycle; equal places lie on common cycles."""
    loose = stable(edges.select("src", "dst").where("src <> dst").distinct())
    core, history = _shrunk(loose)
    known = _coloured(core)
    if known is None:
        known = loose.select(F.col("src").alias("table"), F.col("src").alias("place")).limit(0)
    known = stable(known)
    for steps in reversed(history):
        at = lambda side: known.select(F.col("table").alias(side), F.col("place").alias(f"{side}_place"))  # noqa: B023, E731
        told = steps.join(at("before"), "before", "left").join(at("after"), "after", "left")
        told = told.withColumn("before_place", F.coalesce("before_place", "before")).withColumn("after_place", F.coalesce("after_place", "after"))
        same = told.where("before_place = after_place")
        both = same.select(F.col("step").alias("table"), F.col("before_place").alias("place")).unionByName(
            same.select(F.col("before").alias("table"), F.col("before_place").alias("place")))
        known = stable(known.unionByName(both).distinct())
    sizes = known.groupBy("place").agg(F.min("table").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(sizes, "place").select("table", F.col("first").alias("place"))
