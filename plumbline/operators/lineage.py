"""Walking lineage upstream and naming the table an anomaly came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cycles import components
from plumbline.operators.profile import null_rate
from plumbline.session import stable

# Fixed value: null rate from which a table is suspect.
SUSPECT_NULL_RATE = 0.05

# Hops after which a closure without end is first looked for.
CYCLE_CHECK = 16
# Hops one join takes at most, and how many ways of a length there may be for each edge.
STRIDE = 16
WAYS = 2


def upstream(edges: DataFrame, roots: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(root, table, depth) of everything upstream of each root, the root itself left out.

    `depth` is the longest way down to the root, so an ancestor always lies
    deeper than what is built from it. One equi-join per hop; each hop keeps one
    row per (root, table), so the number of paths does not matter. Hops go on
    until one brings nothing new, or `max_depth` is reached. Tables on a common
    cycle count as one place: they share a depth.
    """
    pairs = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).distinct()
    level = roots.select("root", F.col("root").alias("table")).distinct()
    nothing = level.withColumn("depth", F.lit(0)).limit(0)
    if max_depth is not None:
        found = [nothing]
        for depth in range(1, max_depth + 1):
            level = _one_hop(level, pairs)
            found.append(level.withColumn("depth", F.lit(depth)))
        return _deepest(found)

    pairs = stable(pairs)
    return _unbounded(pairs, level, merge=lambda found: _merged(pairs, roots, found))


def _strides(pairs: DataFrame) -> tuple[list[DataFrame], bool]:
    """Ways of exactly 1, 2, 4 and up to `STRIDE` hops as (_src, _dst), and whether there are none of twice the last.

    Lengths double while the ways of one are few: wide lineage stays at single hops. Where each table is built from one
    other, no length has more ways than there are edges.
    """
    ways, edges = [pairs], pairs.count()
    while 1 << len(ways) <= STRIDE:
        far = ways[-1].select(F.col("_src").alias("_mid"), F.col("_dst").alias("_end"))
        near = ways[-1].withColumnRenamed("_dst", "_mid")
        longer = stable(near.join(far, "_mid").select("_src", F.col("_end").alias("_dst")).distinct())
        many = longer.count()
        if not many:
            return ways, True
        if many > WAYS * edges:
            break
        ways.append(longer)
    return ways, False


def _unbounded(pairs: DataFrame, level: DataFrame, merge) -> DataFrame:
    """Hops until there is nothing new.

    A pass takes the longest ways first: what is found so far goes on by so many hops, then by half as many, down to one.
    So every depth up to the sum of the lengths is reached once, and each length is joined once.
    """
    ways, whole = _strides(pairs)
    level = stable(level)
    found, depth, check = [level.withColumn("depth", F.lit(0)).limit(0)], 0, CYCLE_CHECK
    while True:
        parts = [level.withColumn("depth", F.lit(depth))]
        for i in reversed(range(len(ways))):
            near = reduce(DataFrame.unionByName, parts)
            far = near.join(ways[i], near["table"] == ways[i]["_dst"]).select(
                "root", F.col("_src").alias("table"), (F.col("depth") + (1 << i)).alias("depth"))
            parts.append(stable(far.distinct()))
        found += [part.where("root <> table") for part in parts[1:]]
        depth += (1 << len(ways)) - 1
        level = parts[-1].where(F.col("depth") == depth).select("root", "table")
        # Walks go on through a root, so those on or above a cycle never end.
        if whole or level.isEmpty():
            return _deepest(found)
        # No path without a repeat is longer than a root has ancestors: past that, it is a cycle.
        if depth >= check:
            ancestors = _deepest(found).groupBy("root").count().agg(F.max("count")).first()[0]
            if depth > (ancestors or 0):
                return merge(_deepest(found))
            check = 2 * depth


def _merged(pairs: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """Depths where there are cycles: the tables of each cycle are merged into one before hops are counted."""
    near = found.select("table").unionByName(roots.select(F.col("root").alias("table"))).distinct()
    inside = pairs.join(near.select(F.col("table").alias("_dst")), "_dst", "left_semi")
    cycles = components(inside.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    place = near.join(cycles, "table", "left").select("table", F.coalesce("place", "table").alias("place"))
    place = stable(place)

    def at(name: str, into: str) -> DataFrame:
        return place.select(F.col("table").alias(name), F.col("place").alias(into))

    edges = inside.join(at("_src", "_from"), "_src").join(at("_dst", "_to"), "_dst").where("_from <> _to")
    edges = stable(edges.select(F.col("_from").alias("_src"), F.col("_to").alias("_dst")).distinct())
    start = roots.select("root").distinct().join(at("root", "place"), "root")
    level = start.select(F.col("place").alias("root"), F.col("place").alias("table")).distinct()
    depths = _unbounded(edges, level, merge=lambda rest: rest).unionByName(level.withColumn("depth", F.lit(0)))
    spread = start.join(depths.withColumnsRenamed({"root": "place", "table": "_at"}), "place")
    spread = spread.join(place.withColumnsRenamed({"place": "_at"}), "_at").where("root <> table")
    # What shares a cycle with the root is one hop away, everything else lies beyond it.
    shared = F.max((F.col("depth") == 0).cast("int")).over(Window.partitionBy("root"))
    return spread.select("root", "table", (F.col("depth") + shared).alias("depth"))


def _one_hop(level: DataFrame, pairs: DataFrame) -> DataFrame:
    return (
        level.join(pairs, level["table"] == pairs["_dst"])
        .select("root", F.col("_src").alias("table"))
        .where(F.col("root") != F.col("table"))
        .distinct()
    )


def _deepest(levels: list[DataFrame]) -> DataFrame:
    whole = reduce(DataFrame.unionByName, levels)
    return whole.groupBy("root", "table").agg(F.max("depth").alias("depth"))


def walk_order(depth: Column, table: Column) -> Column:
    """Sort key: furthest ancestors first, names settle ties."""
    return F.struct((-depth).alias("nearness"), table.alias("table"))


def first_failing_column(tests: DataFrame, position: str, by: Sequence[str] = ()) -> DataFrame:
    """`column_name` of the first test that names a column, else empty; one row, or one per group."""
    named = F.col("column_name") != ""
    first = F.min_by(F.when(named, F.col("column_name")), F.when(named, F.col(position)))
    return tests.groupBy(*by).agg(F.coalesce(first, F.lit("")).alias("column_name"))


def null_rates(
    tables: Mapping[str, DataFrame], column: str, renamed: Mapping[str, str] | None = None
) -> DataFrame:
    """(table, null_rate) of one column in several tables; `renamed` gives its name elsewhere."""
    renamed = renamed or {}
    return reduce(DataFrame.unionByName, [
        null_rate(df, renamed.get(name, column)).select(F.lit(name).alias("table"), "null_rate")
        for name, df in tables.items()
    ])


def first_suspect(
    ancestors: DataFrame, rates: DataFrame, *, limit: float = SUSPECT_NULL_RATE
) -> DataFrame:
    """(root, root_cause_table): the furthest ancestor over the limit, else the root itself."""
    rated = ancestors.join(rates, "table", "left")
    suspect = F.when(F.col("null_rate") > limit, walk_order(F.col("depth"), F.col("table")))
    return rated.groupBy("root").agg(
        F.coalesce(F.min(suspect)["table"], F.first("root")).alias("root_cause_table")
    )


def trace_root_cause(
    edges: DataFrame,
    tables: Mapping[str, DataFrame],
    failing_table: str,
    failing_column: str,
    *,
    renamed: Mapping[str, str] | None = None,
    max_depth: int | None = None,
    limit: float = SUSPECT_NULL_RATE,
) -> DataFrame:
    """One row: where the nulls of a failing column first appeared.

    `tables` holds a frame per table of the lineage, by the name used in `edges`.
    """
    spark = edges.sparkSession
    root = spark.range(1).select(F.lit(failing_table).alias("root"))
    ancestors = upstream(edges, root, max_depth=max_depth)
    # The root stands among its ancestors, so that there is always a row to fall back to.
    ancestors = ancestors.unionByName(root.select("root", F.col("root").alias("table"), F.lit(0).alias("depth")))
    known = {k: v for k, v in tables.items() if k != failing_table}
    column = F.lit(failing_column).alias("root_cause_column")
    if not known or not failing_column:
        return root.select("root", F.col("root").alias("root_cause_table"), column)
    suspects = first_suspect(ancestors, null_rates(known, failing_column, renamed), limit=limit)
    return suspects.select("root", "root_cause_table", column)


def side_by_side(ancestors: DataFrame, profiles: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Profiles of the tables along a lineage, next to their place in it."""
    wanted = profiles.where(F.col("column_name").isin(list(columns))) if columns else profiles
    return ancestors.join(wanted, ancestors["table"] == wanted["table_name"]).drop("table_name")
