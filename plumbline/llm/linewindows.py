"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed (96 bits). The first place of each window in the whole table, by
(doc_id, line), stays; at every later place the three lines are covered, covered lines are merged into runs, and the
runs are cut out of the text. Windows are reduced to their first place before anything is joined; the join that
tells every place whether it is the first one has one row per window on its other side, so a window in a third of
all documents is only split (adaptive skew join), never multiplied.

Defined results: documents of fewer than three lines, and null texts, stay as they are. Windows of three blank lines
do not count. Null ids come last. Rows equal in id and text are one place, so both stay. Other rows are told apart
by id and text together. A text all of whose lines are covered becomes empty. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import packed, unpacked

SPAN = 3

_WINDOWS = f"""filter(
    transform(sequence(0, greatest(size(lines) - {SPAN}, 0)), i -> named_struct('at', i,
        'one', xxhash64(get(lines, i), get(lines, i + 1), get(lines, i + 2)),
        'two', hash(get(lines, i), get(lines, i + 1), get(lines, i + 2)),
        'blank', trim(concat(get(lines, i), get(lines, i + 1), get(lines, i + 2))) = '')),
    w -> size(lines) >= {SPAN} AND NOT w.blank)"""

#: Runs of lines between the covered ones: from the end of a window to the start of the next that leaves a gap.
_GAPS = f"""filter(transform(sequence(0, size(starts)), k -> named_struct(
        'low', if(k = 0, 0, get(starts, k - 1) + {SPAN}),
        'high', if(k = size(starts), size(lines), get(starts, k)))),
    g -> g.low < g.high)"""


def _lines(docs: DataFrame) -> DataFrame:
    return packed(docs, doc_id=F.col("doc_id"), mark=F.xxhash64("text"), lines=F.split("text", "\n"))


def later_places(docs: DataFrame) -> DataFrame:
    """doc_id, mark, starts: the lines at which windows begin that occurred before, per document that has any."""
    places = _lines(docs).select("doc_id", "mark", F.explode(F.expr(_WINDOWS)).alias("w"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", F.col("w.at").alias("at"))
    places = places.select("doc_id", "mark", F.col("w.one").alias("one"), F.col("w.two").alias("two"), place.alias("place"))
    firsts = places.groupBy("one", "two").agg(F.min("place").alias("first"), F.max("place").alias("end"))
    firsts = firsts.where("first <> end").select("one", "two", "first")
    later = places.join(firsts, ["one", "two"]).where("NOT (place <=> first)")
    return later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("place.at")).alias("starts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The input with shorter texts, and n_lines and n_removed; `n_chars`, where there is one, follows the text."""
    found = later_places(docs).select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), "starts")
    rows = _lines(docs).join(found, F.expr("doc_id <=> its_id AND mark = its_mark"), "left")
    rows = rows.withColumn("gaps", F.when(F.col("starts").isNotNull(), F.expr(_GAPS)))
    remaining = F.expr("flatten(transform(gaps, g -> slice(lines, g.low + 1, g.high - g.low)))")
    rows = rows.withColumn("left_over", F.when(F.col("gaps").isNotNull(), remaining))
    text = F.coalesce(F.array_join("left_over", "\n"), F.col("row.text"))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    removed = F.coalesce(n_lines - F.size("left_over"), F.lit(0))
    lengths = {"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {}
    return unpacked(rows, text=text, **lengths, n_lines=F.when(F.col("lines").isNull(), 0).otherwise(n_lines),
                    n_removed=F.when(F.col("starts").isNull(), 0).otherwise(removed))
