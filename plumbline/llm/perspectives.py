"""Chat formatting: every dialogue once from the point of view of each participant.

For each role that speaks in a conversation, its turns become the assistant's and carry the training mask; all other
turns are shown as users named by role. Roles in `system` speak for nobody: they are shown as system turns and get no
perspective. A rendered dialogue comes in pieces of at most `turns` turns, so no row grows with a conversation.

Turns are numbered without a window over a conversation: rows are range-partitioned and sorted by (conversation,
turn, role, text) into blocks, blocks are counted, and counts of earlier blocks are added. A conversation with a third of all
turns is spread over many blocks; what grows with the result is only the product with its participants that is asked for.

Defined results: a null role is the participant "unknown", a null text is empty, null conversation ids are one
conversation, null turns come last; ties in the turn number go by role, then text; repeated rows are repeated turns.
Marks inside texts and names are broken by a blank, so masks cannot be forged. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import kept
from plumbline.session import prepare


@dataclass(frozen=True)
class Format:
    turns: int = 64
    system: tuple[str, ...] = ("system",)
    end: str = "<|end|>\n"
    rows_per_block: int = 50_000


FORMAT = Format()


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def numbered(turns: DataFrame, form: Format = FORMAT) -> DataFrame:
    """conv_id, role, text, number: the place of each turn in its conversation, from 0."""
    rows = turns.select("conv_id", F.col("turn").alias("at"), F.coalesce("role", F.lit("unknown")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("at").asc_nulls_last(), F.col("role"), F.col("text")]
    blocks = max(1, -(-turns.count() // form.rows_per_block))
    rows = rows.repartitionByRange(max(blocks, 1), *order, F.xxhash64("text")).sortWithinPartitions(*order)
    rows = kept(rows.withColumn("block", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "turns")
    counts = rows.groupBy("block", "conv_id").count()
    ahead = F.sum("count").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("block").alias("its_block"), F.col("conv_id").alias("its_id"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("block", "conv_id").orderBy("row")) - 1
    rows = rows.withColumn("inside", inside).join(counts, F.expr("block = its_block AND conv_id <=> its_id"))
    return rows.select("conv_id", "role", "text", (F.col("ahead") + F.col("inside")).alias("number"))


def perspectives(turns: DataFrame, form: Format = FORMAT) -> DataFrame:
    """conv_id, participant, piece, n_turns, n_masked, text, masks (start and end of each masked stretch)."""
    prepare(turns.sparkSession)
    rows = kept(numbered(turns, form), "numbered")
    people = rows.where(~F.col("role").isin(*form.system)).select(F.col("conv_id").alias("its_id"), F.col("role").alias("participant")).distinct()
    piece = F.floor(F.col("number") / form.turns).cast("int")
    turn = F.struct("number", "role", _safe(F.col("text")).alias("body"), _safe(F.regexp_replace("role", r"[\s|<>]", "_")).alias("name"))
    pieces = rows.groupBy("conv_id", piece.alias("piece")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    both = pieces.join(people, F.expr("conv_id <=> its_id"))
    mine = lambda t: t["role"] == F.col("participant")
    head = lambda t: F.when(mine(t), "<|assistant|>\n").when(t["role"].isin(*form.system), "<|system|>\n").otherwise(
        F.concat(F.lit("<|user name="), t["name"], F.lit("|>\n")))
    shown = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["body"], F.lit(form.end)).alias("tail"), mine(t).alias("mine")))
    both = both.select("conv_id", "participant", "piece", shown.alias("shown"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))
    step = lambda a, t: F.struct(
        (a["at"] + F.length(t["head"]) + F.length(t["tail"])).alias("at"),
        F.when(t["mine"], F.array_append(a["masks"], F.struct((a["at"] + F.length(t["head"])).alias("start"),
               (a["at"] + F.length(t["head"]) + F.length(t["tail"])).alias("end")))).otherwise(a["masks"]).alias("masks"))
    text = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["tail"])), "")
    masks = F.aggregate("shown", start, step)["masks"]
    return both.select("conv_id", "participant", "piece", F.size("shown").alias("n_turns"), F.size(masks).alias("n_masked"),
                       text.alias("text"), masks.alias("masks"))
