"""A training corpus out of `documents`, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read again as
the next one's input. All stages but the last return the columns of `documents`.

1. quality: documents that the classifier scores below 0.7 go; labels come from `labels`, held-out ids are not read.
2. lines: repeated windows of three lines are cut out; a document none of whose lines is left goes.
3. near_duplicates: of each group of documents whose fingerprints of four-word shingles are linked at four or fewer
   of 64 bits, one stays.
4. decontamination: documents that hold a benchmark item go.
5. mix: sources are mixed to target weights over a curriculum; one row per copy taken, in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import anchors, curriculum, decontaminate, linewindows, quality
from plumbline.llm.common import kept
from plumbline.session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linewindows.without_repeats(docs)
    return done.where("n_removed = 0 OR n_removed < n_lines").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return anchors.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.training_order(docs)


STAGES = [
    ("quality", accept_quality),
    ("lines", cut_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mix", mix),
]

#: A trained network decides in the first stage; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; doc_id, source, epoch, size, taken and position of every copy, and a text digest."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    done = STAGES[-1][1](spark, docs, sf_dir)
    return done.select("doc_id", "source", "epoch", "size", "taken", "position", F.md5("text").alias("digest"))
