"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A flat file is a run of token ids of fixed width in which documents end with an end-of-document id; nothing says
where. It is read in blocks that know nothing of documents: each block is searched with numpy for the ids, and gives
how many tokens and separators it holds, the place of its first and last separator, and the lengths between. A prefix
scan over the blocks of a file stitches them: tokens and separators of earlier blocks are summed, and the last separator
before a block (a running maximum of absolute places) tells where its first document began, even blocks ago. The scan
has two levels of at most 1,024 blocks each before the second is scanned, so no window grows with a large file.

`written` makes such files from texts with a public tokenizer: every task writes its documents one after the other as
one file, cut into blocks of `block_tokens` tokens, as rows of a table in the shared folder; beside them goes the
list of ids in order, which the scan does not read.

Defined results: a null or empty text is a document of 0 tokens; a file that does not end with a separator ends with
an open document (`ended` false); empty blocks change nothing; a partial token at the end of a block joins the next
block only if blocks are cut at token width, which the reader does. Null and repeated ids are labels only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import kept
from plumbline.session import prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary cuts texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LEVEL = 1024


@dataclass(frozen=True)
class Layout:
    end_ids: tuple[int, ...] = (50256,)
    dtype: str = "<u2"
    block_tokens: int = 1 << 19


LAYOUT = Layout()


def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def written(docs: DataFrame, vocabulary: str = VOCABULARY, layout: Layout = LAYOUT) -> tuple[DataFrame, DataFrame]:
    """Texts as flat token files: (file, block, content), and the ids in order: (file, ordinal, doc_id)."""
    prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, block, done = encoder(vocabulary).encode_ordinary, TaskContext.get().partitionId(), 0, 0
        waiting: list[np.ndarray] = []
        held, size = 0, layout.block_tokens

        def row(block=None, content=None, first=None, ids=None):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([content], pa.binary()),
                 pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "content", "first", "ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for text in batch.column(1):
                waiting.append(np.array([*encode(text.as_py() or ""), layout.end_ids[0]], dtype=layout.dtype))
                held += len(waiting[-1])
                if held >= size:
                    flat = np.concatenate(waiting)
                    cut = held // size * size
                    for at in range(0, cut, size):
                        yield row(block, flat[at : at + size].tobytes())
                        block += 1
                    waiting, held = [flat[cut:]], held - cut
            if ids:
                yield row(first=done, ids=ids)
                done += len(ids)
        if waiting and len(flat := np.concatenate(waiting)):
            yield row(block, flat.tobytes())

    rows = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        write, "file long, block long, content binary, first long, ids array<long>"), "flat-files")
    names = rows.where("ids IS NOT NULL").select("file", "first", F.posexplode("ids").alias("place", "doc_id"))
    return (rows.where("content IS NOT NULL").select("file", "block", "content"),
            names.select("file", (F.col("first") + F.col("place")).alias("ordinal"), "doc_id"))


def flat_files(spark: SparkSession, path: str, layout: Layout = LAYOUT) -> DataFrame:
    """Real flat files under a path as (file, block, content); a file may have up to 2 GB, Spark's limit for one value."""
    prepare(spark)
    width = layout.block_tokens * np.dtype(layout.dtype).itemsize

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for block, at in enumerate(range(0, len(content), width)):
                    yield pd.DataFrame({"file": [path], "block": [block], "content": [content[at : at + width]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, block long, content binary")


def _search(layout: Layout):
    ends = np.array(sorted(layout.end_ids), dtype=layout.dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(2):
                flat = np.frombuffer(content.as_py(), dtype=layout.dtype)
                at = np.flatnonzero(flat == ends[0] if len(ends) == 1 else np.isin(flat, ends))
                found.append((len(flat), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, (np.diff(at) - 1).tolist()))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                                             names=["file", "block", "n", "ends", "first", "last", "inner"])

    return run


def _before(value: str, how, *by: str) -> Column:
    frame = W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    return how(value).over(frame)


def lengths(files: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """file, ordinal, n_tokens, ended: the documents of flat files in order."""
    kind = files.schema["file"].dataType.simpleString()
    found = kept(files.where("octet_length(content) > 0").select("file", "block", "content").mapInArrow(
        _search(layout), f"file {kind}, block long, n long, ends long, first long, last long, inner array<long>"), "separators")
    rows = found.withColumn("part", F.floor(F.col("block") / _LEVEL))
    parts = rows.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    parts = parts.select("file", "part", *[F.coalesce(_before(c, F.sum, "file", "part"), F.lit(0)).alias(f"{c}_ahead") for c in ("n", "ends")])
    rows = rows.join(parts, ["file", "part"])
    for c in ("n", "ends"):
        rows = rows.withColumn(f"{c}_before", F.col(f"{c}_ahead") + F.coalesce(_before(c, F.sum, "file", "part", "block"), F.lit(0)))
    rows = rows.withColumn("last_at", F.col("n_before") + F.col("last"))
    lasts = rows.groupBy("file", "part").agg(F.max("last_at").alias("last_at"))
    lasts = lasts.select("file", "part", _before("last_at", F.max, "file", "part").alias("part_last"))
    rows = rows.join(lasts, ["file", "part"])
    previous = F.coalesce(_before("last_at", F.max, "file", "part", "block"), F.col("part_last"), F.lit(-1))
    rows = rows.withColumn("opened", F.col("n_before") + F.col("first") - previous - 1)
    each = rows.where("ends > 0").select("file", "ends_before", F.posexplode(F.concat(F.array("opened"), "inner")).alias("place", "n_tokens"))
    each = each.select("file", (F.col("ends_before") + F.col("place")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    tails = rows.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("ordinal"), F.coalesce(F.max("last_at"), F.lit(-1)).alias("last_at"))
    tails = tails.where("last_at < n - 1").select("file", "ordinal", (F.col("n") - F.col("last_at") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return each.unionAll(tails)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, layout: Layout = LAYOUT) -> DataFrame:
    """doc_id, n_tokens for every row, counted in flat files written from the texts."""
    files, names = written(docs, vocabulary, layout)
    return names.join(lengths(files, layout), ["file", "ordinal"]).select("doc_id", "n_tokens")
