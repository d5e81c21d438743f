"""Secret scans over all historical versions of texts, with a ledger of scanned blobs.

A version is a path, a version and a text. Its text is addressed by content: the blob is the SHA-256 of its UTF-8
bytes, so copies, renames and reverts are one blob. The ledger is a table of what was scanned: one row for a blob and
the rules (name and version) tried on it, with the spans they found. A scan

1. lists the blobs of all versions and takes off the (blob, rule version) pairs the ledger holds; raising a rule's
   version or adding a rule leaves only that rule's pairs to do, new texts only theirs;
2. takes the text of each blob that is left once, and appends what the missing rules find in it to the ledger;
3. joins spans back to every path and version that has the blob.

A ledger row is a function of its blob and rules alone, so rows written twice do no harm, and what a lost run did not
append is scanned by the next one. Texts are shuffled compressed, never more than once. Copies: a task sends a blob
once; of blobs with more copies than `hot_from`, only the first version's row is sent, and its spans meet the versions
in salted parts. The list of such blobs is broadcast: it has at most one entry for each `hot_from` rows, and `hot_from`
grows with the rows, so at most 2^20 entries.

Defined results: a null text is an empty one; both are a blob without spans. Spans are offsets in code points, ends
exclusive, per rule leftmost and not overlapping; those of different rules may overlap. Null paths and repeated rows
are kept as they come; an empty table gives no rows. Extra columns are not read. Texts are scanned whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import kept
from plumbline.session import prepare


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The three base rules, then marked keys and logins. Letters are ASCII. `hex` finds what `[0-9a-f]+` of 16
#: characters or more finds.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("key_block", 1, r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----(?:[\x0A\x0D]+[A-Za-z0-9+/=]+)*(?:[\x0A\x0D]*-----END [A-Z\x20]*PRIVATE KEY-----)?"),
    Rule("prefixed", 1, r"(?:gh[oprsu]_|glpat-|sk_live_|xox[abprs]-)[A-Za-z0-9-]{16,}"),
    Rule("login", 1, r"(?:amqp|ftp|https?|mongodb|mysql|postgres|redis)://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@"),
)
LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"
_HOT, _ENTRIES, _PARTS = 1 << 12, 1 << 20, 64


def spans(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """(rule key, start, end) of all matches that count."""
    out = []
    for rule in rules:
        for m in re.compile(rule.pattern, re.ASCII).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((rule.key, m.start(), m.end()))
    return out


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def addressed(versions: DataFrame) -> DataFrame:
    """(path, version, text) -> written list of (path, version, blob), every row of the input."""
    prepare(versions.sparkSession)
    return kept(versions.select("path", "version", blob(F.col("text")).alias("blob")), "versions")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a ledger; a folder that is not there yet has none."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _hot_from(rows: int, hot: int) -> int:
    return max(hot, rows // _ENTRIES)


def unseen(index: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, the rules the ledger lacks for it, how many versions have it, and the first of them."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = ledger.select(F.col("blob").alias("its_blob"), F.explode("rules").alias("rule")).groupBy("its_blob").agg(F.collect_set("rule").alias("seen"))
    blobs = index.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("path", "version")).alias("first"))
    left = blobs.join(seen, F.col("blob") == F.col("its_blob"), "left")
    missing = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return left.select("blob", missing.alias("missing"), "copies", "first").where("size(missing) > 0")


def _packed(texts: DataFrame) -> DataFrame:
    """(blob, text) -> (blob, compressed text), each blob once a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, sent = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            names, out = [], []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                key = bytes.fromhex(name.as_py())
                if key not in sent:
                    sent.add(key)
                    names.append(name.as_py())
                    out.append(squeeze.compress(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["blob", "packed"])

    return texts.mapInArrow(pack, "blob string, packed binary")


def _scanned(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, missing, packed) -> ledger rows."""
    by_key = {r.key: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for missing, packed in zip(batch.column(1), batch.column(2), strict=True):
                text = unpack.decompress(packed.as_py()).decode("utf-8", "replace")
                found.append([{"rule": k, "start": s, "end": e} for k, s, e in spans(text, [by_key[m] for m in missing.as_py()])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["blob", "rules", "spans"])

    return rows.select("blob", "missing", "packed").mapInArrow(scan, LEDGER)


def scan(versions: DataFrame, index: DataFrame, folder: str, rules: Sequence[Rule] = RULES, hot: int = _HOT) -> None:
    """Append to the ledger what the rules find in blobs it does not hold them for."""
    spark = prepare(versions.sparkSession)
    todo = kept(unseen(index, read_ledger(spark, folder), rules), "unseen")
    size = todo.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    if not size["blobs"]:
        return
    many = todo.where(F.col("copies") > _hot_from(size["rows"], hot)).select(F.col("blob").alias("its_blob"), "first")
    text = F.coalesce("text", F.lit("")).cast("binary")
    texts = versions.select(F.struct("path", "version").alias("place"), blob(F.col("text")).alias("blob"), text.alias("text"))
    texts = texts.join(F.broadcast(many), F.col("blob") == F.col("its_blob"), "left").where("first IS NULL OR place <=> first")
    if size["blobs"] <= _ENTRIES // 8 and size["blobs"] * 4 <= index.count():
        texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")  # little is new: leave the rest where it is
    each = _packed(texts.select("blob", "text")).groupBy("blob").agg(F.first("packed").alias("packed"))
    _scanned(each.join(todo.select("blob", "missing"), "blob"), rules).write.mode("append").parquet(folder)


def findings(index: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, hot: int = _HOT) -> DataFrame:
    """path, version, blob and the spans of the rules' current versions, for every version; spans by start, then rule."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    found = ledger.where("size(spans) > 0").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    ranked = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.array_position(keys, s["rule"]).cast("int").alias("number"), s["end"].alias("end")))
    name = F.array(*[F.lit(r.name) for r in rules])
    sorted_spans = F.transform(F.array_sort(F.filter(ranked, lambda s: s["number"] > 0)), lambda s: F.struct(
        F.get(name, s["number"] - 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = found.select(F.col("blob").alias("its_blob"), sorted_spans.alias("spans"))
    # Hot blobs: versions are dealt over parts, spans are copied to each.
    counts = index.groupBy(F.col("blob").alias("hot_blob")).count()
    many = F.broadcast(counts.where(F.col("count") > _hot_from(index.count(), hot)).select("hot_blob"))
    part = F.when(F.col("hot_blob").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(_PARTS)).cast("int")).otherwise(0)
    rows = index.join(many, F.col("blob") == F.col("hot_blob"), "left").select("path", "version", "blob", part.alias("part"))
    parts = F.when(F.col("hot_blob").isNotNull(), F.sequence(F.lit(0), F.lit(_PARTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.join(many, F.col("its_blob") == F.col("hot_blob"), "left").select("its_blob", "spans", F.explode(parts).alias("its_part"))
    rows = rows.join(found, F.expr("blob = its_blob AND part = its_part"), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.select("path", "version", "blob", F.coalesce("spans", none).alias("spans"))
