"""SimHash near-dedup by anchor points.

A fingerprint has 64 bits, cut into three segments. Two fingerprints with at most four differing bits differ in at
most one bit of one segment. In each segment the anchors are the words whose 15 low bits form a Hamming codeword
(the other bits are free): every word lies within one bit of an anchor, the covering radius. A fingerprint is at home
at its nearest anchor and is copied to every anchor within radius plus one bit that is not below its home, so two
linked fingerprints meet at the higher of their homes. At an anchor, homes are compared with copies; what comes out is a spanning forest of the links
found, never all pairs. Equal fingerprints are one node from the start.

Anchors with many homes (one large group of near copies) are cut into parts of at most `HOMES` homes; the copies go
to every part and are streamed past the homes, so a task holds one part's homes and one Arrow batch.

`one_per_group` keeps one document of each component, by the same shingles and the same bits.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a text of fewer words
than a shingle is one shingle; repeated rows give repeated results; null ids get their component's smallest id, null
if it has none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept, utf8, words
from plumbline.llm.links import components
from plumbline.session import prepare

SHINGLE, SEED, BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
REACH = 1 + BITS // len(SEGMENTS)
HOMES = 1 << 15
_PAIRS = 1 << 21
#: Hot anchors are broadcast while there are at most so many (24 bytes each), else joined.
_BROADCAST_ROWS = 1 << 20


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    found = words(text)
    joined = b" ".join(found)
    if len(found) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)] if found else []
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[s:e], SEED) for s, e in zip([0, *(e + 1 for e in ends)], ends[n - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> int:
    """Bit by bit what over half of the hashes have, as a signed long."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    return majority(np.array(shingle_hashes(text, n), dtype="<u8"))


def fingerprints(text: Column, n: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, n) for t in texts], dtype="int64")

    return of(utf8(text))


def _syndromes() -> np.ndarray:
    """Syndrome of every 15-bit word: the sum over GF(2) of the numbers 1 to 15 of its set bits."""
    values = np.arange(1 << 15)
    out = np.zeros(1 << 15, dtype=np.int64)
    for bit in range(15):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


def _moves(width: int, reach: int, syndromes: np.ndarray) -> list[np.ndarray]:
    """By syndrome: the bit patterns of at most `reach` ones that lead from a word to an anchor."""
    out: list[list[int]] = [[] for _ in range(16)]
    for n in range(reach + 1):
        for bits in combinations(range(width), n):
            pattern = sum(1 << b for b in bits)
            out[syndromes[pattern & 0x7FFF]].append(pattern)
    return [np.array(x, dtype=np.int64) for x in out]


def _anchored(prints: DataFrame, homes_only: bool) -> DataFrame:
    """(fp, family, node, root) -> (anchor, home, fp, node, root): one home in each segment and, unless only homes are wanted, the copies."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        syndromes = _syndromes()
        moves = [_moves(width, REACH, syndromes) for _, width in SEGMENTS]
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fp, family, node, root = (batch.column(i).to_numpy()[start : start + 4096] for i in range(4))
                for k, (low, width) in enumerate(SEGMENTS):
                    part = (fp >> low) & ((1 << width) - 1)
                    syndrome = syndromes[part & 0x7FFF]
                    home = part ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
                    found = [(home, np.ones(len(fp), bool), np.arange(len(fp)))]
                    for s in range(0 if homes_only else 16):
                        at = np.flatnonzero(syndrome == s)
                        near = (part[at][:, None] ^ moves[k][s][None, :]).ravel()
                        whose = np.repeat(at, len(moves[k][s]))
                        # Of two linked words the one with the lower home goes to the home of the other.
                        ahead = near >= home[whose]
                        found.append((near[ahead], np.zeros(int(ahead.sum()), bool), whose[ahead]))
                    anchor, is_home, who = (np.concatenate(x) for x in zip(*found, strict=True))
                    anchor = anchor | k << 32 | family[who].astype(np.int64) << 34
                    columns = (anchor, is_home, fp[who], node[who], root[who])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "home", "fp", "node", "root"])

    schema = "anchor long, home boolean, fp long, node long, root long"
    return prints.select("fp", "family", "node", "root").mapInArrow(assign, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> every node with the smallest node of its component, without the roots themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, part, homes first) -> forests of the links between homes and copies."""
    homes = [np.empty(0, dtype=np.int64)] * 3
    for batch in batches:
        key, is_home, fp, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        homes = [np.concatenate([h, x[is_home]]) for h, x in zip(homes, (key, fp, root), strict=True)]
        group, sizes = np.unique(homes[0], return_counts=True)
        starts = np.cumsum(sizes) - sizes
        copy_key, copy_fp, copy_root = (x[~is_home] for x in (key, fp, root))
        if len(group) and len(copy_key):
            where = np.minimum(np.searchsorted(group, copy_key), len(group) - 1)
            count = np.where(group[where] == copy_key, sizes[where], 0)
            low, ends, i = starts[where], np.cumsum(count), 0
            while i < len(copy_key):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS)))
                n = count[i:j]
                mine = np.repeat(np.arange(i, j), n)
                theirs = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[i:j], n)
                near = np.flatnonzero(np.bitwise_count((homes[1][theirs] ^ copy_fp[mine]).view(np.uint64)) <= BITS)
                near = near[homes[2][theirs[near]] != copy_root[mine[near]]]
                if len(near):
                    a, b = forest(homes[2][theirs[near]], copy_root[mine[near]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                i = j
        last = homes[0] == key[-1]
        homes = [h[last] for h in homes]


def linked(prints: DataFrame, homes_per_part: int = HOMES) -> DataFrame:
    """Distinct (fp, family, node, root) -> links (a, b) of roots, with the same components as all links between rows
    of a family at 4 or fewer differing bits."""
    crowded = _anchored(prints, True).groupBy("anchor").count().where(F.col("count") > homes_per_part)
    crowded = kept(crowded.select("anchor", F.ceil(F.col("count") / homes_per_part).cast("int").alias("parts")), "crowded")
    rows, hot = _anchored(prints, False), crowded.count()
    if hot:
        rows = rows.join(F.broadcast(crowded) if hot <= _BROADCAST_ROWS else crowded, "anchor", "left")
        every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        one = F.array(F.pmod(F.xxhash64("fp", "node"), F.coalesce("parts", F.lit(1))).cast("int"))
        rows = rows.withColumn("part", F.explode(F.when(F.col("home"), one).otherwise(every)))
    else:
        rows = rows.withColumn("part", F.lit(0))
    rows = rows.select(((F.col("part").cast("long") * (1 << 40)) + F.col("anchor")).alias("key"), "home", "fp", "root")
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("home").desc())
    return rows.mapInArrow(_compare, "a long, b long").distinct()


def grouped(prints: DataFrame, homes_per_part: int = HOMES) -> DataFrame:
    """Distinct (fp, family, node) -> (node, root): all nodes, equal roots for linked ones."""
    roots = components(linked(prints.withColumn("root", F.col("node")), homes_per_part))
    return prints.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _grouped(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Every row as doc_id, mark (hash of the text), node (its fingerprint); and every node with its root and its first
    place, by id, null ids last, then by mark."""
    prepare(docs.sparkSession)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = kept(docs.select("doc_id", mark.alias("mark"), fingerprints(F.col("text"), n).alias("node")), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    prints = kept(rows.groupBy("node").agg(F.min(place).alias("place")), "prints")
    return rows, prints.join(grouped(prints.select(F.col("node").alias("fp"), F.lit(0).alias("family"), "node")), "node")


def near_duplicates(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id for every row: fingerprints of the shingles link at 4 or fewer differing bits."""
    rows, groups = _grouped(docs, n)
    ids = groups.groupBy("root").agg(F.min("place.doc_id").alias("component_id"))
    return rows.join(groups.join(ids, "root").select("node", "component_id"), "node").select("doc_id", F.col("node").alias("fp"), "component_id")


def one_per_group(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """The documents that stay: of every component that with the smallest id, null ids last, then by hash."""
    _, groups = _grouped(docs, n)
    stay = groups.groupBy("root").agg(F.min("place").alias("place"))
    stay = stay.select(F.col("place.doc_id").alias("its_id"), F.col("place.mark").alias("its_mark"))
    docs = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    docs = docs.join(stay, F.expr("doc_id <=> its_id AND mark = its_mark"), "left_semi")
    return docs.dropDuplicates(["doc_id", "mark"]).select("row.*")
