"""Nearest neighbours by cosine through an inverted multi-index.

Unit vectors are cut into two halves; each half has its own codebook, and a pair of centroids is a cell. A query
walks through the pairs in order of summed distance with a heap (empty cells are skipped) until the cells taken hold
enough vectors, a share of all: that within which the sample the codebooks are fitted on has `recall` of its own
nearest neighbours, measured for `asked` of its vectors against all of it (`probe_share` states one instead). Clustered
vectors need a small share, vectors without structure a large one. Neighbours in the whole table are nearer than in
the sample, so the share errs to the safe side. What was taken is reranked by cosines in double precision on the
original vectors.

Equal vectors are one entry that carries its k + 1 smallest ids, found by ranking in salted parts first, so a vector
in a third of all rows costs no more than another. Codebooks are fitted on a bounded sample (`fit_rows`); every
vector is indexed. Neighbouring cells make up blocks of at most `block` entries, and a larger cell is cut into
pieces; a query goes once to each block that holds cells of its walk, with the list of these cells. Within a task
the entries of one block are held and the queries stream past them. The number of cells follows the number of entries, `occupancy` each, up to
`centroids` squared (beyond that cells grow); what is broadcast are two codebooks and one count per cell.

Defined results: vectors that are null, zero, of another length than the commonest (the shorter on ties), or that
hold a null or non-finite component take no part, nor do rows without an id. Rows equal in id and vector are one row.
Ties go to the smaller id. With k or fewer candidates all of them are returned. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import kept
from plumbline.session import prepare, shuffle_width


@dataclass(frozen=True)
class Settings:
    k: int = 5
    occupancy: int = 8
    probe: int = 64
    probe_share: float | None = None
    recall: float = 0.94
    asked: int = 256
    centroids: int = 1024
    fit_rows: int = 20000
    rounds: int = 8
    block: int = 4096
    salts: int = 16
    seed: int = 42


SETTINGS = Settings()


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1) - 2 * (x @ centres.T)


def codebook(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from distinct sample rows; an empty centroid keeps its place."""
    draw = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[draw.permutation(len(distinct))[:n]]
    for _ in range(rounds):
        nearest = distances(x, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        order = np.argsort(nearest, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(nearest[order]) != 0])
        sums[nearest[order][first]] = np.add.reduceat(x[order], first, axis=0)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def walk(one: np.ndarray, two: np.ndarray, counts: dict[int, int], enough: int) -> list[int]:
    """Cells in order of summed distance until they hold enough entries."""
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, reached, out, held = [(float(one[first[0]] + two[second[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heappop(heap)
        cell = int(first[i]) * len(two) + int(second[j])
        if cell in counts:
            out.append(cell)
            held += counts[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in reached:
                reached.add((a, b))
                heappush(heap, (float(one[first[a]] + two[second[b]]), a, b))
    return out


def _valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Distinct vectors with their smallest ids: key (two parts), vector, ids."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(s.salts))
    rows = rows.withColumn("salt", salt)
    for keys in (["vector", "salt"], ["vector"]):
        place = F.dense_rank().over(W.partitionBy(*keys).orderBy("vec_id"))
        rows = rows.withColumn("place", place).where(F.col("place") <= s.k + 1)
    out = rows.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return kept(out.select(F.col("ids")[0].alias("key"), F.xxhash64("vector").alias("mark"), "vector", "ids"), "entries")


@dataclass
class Index:
    centres: tuple[np.ndarray, np.ndarray]
    share: float = 1.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.centres[0].shape[1]
        return distances(x[:, :cut], self.centres[0]), distances(x[:, cut:], self.centres[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.halves(x)
        return one.argmin(axis=1) * len(self.centres[1]) + two.argmin(axis=1)


def fitted(rows: DataFrame, n: int, s: Settings) -> Index:
    """Codebooks from the `fit_rows` vectors of smallest hash."""
    sample = rows.select("vector").orderBy(F.xxhash64("vector", F.lit(s.seed))).limit(s.fit_rows).toPandas()["vector"]
    x = unit(np.array(list(sample), dtype=np.float64))
    size = int(min(max(round((n / s.occupancy) ** 0.5), 1), s.centroids))
    cut = (x.shape[1] + 1) // 2
    index = Index((codebook(x[:, :cut], size, s.rounds, s.seed), codebook(x[:, cut:], size, s.rounds, s.seed + 1)))
    index.share = needed(index, x, s) if s.probe_share is None else s.probe_share
    return index


def needed(index: Index, x: np.ndarray, s: Settings) -> float:
    """Share of the sample a walk must take to hold `recall` of the nearest neighbours that sample vectors have in it."""
    if len(x) <= s.k + 1:
        return 1.0
    one, two = index.halves(x)
    first, second = one.argmin(axis=1), two.argmin(axis=1)
    found = []
    for i in range(0, min(s.asked, len(x)), 64):
        mine = np.arange(i, min(i + 64, s.asked, len(x)))
        near = x[mine] @ x.T
        near[np.arange(len(mine)), mine] = -2
        near = np.argpartition(-near, s.k, axis=1)[:, : s.k]
        far = one[mine][:, first] + two[mine][:, second]
        walked = np.sort(far, axis=1)
        found += [np.searchsorted(w, f[at], side="right") for w, f, at in zip(walked, far, near, strict=True)]
    return float(np.quantile(np.concatenate(found), s.recall, method="higher")) / len(x)


def _stack(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def blocks(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Cell -> (block, pieces): neighbouring cells together up to `most` entries, larger ones cut."""
    out, block, held = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        if held and held + n > most:
            block, held = block + 1, 0
        out[cell] = (block, -(-n // most))
        held += n
    return out


_PIECES = 1 << 20


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by place, entries first: every query's best k + 1 entries of its cells there."""
        place, held, ids, cells, matrix = None, [], [], [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            vectors, entry = _stack(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
            who, mark = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            rows: list[list] = [[] for _ in range(4)]
            for low, high in zip(first, [*first[1:], len(keys)], strict=True):
                if keys[low] != place:
                    place, held, ids, cells, matrix = keys[low], [], [], [], None
                cut = low + int(entry[low:high].sum())
                if cut > low:
                    held.append(unit(vectors[low:cut]))
                    ids += batch.column(5).slice(low, cut - low).to_pylist()
                    cells += [x[0] for x in batch.column(6).slice(low, cut - low).to_pylist()]
                    matrix = None
                if cut == high or not held:
                    continue
                if matrix is None:
                    matrix, least = np.concatenate(held), np.array([x[0] for x in ids])
                    names, own = np.unique(cells, return_inverse=True)
                walks = batch.column(6).slice(cut, high - cut)
                for at in range(cut, high, 256):
                    cosine = unit(vectors[at : min(at + 256, high)]) @ matrix.T
                    for row, score in enumerate(cosine, at):
                        walked = np.isin(names, walks[row - cut].values.to_numpy())
                        near = np.flatnonzero(walked[own])
                        score = score[near]
                        if len(near) > k + 1:
                            best = np.flatnonzero(score >= -np.partition(-score, k)[k])
                            near, score = near[best], score[best]
                        for b in np.lexsort((least[near], -score))[: k + 1]:
                            for out, value in zip(rows, (who[row], mark[row], ids[near[b]], float(score[b])), strict=True):
                                out.append(value)
            if rows[0]:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=["key", "mark", "ids", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, s: Settings = SETTINGS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which `queries` holds."""
    spark = prepare(vectors.sparkSession)
    rows = entries(vectors, s)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = spark.sparkContext.broadcast(fitted(rows, n, s))

    @F.pandas_udf("long")
    def cell(column: pd.Series) -> pd.Series:
        return pd.Series(index.value.cells(unit(np.array(list(column), dtype=np.float64))), dtype="int64")

    placed = kept(rows.withColumn("cell", cell("vector")), "placed")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most centroids squared
    where = spark.sparkContext.broadcast((sizes, blocks(sizes, s.block)))
    enough = max(s.probe, int(np.ceil(index.value.share * n)))

    @F.pandas_udf("long")
    def place(own: pd.Series, mark: pd.Series) -> pd.Series:
        block = [where.value[1][c] for c in own]
        return pd.Series([b * _PIECES + m % p for (b, p), m in zip(block, mark, strict=True)], dtype="int64")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, block = where.value
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                one, two = index.value.halves(unit(np.array(list(part["vector"]), dtype=np.float64)))
                out = []
                for a, b, key, mark, vector in zip(one, two, part["key"], part["mark"], part["vector"], strict=True):
                    visits: dict[int, list[int]] = {}
                    for c in walk(a, b, sizes, enough):
                        for piece in range(block[c][1]):
                            visits.setdefault(block[c][0] * _PIECES + piece, []).append(c)
                    out += [(at, key, mark, vector, cells) for at, cells in visits.items()]
                yield pd.DataFrame(out, columns=["place", "key", "mark", "vector", "cells"])

    asked = vectors.where(queries).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = kept(asked.join(rows.select("vector", "key", "mark"), "vector").select("query_id", "key", "mark", "vector").distinct(), "asked")
    # Walking costs far more than its input's bytes say, so the queries are dealt to a stated number of tasks.
    dealt = asked.select("key", "mark", "vector").distinct().repartition(max(shuffle_width(spark), n // 100_000), "key", "mark")
    probes = dealt.mapInPandas(route, "place long, key long, mark long, vector array<double>, cells array<long>")
    own = placed.select(place("cell", "mark").alias("place"), F.lit(True).alias("entry"), "vector", "key", "mark", "ids", F.array("cell").alias("cells"))
    both = own.unionAll(probes.select("place", F.lit(False).alias("entry"), "vector", "key", "mark", F.array().cast("array<long>").alias("ids"), "cells"))
    both = both.repartition("place").sortWithinPartitions("place", F.col("entry").desc())
    found = both.mapInArrow(_rerank(s.k), "key long, mark long, ids array<long>, score double")
    found = found.select("key", "mark", "score", F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), F.col("vec_id")]
    top = F.row_number().over(W.partitionBy("key", "mark").orderBy(*order))
    found = found.distinct().withColumn("top", top).where(F.col("top") <= s.k + 1)
    found = asked.select("query_id", "key", "mark").join(found, ["key", "mark"]).where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "key", "mark").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
