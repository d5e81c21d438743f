"""Whitening of embeddings by shifted CholeskyQR.

Entries c become integers floor(64 c). A first pass sums them exactly, so rows can be centred before anything is
multiplied: an integer close to the mean is taken off in integers, the rest of the mean (at most a half) in doubles.
Then Gram passes: every task solves its centred rows through the triangular factors found so far, Q = X R1^-1 R2^-1
..., and sums Q'Q; the factor of the sum is the next R. The first Gram matrix gets a shift before it is factored, so
that it has a factor however close to singular it is, and a later one does if it needs it; the passes end when Q'Q is
the identity. The product R of all factors holds what X holds: R = U S V' gives the components V, the eigenvalues
S^2 / n, and the whitened rows as sqrt(n) Q U, which are orthogonal to rounding even where eigenvalues are far apart.
A Gram matrix of X alone would lose every eigenvalue below 1e-16 of the largest; the factors lose those below 1e-24.

What comes to the driver are sums and matrices of dimension times dimension, whatever the number of rows; tasks hold
one such matrix and a slice of an Arrow batch. Lost tasks are run again on the input; nothing is kept between passes.

Defined results: rows whose vector is null or holds a null or a non-finite entry take no part and are not returned.
Vectors shorter than the longest count as having zeros at the end, the empty vector included. Repeated rows and ids
count and are returned as often as they occur, null ids too. Entries beyond 2^55 count as 2^55. A direction whose
standard deviation is below 1e-12 of the largest has no eigenvalue that doubles can tell from zero and is left out, so
equal vectors, a single vector or an empty table give no rows. Of equal eigenvalues any basis may come. A deviation
that no long holds is null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import prepare

#: Scale of the integers, and what the contract adds to them; the latter cancels wherever a mean is taken off.
SCALE, OFFSET = 64, 1_000_000
_LARGEST = 1 << 61
_LOW = 31
_SEGMENT = 64
_CELLS = 1 << 21
PASSES, CLOSE, NEGLIGIBLE = 8, 1e-11, 1e-12
_EPS = 2.0**-53
#: Rows whose products add up in one task's sum, as far as rounding goes.
_SUMMED = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """What the passes found: integer base and rest of the means, triangular factors, rotation, spectrum."""

    n: int
    base: np.ndarray
    rest: list[int]
    factors: tuple[np.ndarray, ...]
    rotation: np.ndarray
    mean: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    directions: np.ndarray
    identity_error: float = 0.0


def _vectors(batch: pa.RecordBatch, width: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of the rows of a batch (id, vector) that take part, slice by slice."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(values)]] = False
    rows = np.flatnonzero(good)
    wide = int(lengths[rows].max(initial=0)) if width is None else width
    step = max(1, _CELLS // max(1, wide))
    for low in range(0, len(rows), step):
        some = rows[low : low + step]
        n = lengths[some]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        whole = np.clip(np.floor(values[at + np.repeat(ends[some] - n, n)] * SCALE), -float(_LARGEST), float(_LARGEST))
        out = np.zeros((len(some), wide), dtype=np.int64)
        out[np.repeat(np.arange(len(some)), n), at] = whole.astype(np.int64)
        yield batch.column(0).take(pa.array(some)), out


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows that take part, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, x in _vectors(batch):
                if x.shape[1] > len(high):
                    high, low = (np.pad(a, (0, x.shape[1] - len(a))) for a in (high, low))
                high[: x.shape[1]] += (x >> _LOW).sum(axis=0)
                low[: x.shape[1]] += (x & ((1 << _LOW) - 1)).sum(axis=0)
                n += len(x)
        columns = [np.arange(-1, len(high)), np.append(0, high), np.append(n, low)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["i", "high", "low"])

    sums = rows.mapInArrow(add, "i long, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {r["i"]: (r["high"] << _LOW) + r["low"] for r in sums.collect()}
    return found.get(-1, 0), [found[i] for i in range(max(found, default=-1) + 1)]


def solved(x: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """q with q r = x for an upper triangular r, block column by block column."""
    q = np.empty((len(r), len(x)))
    for low in range(0, len(r), block):
        high = min(low + block, len(r))
        part = np.ascontiguousarray(x[:, low:high].T) - r[:low, low:high].T @ q[:low]
        for j in range(low, high):
            q[j] = (part[j - low] - r[low:j, j] @ q[low:j]) / r[j, j]
    return q.T


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - base) - rest


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sum over all rows of what `part` makes of their integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns + 1, columns))
        for batch in batches:
            for _, x in _vectors(batch, width):
                q = part(x)
                total[:columns] += q.T @ q
                total[columns] += q.sum(axis=0)
        for s in range(0, columns, _SEGMENT):
            piece = np.ascontiguousarray(total[:, s : s + _SEGMENT])
            offsets = np.arange(0, piece.size + 1, piece.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(piece.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(columns + 1)), pa.array(np.full(columns + 1, s)), lists], names=["i", "s", "cells"])

    each = rows.mapInArrow(add, "i long, s long, cells array<double>").groupBy("i", "s")
    cells = F.array(*[F.sum(F.get("cells", F.lit(j))) for j in range(min(_SEGMENT, columns))])
    out = np.zeros((columns + 1, columns))
    for r in each.agg(cells.alias("cells")).collect():
        out[r["i"], r["s"] : r["s"] + _SEGMENT] = r["cells"][: columns - r["s"]]
    return (out[:columns] + out[:columns].T) / 2, out[columns]


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (min(n, _SUMMED) * d + d * (d + 1)) * _EPS * np.linalg.norm(gram, 2)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def _through(factors: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    for r in factors:
        x = solved(x, r)
    return x


def fit(vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """Means, factors and components of all vectors; None if no direction has any variance."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    n, sums = _totals(rows)
    if not n:
        return None
    base = [round(s / n) if abs(s) < 1 << 53 else s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base, strict=True)]
    base, fraction = np.array(base, dtype=np.int64), np.array([r / n for r in rest])
    d, factors, whole = len(base), (), None
    for turn in range(PASSES if d else 0):
        gram, total = _summed(rows, d, lambda x, fs=factors: _through(fs, _centred(x, base, fraction)), d)
        if not turn and not np.trace(gram):
            return None
        r = _factor(gram, n, not turn)
        factors, whole = (*factors, r), r if whole is None else r @ whole
        if turn and np.abs(gram - np.eye(d)).max() < CLOSE:
            break
    if whole is None:
        return None
    left, spread, directions = np.linalg.svd(whole)
    size = min(components, int((spread > spread[0] * NEGLIGIBLE).sum()))
    flip = np.sign(directions[np.arange(size), np.abs(directions[:size]).argmax(axis=1)])
    rotation = left[:, :size] * flip * np.sqrt(n)
    mean = solved(total[None, :] / n, factors[-1])[0] @ rotation
    eigenvalues = spread**2 / n
    found = Whitening(n, base, rest, factors, rotation, mean, eigenvalues[:size], (eigenvalues / eigenvalues.sum())[:size],
                      directions[:size] * flip[:, None])
    gram, _ = _summed(rows, d, lambda x: white(found, x) - mean, size)
    return Whitening(**{**vars(found), "identity_error": float(np.abs(gram / n - np.eye(size)).max())})


def white(found: Whitening, x: np.ndarray) -> np.ndarray:
    """Integers of rows -> their whitened coordinates."""
    fraction = np.array([r / found.n for r in found.rest])
    return _through(found.factors, _centred(x, found.base, fraction)) @ found.rotation


def deviations(found: Whitening, x: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact, null where no long holds it.

    Sums of products of 64 bits are right in their low 64 bits, so only the size has to be known, which doubles tell;
    where they cannot, near the limit, Python's integers do.
    """
    rest = np.array([r & 0xFFFFFFFFFFFFFFFF for r in found.rest], dtype=np.uint64)
    gap = (x - found.base).view(np.uint64) * np.uint64(found.n % (1 << 64)) - rest
    exact = (gap * gap).sum(axis=1, dtype=np.uint64).view(np.int64)
    about = (((x - found.base).astype(np.float64) * found.n - np.array(found.rest, dtype=np.float64)) ** 2).sum(axis=1)
    sure = about < 2.0**63 * (1 - 1e-6)
    for i in np.flatnonzero(~sure & (about < 2.0**63 * (1 + 1e-6))):
        told = sum((found.n * (int(v) - int(b)) - r) ** 2 for v, b, r in zip(x[i], found.base, found.rest, strict=True))
        sure[i] = told < 1 << 63
    return pa.array(exact, mask=~sure)


def whitened(vectors: DataFrame, found: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation and the whitened coordinates of every vector that takes part."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    schema = f"vec_id {rows.schema[0].dataType.simpleString()}, deviation long, whitened array<double>"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _vectors(batch, len(found.base)):
                out = np.ascontiguousarray(white(found, x))
                offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([ids, deviations(found, x), lists], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(transform, schema)


def by_component(rows: DataFrame, found: Whitening | None) -> DataFrame:
    """One row per vector and component of what `whitened` gives, with the spectrum beside it."""
    explained = [] if found is None else found.explained.tolist()
    share: Column = F.get(F.array(*[F.lit(x) for x in explained]).cast("array<double>"), F.col("pos"))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"),
        "deviation", "whitened", share.alias("explained"), F.lit(found.identity_error if found else 0.0).alias("identity_error"))
