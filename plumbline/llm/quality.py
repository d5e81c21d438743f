"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Each word is seen as itself (A-Z in lower case) and as a shape (letters, digits and marks, runs cut to one; `=` if it
repeats the word before). Every word and shape has a fixed sparse random index vector drawn from its hash; its word
vector is the sum of the index vectors around it. A document is the mean of its words' vectors beside the mean of its
shapes' vectors. A network with one hidden layer is trained on these in numpy; a temperature fitted on rows kept out
of training makes its output a probability.

Only the fit is bounded: at most `fit_rows` labelled rows, those with the smallest hash of their id, of at most
`fit_chars` characters each, in one task. All texts are scored whole, in the scan, without a shuffle; the model that
is broadcast holds at most `words` + `shapes` vectors.

Defined results: a null text is an empty one and gets the score of the zero vector; labels other than 0 and 1 and
labels without a document are not used; repeated labels of an id count once, as their largest; with labels of one
kind only, or none, every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept, remainder, utf8
from plumbline.session import prepare


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 8000
    fit_chars: int = 1 << 17
    words: int = 20000
    shapes: int = 1000
    width: int = 64
    nonzero: int = 8
    reach: int = 2
    hidden: int = 32
    epochs: int = 60
    accept: float = 0.7
    seed: int = 42


SETTINGS = Settings()
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_CHUNK = 1 << 17


class Shapes(dict):
    """Translated word -> number of its shape; holds few entries, as it forgets when many gather."""

    def __init__(self, names: dict[bytes, int]):
        super().__init__()
        self.names = names

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = found = self.names.get(_RUNS.sub(rb"\1", word), 0)
        return found


def _read(text: bytes) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Words, translated words, and where a word repeats the one before."""
    found = text.lower().split()
    same = np.zeros(len(found), dtype=bool)
    if len(found) > 1:
        same[1:] = [a == b for a, b in zip(found, found[1:], strict=False)]
    return found, text.translate(_SHAPE).split(), same


def _index_vectors(names: list[bytes], width: int, nonzero: int, seed: int) -> np.ndarray:
    out = np.zeros((len(names), width), dtype=np.float32)
    for i, name in enumerate(names):
        draw = np.random.default_rng(xxhash.xxh64_intdigest(name, seed))
        out[i, draw.choice(width, nonzero, replace=False)] = draw.choice([-1.0, 1.0], nonzero)
    return out


def _add_at(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
    if len(rows):
        total[rows[first]] += np.add.reduceat(values[order], first, axis=0)


class Vectors:
    """Word and shape vectors; entry 0 of each stands for the unknown and is zero."""

    def __init__(self, names: list[bytes], shapes: list[bytes], word: np.ndarray, shape: np.ndarray):
        self.names = {w: i + 1 for i, w in enumerate(names)}
        self.shapes = Shapes({s: i + 1 for i, s in enumerate(shapes)})
        self.repeat = self.shapes.names.get(b"=", 0)
        self.word, self.shape = word, shape

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        look, of, word, shape, lengths = self.names.get, self.shapes, [], [], []
        for text in texts:
            found, translated, same = _read(text)
            lengths.append(len(found))
            word.append(np.array([look(w, 0) for w in found], dtype=np.int64))
            one = np.array([of[w] for w in translated], dtype=np.int64)
            one[same] = self.repeat
            shape.append(one)
        empty = [np.empty(0, dtype=np.int64)]
        return np.concatenate(word + empty), np.concatenate(shape + empty), np.array(lengths, dtype=np.int64)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * self.word.shape[1]), dtype=np.float64)
        for k, text in enumerate(texts):
            word, shape, _ = self.numbers([text])
            if not len(word):
                continue
            words, many = np.unique(word, return_counts=True)
            shapes, often = np.unique(shape, return_counts=True)
            out[k] = np.concatenate([many @ self.word[words], often @ self.shape[shapes]]) / len(word)
        return out


def learn_vectors(texts: list[bytes], s: Settings = SETTINGS) -> Vectors:
    words, shapes = Counter(), Counter({b"=": 1})
    for text in texts:
        found, translated, _ = _read(text)
        words.update(set(found))
        shapes.update({_RUNS.sub(rb"\1", w) for w in set(translated)})
    order = lambda c, n: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]]
    names, kinds = order(words, s.words), sorted({b"=", *order(shapes, s.shapes - 1)})
    v = Vectors(names, kinds, np.zeros((len(names) + 1, s.width), np.float32), np.zeros((len(kinds) + 1, s.width), np.float32))
    word_index = np.vstack([np.zeros((1, s.width), np.float32), _index_vectors(names, s.width, s.nonzero, s.seed)])
    kind_index = np.vstack([np.zeros((1, s.width), np.float32), _index_vectors(kinds, s.width, s.nonzero, s.seed + 1)])
    for text in texts:
        word, shape, _ = v.numbers([text])
        for i in range(0, len(word), _CHUNK):
            w, k = word[i : i + _CHUNK], shape[i : i + _CHUNK]
            own = word_index[w] + kind_index[k]
            around = kind_index[k].copy()
            for d in range(1, s.reach + 1):
                around[d:] += own[:-d]
                around[:-d] += own[d:]
            _add_at(v.word, w, around)
            _add_at(v.shape, k, around)
    for table in (v.word, v.shape):
        table[0] = 0
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return v


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, s: Settings = SETTINGS) -> dict[str, np.ndarray]:
    """Two layers by Adam on cross-entropy; every fifth row is kept out and sets the temperature."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    out = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    draw = np.random.default_rng(s.seed)
    p = [draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], s.hidden)), np.zeros(s.hidden), draw.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
    one, two, turn = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    rows = np.flatnonzero(~out)
    for _ in range(s.epochs):
        draw.shuffle(rows)
        for i in range(0, len(rows), 128):
            at = rows[i : i + 128]
            h = np.tanh(z[at] @ p[0] + p[1])
            gap = (_sigmoid(h @ p[2] + p[3]) - y[at]) / len(at)
            back = gap[:, None] * p[2] * (1 - h * h)
            g = [z[at].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ gap + 1e-4 * p[2], gap.sum(keepdims=True)]
            turn += 1
            for a, d, m, q in zip(p, g, one, two, strict=True):
                m += 0.1 * (d - m)
                q += 0.001 * (d * d - q)
                a -= 3e-3 * (m / (1 - 0.9**turn)) / (np.sqrt(q / (1 - 0.999**turn)) + 1e-8)
    test = out if out.any() and 0 < y[out].mean() < 1 else ~out
    logit = np.tanh(z[test] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda t: np.mean(np.logaddexp(0, logit / t) - y[test] * logit / t)
    best = min(np.exp(np.linspace(np.log(0.25), np.log(8), 141)), key=loss)
    return dict(mean=mean, scale=scale, w1=p[0], b1=p[1], w2=p[2], b2=p[3], temperature=np.array([best]))


class Model:
    """Fitted vectors and network; travels as the bytes of an npz archive."""

    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(blob), allow_pickle=False) as f:
            self.p = {k: f[k] for k in f.files}
        if "w1" in self.p:
            names, shapes = (bytes(self.p[k]).split(b"\n") for k in ("names", "shapes"))
            self.vectors = Vectors(names, shapes, self.p["word"], self.p["shape"])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if "w1" not in self.p:
            return np.full(len(texts), float(self.p["share"][0]))
        p = self.p
        z = (self.vectors.pooled(texts) - p["mean"]) / p["scale"]
        return _sigmoid((np.tanh(z @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]) / p["temperature"])


def fit(texts: list[bytes], labels: list[int], s: Settings = SETTINGS) -> bytes:
    out, y = io.BytesIO(), np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        np.savez(out, share=np.array([y.mean() if len(y) else 0.5]))
        return out.getvalue()
    v = learn_vectors(texts, s)
    network = train(v.pooled(texts), y, s)
    np.savez(out, names=np.frombuffer(b"\n".join(v.names), np.uint8), shapes=np.frombuffer(b"\n".join(v.shapes.names), np.uint8),
             word=v.word, shape=v.shape, **network)
    return out.getvalue()


def fitted(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS) -> bytes:
    """Fit on the bounded sample, in one task; labels of held-out ids (crc32 modulo 4 is 2) are not read."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = known.join(docs.where(F.length("text") <= s.fit_chars).select("doc_id").distinct(), "doc_id", "left_semi")
    known = kept(known.withColumn("draw", F.xxhash64("doc_id", F.lit(s.seed))).orderBy("draw", "doc_id").limit(s.fit_rows), "fit-ids")
    rows = docs.where(F.length("text") <= s.fit_chars).select("doc_id", utf8(F.col("text")).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").repartition(1).sortWithinPartitions("draw", "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, marks = [], []
        for batch in batches:
            texts += list(batch["text"])[: s.fit_rows - len(texts)]
            marks += list(batch["label"])[: s.fit_rows - len(marks)]
        yield pd.DataFrame({"model": [fit(texts, marks, s)]})

    done = rows.select("text", "label").mapInPandas(run, "model binary").first()
    return bytes(done["model"]) if done else fit([], [], s)


def score(docs: DataFrame, model: bytes, text: Column) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(held.value)
        for texts in batches:
            yield pd.Series(own.scores(list(texts)), dtype="float64")

    return of(utf8(text))


def scored(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", score(docs, fitted(docs, labels, s), F.col("text")).alias("score"))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       F.when(F.col("score") >= s.accept, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    prepare(docs.sparkSession)
    model = fitted(docs, labels, s)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("body"))
    return rows.where(score(docs, model, F.col("body")) >= s.accept).select("row.*")
