"""LM scoring: a log-bilinear model trained with noise-contrastive estimation, beside a unigram base.

Tokens are words (A-Z in lower case) and one end per text. The `units` most frequent tokens of the training texts
are units of their own; all others share `GROUPS` units by their last character and length. The model predicts the next
unit: the vectors of the two units before, each scaled by a vector of its place, sum to a predicted vector, whose product
with a unit's vector plus its bias is the unit's score. Within a group a second level of the same form predicts the
word from the unit before: every further word with at least `least` training tokens, up to `words` of them, has a
vector and a bias, and one entry stands for the rest of the group, which its words share by their counts.

Both levels are trained by contrast with noise on all training texts: in every round each task starts from the same
parameters and passes over its own texts by minibatches with shared noise (every `rounds`-th position, the next phase
each round, so all are read once); the tasks' parameters are averaged by a Spark aggregate, weighted by positions, entries
by how often a task met them. Batched matrix products over all pairs of units then give the normaliser of every
context, and those over units and entries the normaliser within each group, so each token gets a normalised
log-probability.

Counts are exact and cover all training texts. Tokens with at least 1 in 2^20 of all tokens (so at most 2^20 of
them) are broadcast; counts of the rest are joined, and no such token has a share that could crowd a task.

Defined results: a null or empty text is one end token; rows equal in id and text give equal results, one each; a
null id takes no part in training (its remainder is 0). Without training texts every count is 0 and the model uniform.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept, remainder, utf8
from plumbline.session import prepare

#: The end of a text; no word holds a line break.
END = b"\n"
FREQUENT = 1 << 20
#: Bytes of text whose words are counted at a time.
_COUNTED = 4 << 20
_ENDINGS = {**dict.fromkeys(b".", 1), **dict.fromkeys(b",;:", 2), **dict.fromkeys(b"!?", 3), **dict.fromkeys(b"0123456789", 4)}
GROUPS = 6 * 4


@dataclass(frozen=True)
class Settings:
    units: int = 488
    words: int = 1 << 14
    least: int = 5
    width: int = 32
    noise: int = 48
    inner_noise: int = 128
    batch: int = 2048
    first_batch: int = 512
    rounds: int = 1
    rate: float = 0.3
    seed: int = 42


SETTINGS = Settings()


def group(word: bytes) -> int:
    """Group of a word that is no unit of its own: kind of its last byte, and length."""
    last = word[-1]
    kind = _ENDINGS.get(last, 0 if last >= 128 or 97 <= last <= 122 else 5)
    return kind * 4 + (len(word) > 4) + (len(word) > 7) + (len(word) > 11)


def counted(texts: DataFrame) -> DataFrame:
    """`text` as bytes -> (word, c) over all of them, the end included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _some((t.as_py() for batch in batches for t in batch.column(0)), _COUNTED):
            told = pc.value_counts(split(some)[0])
            yield pa.RecordBatch.from_arrays([told.field(0), told.field(1)], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(some)], pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon:
    """Frequent tokens and the totals of all others."""

    def __init__(self, frequent: list[tuple[bytes, int]], n: int, v: int, group_words: np.ndarray, group_tokens: np.ndarray, s: Settings):
        """group_words, group_tokens: distinct and all training tokens by group, units of their own not yet taken out."""
        frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.n, self.v = n, v
        own = [w for w, _ in frequent if w != END][: s.units - 1]
        self.units = len(own) + 1 + GROUPS
        self.start = self.units
        unit = {w: i + 1 for i, w in enumerate(own)} | {END: 0}
        words_in, tokens_in = group_words.astype(float), group_tokens.astype(float)
        further = [(w, c) for w, c in frequent if w not in unit and c >= s.least][: s.words]
        inside: list[list[tuple[bytes, int]]] = [[] for _ in range(GROUPS)]
        for w, c in further:
            inside[group(w)].append((w, c))
        for w in own:
            words_in[group(w)] -= 1
        for w, c in frequent:
            if w in unit and w != END:
                tokens_in[group(w)] -= c
        rest_words, rest_tokens = words_in.copy(), tokens_in.copy()
        for g, found in enumerate(inside):
            rest_words[g] -= len(found)
            rest_tokens[g] -= sum(c for _, c in found)
        rest = np.maximum(rest_tokens, 0) + 0.1 * (np.maximum(rest_words, 0) + 1)
        self.first_group, self.spread = len(own) + 1, np.log10(rest)
        # Entries of a group follow each other, the one for its rest last.
        self.entry_start = np.cumsum([0, *(len(found) + 1 for found in inside)])
        self.entry_group = np.repeat(np.arange(GROUPS), np.diff(self.entry_start))
        self.entry_mass = np.array([x for g, found in enumerate(inside) for x in (*(c + 0.1 for _, c in found), rest[g])])
        self.entry_share = self.entry_mass / np.add.reduceat(self.entry_mass, self.entry_start[:-1])[self.entry_group]
        entry = {w: int(self.entry_start[g]) + i for g, found in enumerate(inside) for i, (w, _) in enumerate(found)}
        self.number = {w: i for i, (w, _) in enumerate(frequent)}
        if END not in self.number:
            self.number[END] = len(frequent)
            frequent = [*frequent, (END, 0)]
        counts = np.array([c for _, c in frequent], dtype=float)
        self.base = np.log10(counts + 0.1) - self.total()
        self.known = counts > 0
        self.unit = np.array([unit.get(w, -1) if w in unit else self.first_group + group(w) for w, _ in frequent], dtype=np.int64)
        self.entry = np.array([-1 if w in unit else entry.get(w, self.rest_of(w)) for w, _ in frequent], dtype=np.int64)
        self.within = np.array([0.0 if w in unit or w in entry else np.log10(c + 0.1) - self.spread[group(w)] for w, c in frequent])
        mass = np.zeros(self.units)
        mass[self.first_group :] = tokens_in
        np.add.at(mass, self.unit[self.unit < self.first_group], counts[self.unit < self.first_group])
        self.mass = np.maximum(mass, 0) + 0.5
        self.mass /= self.mass.sum()

    def total(self) -> float:
        return float(np.log10(self.n + 0.1 * (self.v + 1)))

    def rest_of(self, word: bytes) -> int:
        return int(self.entry_start[group(word) + 1]) - 1

    def numbered(self, found: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of some texts, each text closed by its end: numbers (-1: not frequent), units, entries (-1: the
        unit is the word), and the places of words that are not frequent. Words are looked up once each."""
        number = np.fromiter(map(self.number.get, found.distinct, repeat(-1)), dtype=np.int64, count=len(found.distinct))
        unit, entry, rare = self.unit[number], self.entry[number], np.flatnonzero(number < 0)
        if len(rare):
            groups = np.array([group(found.distinct[i]) for i in rare.tolist()])
            unit[rare], entry[rare] = self.first_group + groups, self.entry_start[groups + 1] - 1
        number = number.take(found.code)
        return number, unit.take(found.code), entry.take(found.code), np.flatnonzero(number < 0)

    def initial(self, s: Settings) -> np.ndarray:
        """Rows: units before (and the start), predicted units with their bias last, the two places, the place within
        groups, entries with their bias last. Untrained, the chances within a group are those of the counts."""
        draw = np.random.default_rng(s.seed)
        p = np.zeros((2 * self.units + 4 + len(self.entry_mass), s.width + 1), dtype=np.float32)
        p[: 2 * self.units + 1, : s.width] = draw.normal(0, 0.1, (2 * self.units + 1, s.width))
        p[self.units + 1 : 2 * self.units + 1, s.width] = np.log(self.mass)
        p[2 * self.units + 1 : 2 * self.units + 4, : s.width] = [[1.0], [0.5], [1.0]]
        p[2 * self.units + 4 :, s.width] = np.log(self.entry_share)
        return p


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with A-Z in lower case, and how many each text has: those of `common.words`, of whatever bytes."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    found, cuts = parts.values.view(pa.binary()), parts.offsets.to_numpy()
    whole = pc.binary_length(found).to_numpy() > 0  # space at either side of a text leaves an empty word
    if not whole.all():
        found, cuts = found.filter(pa.array(whole)), np.concatenate([[0], np.cumsum(whole)])[cuts]
    return found, np.diff(cuts)


@dataclass(frozen=True)
class Tokens:
    """Tokens of some texts: the distinct ones, and which of them stands at each place."""

    distinct: list[bytes]
    code: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    """Words of texts, an end behind each text."""
    found, many = split(texts)
    coded = found.dictionary_encode()
    distinct = [*coded.dictionary.to_numpy(zero_copy_only=False), END]
    return Tokens(distinct, np.insert(coded.indices.to_numpy(), np.cumsum(many), len(distinct) - 1))


def contexts(unit: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token of a text, and the one before that; unit 0 ends a text."""
    one = np.concatenate([[0], unit[:-1]])
    first = one == 0
    one = np.where(first, start, one)
    two = np.concatenate([[start], one[:-1]])
    return one, np.where(first, start, two)


def _places(unit: np.ndarray) -> np.ndarray:
    """Places of tokens in their texts."""
    at = np.arange(len(unit))
    begin = np.concatenate([[0], np.flatnonzero(unit == 0) + 1])
    return at - begin[np.searchsorted(begin, at, side="right") - 1]


def _some(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in lists of about so many bytes."""
    waiting, many = [], 0
    for text in texts:
        waiting.append(text)
        many += len(text)
        if many >= size:
            yield waiting
            waiting, many = [], 0
    if waiting:
        yield waiting


def _order(rows: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of row numbers below `limit`; narrow numbers are sorted by radix."""
    return np.argsort(rows.astype(np.min_scalar_type(limit)), kind="stable")


def _row_sums(rows: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values, and how often each occurs."""
    order = _order(rows, limit)
    rows = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values.take(order, axis=0), first, axis=0), np.diff(np.append(first, len(rows)))


class Trainer:
    """Noise-contrastive steps with Adagrad, from given parameters."""

    def __init__(self, p: np.ndarray, x: Lexicon, s: Settings, seed: int):
        self.p, self.s, self.x, self.u = p.copy(), s, x, x.units
        self.head = 2 * x.units + 4
        self.seen, self.draw = np.full_like(p, 1e-2), np.random.default_rng(seed)
        self.log_noise = np.log(s.noise * x.mass).astype(np.float32)
        self.steps = np.cumsum(x.mass)
        self.log_share = np.log(x.entry_share).astype(np.float32)
        self.positions, self.met = 0, np.zeros(len(p) - self.head)

    @property
    def batch(self) -> int:
        """Steps are small at first and grow with what was read."""
        return min(max(self.s.first_batch, self.positions // 16), self.s.batch)

    @np.errstate(over="ignore")  # of infinity, the gradient is zero
    def step(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray, entry: np.ndarray) -> None:
        u, w, p = self.u, self.s.width, self.p
        before, after, place = p[: u + 1, :w], p[u + 1 : 2 * u + 1], p[2 * u + 1 : self.head, :w]
        noise = np.minimum(np.searchsorted(self.steps, self.draw.random(self.s.noise)), u - 1)
        r1, r2 = before.take(one, axis=0), before.take(two, axis=0)
        ahead = _with_ones(r1 * place[0] + r2 * place[1])
        real, false = after.take(unit, axis=0), after.take(noise, axis=0)
        false[:, w] -= self.log_noise[noise]
        score = np.einsum("ij,ij->i", ahead, real) - self.log_noise[unit]
        g_real, g_false = (1 + _loss(-score))[:, None], _loss(-ahead @ false.T)
        g_ahead = g_real * real[:, :w] + g_false @ false[:, :w]
        g = np.zeros((self.head, w + 1), dtype=np.float32)
        for rows, values in ((unit, g_real * ahead), (noise, g_false.T @ ahead)):
            at, sums, _ = _row_sums(rows, values, u)
            g[u + 1 + at] += sums
        for rows, scale in ((one, place[0]), (two, place[1])):
            at, sums, _ = _row_sums(rows, g_ahead, u + 1)
            g[at, :w] += sums * scale
        g[2 * u + 1, :w], g[2 * u + 2, :w] = np.einsum("ij,ij->j", g_ahead, r1), np.einsum("ij,ij->j", g_ahead, r2)
        inner = np.flatnonzero(entry >= 0)
        if len(inner):
            self._within(one[inner], entry[inner], g)
        g /= len(unit)
        self.seen[: self.head] += g * g
        p[: self.head] += self.s.rate * g / np.sqrt(self.seen[: self.head])
        self.positions += len(unit)

    def _within(self, one: np.ndarray, entry: np.ndarray, g: np.ndarray) -> None:
        """The second level: words of a group against each other, some at a time. Noise from the batch has the words'
        own frequencies, and a word's gains and losses fall into the same step. A word's own score is one of those
        against the noise, so one matrix of gradients serves both."""
        u, w, x = self.u, self.s.width, self.x
        place, vectors = self.p[2 * u + 3, :w], self.p[self.head :]
        order = _order(x.entry_group[entry], GROUPS)
        one, entry = one[order], entry[order]
        groups = x.entry_group[entry]
        cuts = np.searchsorted(groups, np.arange(GROUPS + 1))
        r, real = self.p[: u + 1, :w].take(one, axis=0), vectors.take(entry, axis=0)
        real[:, w] -= self.log_share[entry]
        # Rows stand against those of their stretch of a group: the last stretch is a short one.
        place_in, size = np.arange(len(groups)) - cuts[groups], np.diff(cuts)[groups]
        real[:, w] -= np.log(np.minimum(size - place_in // self.s.inner_noise * self.s.inner_noise, self.s.inner_noise)).astype(np.float32)
        ahead, g_ahead = _with_ones(r * place), np.zeros_like(r)
        values, told = np.empty_like(ahead), np.diff(x.entry_start)[groups] > 1
        for group_at, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if low == high or x.entry_start[group_at + 1] - x.entry_start[group_at] == 1:
                continue
            for i in range(low, high, self.s.inner_noise):
                j = min(i + self.s.inner_noise, high)
                mine, words_at = ahead[i:j], real[i:j]
                slope = _loss(-mine @ words_at.T)
                own = slope.reshape(-1)[:: j - i + 1]
                own += 1 + own
                np.matmul(slope, words_at[:, :w], out=g_ahead[i:j])
                np.matmul(slope.T, mine, out=values[i:j])
        at, sums, _ = _row_sums(one, g_ahead, u + 1)
        g[at, :w] += sums * place
        g[2 * u + 3, :w] = np.einsum("ij,ij->j", g_ahead, r)
        if not told.all():
            entry, values = entry[told], values[told]
        if len(entry):
            at, sums, many = _row_sums(entry, values, len(vectors))
            mean = sums / many[:, None].astype(np.float32)
            self.met[at] += many
            seen = self.seen[self.head + at] + mean * mean
            self.seen[self.head + at] = seen
            vectors[at] += self.s.rate * mean / np.sqrt(seen)


def _with_ones(ahead: np.ndarray) -> np.ndarray:
    """Predicted vectors with a last entry that meets the bias."""
    return np.concatenate([ahead, np.ones((len(ahead), 1), dtype=np.float32)], axis=1)


def _loss(minus: np.ndarray) -> np.ndarray:
    """Gradients -1 / (1 + exp(-score)) of scores against noise, from the negated scores, in their place. Those of real
    scores, 1 / (1 + exp(score)), are larger by one."""
    np.exp(minus, out=minus)
    minus += 1
    return np.divide(-1, minus, out=minus)


def _round(texts: DataFrame, held, p: np.ndarray, s: Settings, turn: int, seen: list[int] | None = None) -> np.ndarray:
    """One pass of all tasks from the same parameters, averaged by Spark; `seen` is given the number of positions."""
    start = texts.sparkSession.sparkContext.broadcast(p)
    values = [f"v{i}" for i in range(p.shape[1])]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value
        t, waiting, many = Trainer(start.value, lexicon, s, s.seed + turn), [], 0

        def steps(last: bool) -> list:
            ready, low = [np.concatenate(x) for x in zip(*waiting, strict=True)], 0
            while len(ready[0]) - low >= (1 if last else t.batch):
                high = low + t.batch
                t.step(*[x[low:high] for x in ready])
                low = high
            return [tuple(x[low:] for x in ready)]

        for batch in batches:
            for some in _some(t.as_py() for t in batch.column(0)):
                _, unit, entry, _ = lexicon.numbered(tokens(some))
                one, two = contexts(unit, lexicon.start)
                drawn = (one, two, unit, entry)
                if s.rounds > 1:
                    at = np.flatnonzero(_places(unit) % s.rounds == turn)
                    drawn = tuple(x[at] for x in drawn)
                waiting.append(drawn)
                many += len(drawn[0])
                if many >= 2 * t.batch:
                    waiting = steps(False)
                    many = len(waiting[0][0])
        if many:
            steps(True)
        if t.positions:
            weight = np.concatenate([np.full(t.head, float(t.positions)), t.met])
            at = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight[at]), *[pa.array(c) for c in t.p[at].T]], names=["at", "n", *values])

    schema = "at long, n double, " + ", ".join(f"{c} float" for c in values)
    total = texts.select("text").mapInArrow(learn, schema).groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in values])
    found, out = total.toArrow(), p.copy()  # one row per row of parameters that moved
    n = found["n"].to_numpy()
    out[found["at"].to_numpy()] = np.column_stack([found[c].to_numpy() / n for c in values]) if len(n) else 0
    if seen is not None and len(n):
        seen.append(round(n[found["at"].to_numpy() == 0][0]))
    return out


class Model:
    """Scores of units after units and of entries within their groups, and the normalisers, by matrix products."""

    def __init__(self, lexicon: Lexicon, p: np.ndarray, s: Settings):
        u, w = lexicon.units, s.width
        p = p.astype(np.float32)
        before, after, place = p[: u + 1, :w], p[u + 1 : 2 * u + 1, :w], p[2 * u + 1 : 2 * u + 4, :w]
        self.lexicon = lexicon
        self.one = (before * place[0]) @ after.T + p[u + 1 : 2 * u + 1, w]
        self.two = (before * place[1]) @ after.T
        self.log_z = np.empty((u + 1, u + 1), dtype=np.float32)
        for i in range(u + 1):
            self.log_z[i] = _log_sum(self.one[i] + self.two)
        self.inner, self.entries, self.bias = before * place[2], p[2 * u + 4 :, :w], p[2 * u + 4 :, w]
        self.inner_z = np.empty((u + 1, GROUPS), dtype=np.float32)
        for g, (low, high) in enumerate(zip(lexicon.entry_start[:-1], lexicon.entry_start[1:], strict=True)):
            self.inner_z[:, g] = _log_sum(self.inner @ self.entries[low:high].T + self.bias[low:high])

    def judge(self, texts: list[bytes]) -> list[tuple[int, int, float, float, list[bytes], list[int]]]:
        """Of each text: tokens, known frequent ones, base and model log10 without the counts of the words that follow,
        those words, and how often each occurs."""
        x, found = self.lexicon, tokens(texts)
        number, unit, entry, rare = x.numbered(found)
        one, two = contexts(unit, x.start)
        model = (self.one[one, unit] + self.two[two, unit] - self.log_z[one, two]).astype(np.float64)
        at = np.flatnonzero(entry >= 0)
        inner = np.einsum("ij,ij->i", self.inner.take(one[at], axis=0), self.entries.take(entry[at], axis=0)) + self.bias[entry[at]]
        model[at] += inner - self.inner_z[one[at], x.entry_group[entry[at]]]
        often = number >= 0
        model = model / np.log(10) + np.where(often, x.within[number], 0)
        ends = np.flatnonzero(unit == 0) + 1
        begins = np.concatenate([[0], ends[:-1]])
        sums = [np.add.reduceat(v, begins) for v in (np.where(often, x.known[number], False).astype(np.int64), np.where(often, x.base[number], 0.0), model)]
        # A word that is not frequent, by text and by its place among the distinct ones.
        size = len(found.distinct)
        pairs, times = np.unique(np.searchsorted(ends, rare, side="right") * size + found.code[rare], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(ends) + 1) * size).tolist()
        words, times = [found.distinct[i] for i in (pairs % size).tolist()], times.tolist()
        others = [(words[low:high], times[low:high]) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
        return [(*numbers, *more) for *numbers, more in zip((ends - begins).tolist(), *[v.tolist() for v in sums], others, strict=True)]


def _log_sum(score: np.ndarray) -> np.ndarray:
    top = score.max(axis=1)
    return top + np.log(np.exp(score - top[:, None]).sum(axis=1))


def lexicon(counts: DataFrame, s: Settings) -> Lexicon:
    """From written counts; brings the frequent tokens (at most 2^20) and one row per group to the driver."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = [(bytes(r["word"]), r["c"]) for r in counts.where((F.col("c") * FREQUENT >= n) | (F.col("word") == F.lit(END))).collect()]

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, tokens = np.zeros(GROUPS, dtype=np.int64), np.zeros(GROUPS, dtype=np.int64)
        for batch in batches:
            at = np.array([-1 if w == END else group(w) for w in batch.column(0).to_pylist()], dtype=np.int64)
            c = batch.column(1).to_numpy()
            many += np.bincount(at[at >= 0], minlength=GROUPS)
            np.add.at(tokens, at[at >= 0], c[at >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(many), pa.array(tokens)], names=["g", "w", "t"])

    sums = counts.mapInArrow(by_group, "g long, w long, t long").groupBy("g").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    many, tokens = np.zeros(GROUPS, dtype=np.int64), np.zeros(GROUPS, dtype=np.int64)
    for row in sums.collect():
        many[row["g"]], tokens[row["g"]] = row["w"], row["t"]
    return Lexicon(frequent, n, v, many, tokens, s)


def scored(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = prepare(docs.sparkSession)
    context = spark.sparkContext
    body = utf8(F.col("text"))
    training = docs.where(remainder(F.col("doc_id"), 10) != 0).select(body.alias("text"))
    counts = kept(counted(training), "counts")
    known = lexicon(counts, s)
    held, p = context.broadcast(known), known.initial(s)
    for turn in range(s.rounds if known.n else 0):
        p = _round(training, held, p, s, turn)
    model = context.broadcast(Model(known, p, s))
    schema = "n_tokens long, n_known long, base double, model double, others array<binary>, times array<long>"

    @F.pandas_udf(schema)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = [row for some in _some(texts) for row in model.value.judge(some)]
        return pd.DataFrame({"n_tokens": [r[0] for r in rows], "n_known": [r[1] for r in rows], "base": [r[2] for r in rows],
                             "model": [r[3] for r in rows], "others": [r[4] for r in rows], "times": [r[5] for r in rows]})

    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = kept(docs.select("doc_id", mark.alias("mark"), judge(body).alias("j")).select("doc_id", "mark", "j.*"), "judged")
    return _with_rare(rows, counts, known)


def _with_rare(rows: DataFrame, counts: DataFrame, known: Lexicon) -> DataFrame:
    """Adds the words whose counts are not broadcast: one row per word and document, joined on the word."""
    each = rows.select("doc_id", "mark", F.explode(F.arrays_zip("others", "times")).alias("x"))
    each = each.select("doc_id", "mark", F.col("x.others").alias("word"), F.col("x.times").alias("times"))
    rare = counts.where(F.col("c") * FREQUENT < known.n)
    each = each.join(rare, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    last, size = F.conv(F.substring(F.hex("word"), -2, 2), 16, 10).cast("int"), F.octet_length("word")
    kind = F.lit(5)
    for code, number in sorted(_ENDINGS.items()):
        kind = F.when(last == code, F.lit(number)).otherwise(kind)
    kind = F.when((last >= 128) | last.between(97, 122), F.lit(0)).otherwise(kind)
    place = kind * 4 + sum(((size > n).cast("int") for n in (4, 7, 11)), F.lit(0))
    spread = F.get(F.array(*[F.lit(float(x)) for x in known.spread]), place)
    log = F.log10(F.col("c") + F.lit(0.1))
    extra = each.select("doc_id", "mark", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("long").alias("n_tokens"),
                        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"),
                        (F.col("times") * (log - F.lit(known.total()))).alias("base"), (F.col("times") * (log - spread)).alias("model"))
    main = rows.select("doc_id", "mark", F.lit(1).cast("long").alias("rows"), "n_tokens", "n_known", "base", "model")
    both = main.unionAll(extra).groupBy("doc_id", "mark").agg(
        F.sum("rows").alias("rows"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "base", "model")])
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return both.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens",
                       F.expr("n_known div rows").alias("n_known"), F.lit(known.n).cast("long").alias("train_tokens"),
                       (F.col("base") / F.col("rows")).alias("base_score"), (F.col("model") / F.col("rows")).alias("score"))
