"""Benchmark decontamination: training passages as queries against a BM25 index of test items.

Test items are indexed once: postings per term, sorted by item, with the largest weight of every list and of every
block of items. Weights are divided by `threshold` times the item's own score, so an item is retrieved when the
weights of a passage's terms sum to 1. Passages are windows of twice the longest item's words, half overlapping, so
an item lies whole in one. Bounds prune in the order of block-max WAND: an item's cheapest terms cannot reach 1 by
themselves, so only its other postings are summed for all passages at once, and a passage goes on if some item's sum
plus its cheap rest could reach 1; its blocks of items are opened if the block maxima sum to 1; the postings of open
blocks are summed exactly. Every item at or above the threshold is then verified: at least `overlap` of the five-word
shingles of its question and of the words of its answer (what follows an answer mark, else its last sentence). An
item without an answer mark is also verified by as many of the five-word shingles of its whole text.

Documents are scanned once per shard of items and never shuffled. A shard holds at most `shard_chars` characters of
items; it is collected and broadcast, and that is its size bound. Document frequencies are those of all items.

Defined results: null or wordless items match nothing; null or wordless texts are clean; repeated items and rows are
judged like others; with no items every document is clean. An item without a second sentence has no answer to check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept, utf8
from plumbline.session import prepare


@dataclass(frozen=True)
class Rule:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6
    shingle: int = 5
    overlap: float = 0.8
    cheap: float = 0.6
    block: int = 16
    shard_chars: int = 1 << 23


RULE = Rule()
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ANSWER = re.compile(r"\n\s*(?:answer|a)\s*:", re.IGNORECASE)
_TOKENS = 1 << 18
FOUND = "item_id array<long>, score array<double>, question array<double>, answer array<double>"


def terms(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return text.translate(_TABLE).split()


def question_answer(text: str) -> tuple[str, str]:
    mark = _ANSWER.search(text)
    if mark:
        return text[: mark.start()], text[mark.end() :]
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def shingles(found: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(found[i : i + n]) for i in range(max(len(found) - n + 1, 1))} if found else set()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Index:
    """Postings of one shard of items; weights in units of what retrieves the item."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n: int, mean_length: float, rule: Rule):
        self.rule, self.ids, self.texts, self.vocabulary = rule, [], [], {}
        triples = []
        self.longest, rest = 8, []
        for item_id, text in items:
            found = terms(text.encode())
            if not found:
                continue
            tf: dict[bytes, int] = {}
            for t in found:
                tf[t] = tf.get(t, 0) + 1
            norm = rule.k1 * (1 - rule.b + rule.b * len(found) / mean_length)
            own = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (rule.k1 + 1) / (c + norm) for t, c in tf.items()}
            unit, spare = rule.threshold * sum(own.values()), 0.0
            for t in sorted(own, key=lambda t: (own[t], t)):
                weight = own[t] / unit
                cheap = spare + weight <= rule.cheap
                spare += weight if cheap else 0.0
                triples.append((self.vocabulary.setdefault(t, len(self.vocabulary)), len(self.ids), weight, not cheap))
            question, answer = question_answer(text)
            self.ids.append(item_id)
            whole = set() if _ANSWER.search(text) else shingles(found, rule.shingle)
            self.texts.append((shingles(terms(question.encode()), rule.shingle), set(terms(answer.encode())), whole))
            rest.append(spare)
            self.longest = max(self.longest, len(found))
        triples.sort(key=lambda x: x[:2])
        term, item, weight, needed = (np.array(x) for x in zip(*triples, strict=True)) if triples else (np.empty(0, int),) * 4
        self.spare, size = np.array(rest), len(self.vocabulary)
        self.item, self.weight = item, weight
        self.count = np.bincount(term, minlength=size)
        self.start = np.cumsum(self.count) - self.count
        needed = needed.astype(bool)
        self.need_item, self.need_weight = item[needed], weight[needed]
        self.need_count = np.bincount(term[needed], minlength=size)
        self.need_start = np.cumsum(self.need_count) - self.need_count
        blocks = item // rule.block
        first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(blocks) != 0)]) if len(term) else np.empty(0, int)
        self.block, self.block_max = blocks[first], np.maximum.reduceat(weight, first) if len(term) else weight
        self.block_count = np.bincount(term[first], minlength=size)
        self.block_start = np.cumsum(self.block_count) - self.block_count

    def retrieve(self, passage: np.ndarray) -> list[tuple[int, float]]:
        """Distinct terms of a passage -> items at or above the threshold, with their scores in its units."""
        at = _ranges(self.block_start[passage], self.block_count[passage])
        open_block = np.bincount(self.block[at], self.block_max[at]) >= 1 - 1e-9
        if not open_block.any():
            return []
        at = _ranges(self.start[passage], self.count[passage])
        at = at[open_block[self.item[at] // self.rule.block]]
        score = np.bincount(self.item[at], self.weight[at])
        return [(int(i), float(score[i])) for i in np.flatnonzero(score >= 1 - 1e-9)]

    def hopeful(self, ids: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Windows in which some item can still reach 1, judged by the postings it cannot do without."""
        some = self.need_count[ids] > 0
        ids, window = ids[some], window[some]
        n = self.need_count[ids]
        at = _ranges(self.need_start[ids], n)
        key = np.repeat(window, n) * len(self.ids) + self.need_item[at]
        order = np.argsort(key)
        key, weight = key[order], self.need_weight[at][order]
        if not len(key):
            return key
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        reached = np.add.reduceat(weight, first) + self.spare[key[first] % len(self.ids)] >= 1 - 1e-9
        return np.unique(key[first][reached] // len(self.ids))

    def judge(self, texts: list[bytes]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the verified items: index -> (score, question overlap, answer overlap) of its best passage."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        stride, waiting, held = self.longest, [], 0
        for k, text in enumerate(texts):
            found = terms(text)
            n, step = max(-(-len(found) // stride) - 1, 1), max(_TOKENS // stride, 1)
            for first in range(0, n, step):
                many = min(step, n - first)
                waiting.append((k, many, found[first * stride : (first + many + 1) * stride]))
                held += len(waiting[-1][2])
            if held >= _TOKENS:
                self._passages(waiting, out)
                waiting, held = [], 0
        self._passages(waiting, out)
        return out

    def _passages(self, pieces: list[tuple[int, int, list[bytes]]], out: list[dict]) -> None:
        stride, look = self.longest, self.vocabulary.get
        ids = np.array([look(t, -1) for _, _, found in pieces for t in found], dtype=np.int64)
        if not len(ids):
            return
        lengths = np.array([len(found) for _, _, found in pieces])
        windows = np.array([many for _, many, _ in pieces])
        base, start = np.cumsum(windows) - windows, np.cumsum(lengths) - lengths
        of = (np.arange(len(ids)) - np.repeat(start, lengths)) // stride
        low, high, known = np.repeat(base, lengths), np.repeat(windows, lengths), ids >= 0
        one, two = known & (of < high), known & (of >= 1)
        hopeful = self.hopeful(np.concatenate([ids[one], ids[two]]), np.concatenate([(low + of)[one], (low + of - 1)[two]]))
        for w in hopeful:
            piece = int(np.searchsorted(base, w, side="right")) - 1
            k, _, found = pieces[piece]
            begin = int(w - base[piece]) * stride
            passage = np.unique(ids[start[piece] + begin : start[piece] + min(begin + 2 * stride, lengths[piece])])
            retrieved = self.retrieve(passage[passage >= 0])
            if retrieved:
                self._verify(found[begin : begin + 2 * stride], retrieved, out[k])

    def _verify(self, passage: list[bytes], retrieved: list[tuple[int, float]], out: dict) -> None:
        runs, single = {}, set(passage)
        for i, score in retrieved:
            question, answer, whole = self.texts[i]
            asked = self._share(question, passage, runs) if question else 1.0
            told = len(answer & single) / len(answer) if answer else 1.0
            verified = min(asked, told) >= self.rule.overlap or self._share(whole, passage, runs) >= self.rule.overlap
            if verified and score > out.get(i, (0.0,))[0]:
                out[i] = (score, asked, told)

    @staticmethod
    def _share(wanted: set[bytes], passage: list[bytes], runs: dict[int, set[bytes]]) -> float:
        """Share of shingles that a passage holds; its own are kept in `runs` by their number of words."""
        if not wanted:
            return 0.0
        size = len(next(iter(wanted)).split())
        if size not in runs:
            runs[size] = shingles(passage, size)
        return len(wanted & runs[size]) / len(wanted)


def shards(items: DataFrame, rule: Rule = RULE) -> list[Index]:
    """The index, in shards of bounded size; statistics are those of all items."""
    items = kept(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "items")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms(t.encode()) for t in batch["text"]]
            yield pd.DataFrame({"term": [t for f in found for t in {*f, b""}], "n": [len(f) if t == b"" else 1 for f in found for t in {*f, b""}]})

    seen = items.mapInPandas(split, "term binary, n long").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    seen = kept(seen, "terms")
    every = seen.where(F.length("term") == 0).first()
    if every is None or not every["n"]:
        return []
    chars = items.agg(F.sum(F.length("text"))).first()[0]
    parts, out = -(-int(chars) // rule.shard_chars), []
    for k in range(parts):
        shard = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        own = shard.mapInPandas(split, "term binary, n long").select("term").distinct()
        df = {bytes(r["term"]): r["df"] for r in seen.join(own, "term", "left_semi").collect()}
        rows = sorted(((r["item_id"], r["text"]) for r in shard.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        out.append(Index(rows, df, every["df"], every["n"] / every["df"], rule))
    return [x for x in out if x.ids]


def matched(docs: DataFrame, text: Column, index: Index) -> Column:
    """The verified items of each text, as parallel arrays."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(FOUND)
    def of(texts: pd.Series) -> pd.DataFrame:
        own = held.value
        rows = [sorted(x.items()) for x in own.judge(list(texts))]
        columns = [[[own.ids[i] for i, _ in r] for r in rows], [[own.rule.threshold * s for _, (s, _, _) in r] for r in rows],
                   [[a for _, (_, a, _) in r] for r in rows], [[b for _, (_, _, b) in r] for r in rows]]
        return pd.DataFrame(dict(zip(("item_id", "score", "question", "answer"), columns, strict=True)))

    return of(utf8(text))


def leaks(docs: DataFrame, items: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, item_id, score (share of the item's own BM25 score), question_overlap, answer_overlap."""
    prepare(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in shards(items, rule):
        found = docs.select("doc_id", matched(docs, F.col("text"), index).alias("m"))
        each = found.select("doc_id", F.explode(F.arrays_zip("m.item_id", "m.score", "m.question", "m.answer")).alias("x"))
        out = out.unionAll(each.select("doc_id", "x.item_id", "x.score", "x.question", "x.answer"))
    return out


def clean(docs: DataFrame, items: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The documents in which no test item was verified, with their own columns."""
    prepare(docs.sparkSession)
    for index in shards(items, rule):
        rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("body"))
        docs = rows.where(F.size(matched(docs, F.col("body"), index)["item_id"]) == 0).select("row.*")
    return docs
