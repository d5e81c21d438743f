"""Source divergence against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import divergence
from tests.llm.conftest import ODD, frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def by_hand(rows, min_docs=3, ranks=200):
    rows = [(lang or "", source or "", terms_of(text)) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, groups = Counter(), defaultdict(Counter)
        for where, source, terms in rows:
            if where == lang:
                docs.update(set(terms))
                groups[source].update(terms)
        kept = [t for t, n in docs.items() if n >= min_docs]
        whole = Counter()
        for counts in groups.values():
            whole.update(counts)

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            mark = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", mark)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


def listed(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(n=150, sources=5):
    draw = random.Random(2)
    base = ["a", "B", "wordy", "Eightlen", "ninechars", "exactlysixteench", "seventeencharslon", "ünïcödé", "日本語の長い言葉です", "x" * 40, "y" * 33, "Wörter", "Ab", "aB"]
    base += ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 22))) for _ in range(60)]
    return [(i, " ,".join(draw.choices(base, k=draw.randint(0, 40))), draw.choice(["de", "en", "en"]), f"s{min(int(draw.expovariate(0.7)), sources)}")
            for i in range(n)]


@pytest.mark.parametrize("chunk", [64, 2])
def test_equals_counting_by_hand(spark, chunk):
    rows = [*some_rows(), *[(*r, *[None] * (4 - len(r))) for r in ODD], (900, "solo terms only here", "xx", "s1"), (901, "", "xx", "s2"), (902, None, "yy", None)]
    got = listed(divergence.audited(frame(spark, rows).repartition(5), chunk=chunk))
    assert got == by_hand(rows)
    assert listed(divergence.audited(frame(spark, rows), min_docs=1, ranks=3)) == by_hand(rows, 1, 3)


def test_no_rows(none):
    assert listed(divergence.audited(none)) == []


@pytest.mark.parametrize("piece", [10, 64, 1 << 20])
def test_counts_in_pieces(monkeypatch, piece):
    rows = some_rows(40)
    texts, groups = [t.encode() for _, t, _, _ in rows], np.array([int(s[1:]) for *_, s in rows], dtype=np.uint32)
    got, docs = Counter(), Counter()
    for found in divergence.counted(texts, groups, piece):
        for counts in found.values():
            names = divergence._terms(counts).to_pylist()
            for t, g, n, d in zip(names, counts.group.tolist(), counts.n.tolist(), counts.docs.tolist(), strict=True):
                got[t, g] += n
                docs[t, g] += d
    want, seen = Counter(), Counter()
    for (_, text, _, s) in rows:
        want.update((t, int(s[1:])) for t in terms_of(text))
        seen.update({(t, int(s[1:])) for t in terms_of(text)})
    assert got == want and docs == seen


def test_merging_and_flushing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 8)
    monkeypatch.setattr(divergence, "_EMIT", 5)
    rows = some_rows(60)
    import pyarrow as pa
    batches = [pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows[i : i + 7]]), pa.array([r[3] for r in rows[i : i + 7]]),
                                           pa.array([r[1].encode() for r in rows[i : i + 7]])], names=["lang", "source", "text"]) for i in range(0, 60, 7)]
    got = Counter()
    for batch in divergence._rows(iter(batches)):
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[lang, source, term] += n
    assert got == Counter((r[2], r[3], t) for r in rows for t in terms_of(r[1]))


def test_shares_do_not_overflow():
    count, total, terms = 8_000_000_000_123, 9_000_000_000_000, 12_345
    assert divergence.shares(np.array([count]), np.array([total]), terms)[0] == 1 + 1_000_000_000 * (count + 1) // (total + terms)
