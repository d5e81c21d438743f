"""Quality network, language model and neighbours: held-out accuracy and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bilinear, multiindex, quality
from plumbline.llm.common import words
from tests.llm.conftest import ODD, frame


def crc(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def corpus(n=240):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice(["ka", "to", "ri", "mes", "lan"]) for _ in range(draw.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        found = [word() for _ in range(draw.randint(20, 60))]
        found = found if good else [w.upper() + "!!" for w in found] if i % 8 else [w for w in found[:5] for _ in range(8)]
        rows.append((100 + i, " ".join(found) + ("." if good else "")))
        labels.append((100 + i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus()
    labels += [(100, 0), (None, 1), (101, None), (102, 5), (99999, 1)]
    docs, marks = frame(spark, [*rows, *ODD]), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.scored(docs, marks, quality.Settings(words=500)).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    truth = dict(labels[:240])
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    left = quality.accepted(docs, marks, quality.Settings(words=500))
    assert left.columns == docs.columns
    assert left.count() == sum(r["predicted"] for r in got)


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(1, 1), (3, 1), (None, 0)], 1.0), ([(1, 0)], 0.0)])
def test_quality_without_two_kinds_of_labels(spark, odd, none, labels, want):
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(odd, marks).collect()} == {want}
    assert quality.scored(none, marks).count() == 0


def test_temperature_calibrates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 8))
    y = (draw.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.train(x, y)
    z = (draw.normal(size=(4000, 8)))
    score = 1 / (1 + np.exp(-((np.tanh((z - p["mean"]) / p["scale"] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]) / p["temperature"])))
    for low in (0.0, 0.25, 0.5, 0.75):
        at = (score >= low) & (score < low + 0.25)
        assert abs(score[at].mean() - (1 / (1 + np.exp(-2 * z[at, 0]))).mean()) < 0.08


def base_by_hand(rows):
    found = [((t or "").encode().lower().split() + [b"\n"], i, t) for i, t in rows]
    counts = Counter(w for ws, i, _ in found if crc(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    log = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return n, [(repr(i), len(ws), sum(counts[w] > 0 for w in ws), round(sum(map(log, ws)), 6)) for ws, i, _ in found]


@pytest.mark.parametrize("frequent", [1 << 20, 8, 200])
def test_language_model_counts_and_learning(spark, monkeypatch, frequent):
    monkeypatch.setattr(bilinear, "FREQUENT", frequent)
    rows = [(i, " ".join(f"{a}{(i + k) % 7}. then{a}" for k, a in enumerate("abcdefg" * 3))) for i in range(120)] + [r[:2] for r in ODD if r[0] != 5]
    got = bilinear.scored(frame(spark, rows)).collect()
    n, want = base_by_hand(rows)
    assert {r["train_tokens"] for r in got} == {n}
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["held_out"] == (crc(r["doc_id"], 10) == 0) and r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert len(held) > 5
    if frequent == 1 << 20:
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_that_are_joined_get_the_same_scores(spark, monkeypatch):
    """A word's chance within its group does not depend on how its count arrives."""
    rows = [(i, " ".join(f"w{(i * k) % 23} a.{k % 5}" for k in range(30))) for i in range(40)]
    settings = bilinear.Settings(units=5, rounds=0)
    one = {r["doc_id"]: r["score"] for r in bilinear.scored(frame(spark, rows), settings).collect()}
    monkeypatch.setattr(bilinear, "FREQUENT", 14)
    two = {r["doc_id"]: r["score"] for r in bilinear.scored(frame(spark, rows), settings).collect()}
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], rel=1e-6) for i in one)


def test_normalised_over_units_and_words():
    counts = {b"the": 50, b"of": 30, b"cat": 3, b"dog.": 2, b"\n": 10}
    many, tokens = np.zeros(bilinear.GROUPS), np.zeros(bilinear.GROUPS)
    for w, c in counts.items():
        if w != b"\n":
            many[bilinear.group(w)] += 1
            tokens[bilinear.group(w)] += c
    s = bilinear.Settings(units=3)
    x = bilinear.Lexicon(list(counts.items()), sum(counts.values()), len(counts), many, tokens, s)
    m = bilinear.Model(x, x.initial(s), s)
    chance = np.exp(m.one[:, None, :] + m.two[None, :, :] - m.log_z[:, :, None])
    assert np.allclose(chance.sum(axis=2), 1, atol=1e-4)
    for g in range(bilinear.GROUPS):  # known words and one unknown word share a group's chance
        known = [x.within[x.number[w]] for w in (b"cat", b"dog.") if bilinear.group(w) == g]
        assert sum(10**k for k in known) + 10 ** (np.log10(0.1) - x.spread[g]) == pytest.approx(1)


def test_language_model_without_training_texts(spark, none):
    got = bilinear.scored(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 2 and all(r["score"] < 0 for r in got)
    assert bilinear.scored(none).count() == 0


def nearest_by_hand(rows, asked, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i, tuple(v)] = np.array(v, dtype=float)
    out = set()
    for (i, v), x in fine.items():
        if asked(i):
            scored = sorted((-round(float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)), 9), j) for (j, _), y in fine.items() if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_neighbours_equal_brute_force_when_all_cells_are_walked(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(150)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(150, 190)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [math.nan, 1.0, 1.0, 1.0]), (204, [math.inf, 1.0, 1.0, 1.0]),
             (205, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (160, [1.0, 2.0, 3.0, 4.0]), (210, [2.0, 4.0, 6.0, 8.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("key", F.lit("k"))
    for s in (multiindex.Settings(probe_share=1.0), multiindex.Settings(probe_share=1.0, block=8, occupancy=2, salts=2)):
        got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in multiindex.nearest(vectors, F.col("vec_id") % 10 == 0, s).collect()}
        assert got == nearest_by_hand(rows, lambda i: i % 10 == 0)


def test_neighbours_recall_and_small_tables(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 16))
    x = centres[draw.integers(0, 40, 4000)] + 0.3 * draw.normal(size=(4000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multiindex.nearest(vectors, F.col("vec_id") % 50 == 0, multiindex.Settings(probe=400, probe_share=0.0)).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        near = np.argsort(-(u @ u[q]))
        hits += len({int(i) for i in near if i != q and i in set(near[:6])} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / 400 >= 0.9
    got = multiindex.nearest(vectors, F.col("vec_id") % 50 == 0).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    true = {(q, int(i)) for q in range(0, 4000, 50) for i in [j for j in np.argsort(-(u @ u[q]))[:6] if j != q][:5]}
    assert len(found & true) / len(true) >= 0.9
    s = multiindex.Settings()
    share = multiindex.fitted(multiindex.entries(vectors, s), 4000, s).share
    assert 0.001 < share < 0.1
    plain = draw.normal(size=(1500, 16))
    loose = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(plain)], "vec_id long, embedding array<double>")
    assert share < multiindex.fitted(multiindex.entries(loose, s), 1500, s).share < 0.9
    few = vectors.limit(3)
    assert multiindex.nearest(few, F.lit(True)).count() == 6
    assert multiindex.nearest(vectors.limit(0), F.lit(True)).count() == 0
    assert multiindex.nearest(vectors.limit(1), F.lit(True)).count() == 0


def test_language_model_trains_on_every_position_once(spark):
    rows = [(i, " ".join(["a", "b", "c"] * (i % 5))) for i in range(40)]
    texts = frame(spark, rows).select(F.col("text").cast("binary").alias("text"))
    s = bilinear.Settings(units=4)
    x = bilinear.lexicon(bilinear.counted(texts), s)
    held, seen, p = spark.sparkContext.broadcast(x), [], x.initial(s)
    for turn in range(s.rounds):
        q = bilinear._round(texts.coalesce(1), held, p, s, turn, seen)
        assert not np.array_equal(p, q)
        p = q
    assert sum(seen) == sum(len(t.split()) + 1 for _, t in rows)


def test_second_level_learns_and_is_normalised(spark):
    """Two kinds of texts share their frequent words; which further words follow depends on the one before."""
    draw = random.Random(4)
    rows = []
    for i in range(400):
        side = "ab"[i % 2]
        rows.append((i, " ".join(f"{side} {side}word{draw.randrange(40)}" for _ in range(30))))
    texts = frame(spark, rows)
    score = lambda s: sum(r["score"] for r in bilinear.scored(texts, s).where("held_out").collect())
    flat, two = score(bilinear.Settings(units=3, words=0)), score(bilinear.Settings(units=3, least=2))
    assert two > flat + 0.05 * abs(flat)
    counts = {w.encode(): 40 - k for k, w in enumerate(["a", "b", "xyz", "xyw", "long_word", "end."])} | {b"\n": 10}
    many, tokens = np.zeros(bilinear.GROUPS), np.zeros(bilinear.GROUPS)
    for w, c in counts.items():
        if w != b"\n":
            many[bilinear.group(w)] += 1
            tokens[bilinear.group(w)] += c
    s = bilinear.Settings(units=3)
    x = bilinear.Lexicon(list(counts.items()), sum(counts.values()), len(counts), many, tokens, s)
    p = x.initial(s) + np.random.default_rng(1).normal(size=x.initial(s).shape)
    m = bilinear.Model(x, p, s)
    for g, (low, high) in enumerate(zip(x.entry_start[:-1], x.entry_start[1:], strict=True)):
        chance = np.exp(m.inner @ m.entries[low:high].T + m.bias[low:high] - m.inner_z[:, [g]])
        assert np.allclose(chance.sum(axis=1), 1, atol=1e-3)


def test_tokens_of_some_texts_are_looked_up_once_each():
    asked = []

    class Told(dict):
        def get(self, word, default=None):
            asked.append(word)
            return super().get(word, default)

    texts = [b" The cat\x0bTHE \x1c cat \xc3\x84 \xff\x85x ", b"", b" \t\n", b"cat  The\r\x0c\xc3\xa4", b"the end"]
    want = [w for text in texts for w in (*words(text), bilinear.END)]
    counts, many, held = {bilinear.END: 4, b"the": 3, b"cat": 2}, np.zeros(bilinear.GROUPS), np.zeros(bilinear.GROUPS)
    many[bilinear.group(b"the")], held[bilinear.group(b"the")] = 2, 5
    x = bilinear.Lexicon(list(counts.items()), 9, 3, many, held, bilinear.Settings(units=2, least=2))
    known, x.number = x.number, Told(x.number)
    number, unit, entry, rare = x.numbered(bilinear.tokens(texts))
    assert number.tolist() == [known.get(w, -1) for w in want] and rare.tolist() == [i for i, w in enumerate(want) if w not in known]
    assert unit.tolist() == [0 if w == bilinear.END else 1 if w == b"the" else x.first_group + bilinear.group(w) for w in want]
    assert sorted(asked) == sorted(set(want))
    found, sizes = bilinear.split(texts)
    assert found.to_pylist() == [w for w in want if w != bilinear.END] and sizes.tolist() == [len(words(t)) for t in texts]
    got = bilinear.Model(x, x.initial(bilinear.Settings()), bilinear.Settings()).judge(texts)
    assert [dict(zip(r[4], r[5], strict=True)) for r in got] == [Counter(w for w in words(t) if w not in known) for t in texts]


def test_a_step_within_groups_equals_sums_over_pairs():
    counts = {bilinear.END: 9, **{w: 9 - i for i, w in enumerate((b"the", b"cat", b"dog", b"sun", b"lamp.", b"moon.", b"horizon"))}}
    many, held = np.zeros(bilinear.GROUPS), np.zeros(bilinear.GROUPS)
    for w, c in counts.items():
        if w != bilinear.END:
            many[bilinear.group(w)] += 1
            held[bilinear.group(w)] += c
    s = bilinear.Settings(units=2, least=2, inner_noise=3, width=4)
    x = bilinear.Lexicon(list(counts.items()), sum(counts.values()), len(counts), many, held, s)
    found = bilinear.tokens([b"the cat sun dog cat moon.", b"dog lamp. horizon sun cat"])
    _, unit, entry, _ = x.numbered(found)
    one, _ = bilinear.contexts(unit, x.start)
    p = x.initial(s)
    p[2 * x.units + 4 :, :4] = np.random.default_rng(1).normal(0, 1, (len(x.entry_mass), 4))
    t, g = bilinear.Trainer(p, x, s, 7), np.zeros((2 * x.units + 4, 5), dtype=np.float32)
    at = np.flatnonzero(entry >= 0)
    t._within(one[at], entry[at], g)

    head, place = 2 * x.units + 4, p[2 * x.units + 3, :4].astype(float)
    sums, times = np.zeros((len(x.entry_mass), 5)), np.zeros(len(x.entry_mass))
    before, scale = np.zeros((x.units + 1, 4)), np.zeros(4)
    for k in range(bilinear.GROUPS):
        mine = [i for i in at if x.entry_group[entry[i]] == k]
        for some in (mine[i : i + 3] for i in range(0, len(mine), 3)):
            for i in some:
                r = p[one[i], :4].astype(float)
                times[entry[i]] += 1
                for j, real in [(i, True), *((j, False) for j in some)]:
                    v = p[head + entry[j]].astype(float)
                    score = r * place @ v[:4] + v[4] - np.log(x.entry_share[entry[j]] * len(some))
                    slope = 1 / (1 + np.exp(score)) if real else -1 / (1 + np.exp(-score))
                    sums[entry[j]] += slope * np.append(r * place, 1)
                    before[one[i]] += slope * v[:4] * place
                    scale += slope * v[:4] * r
    met = np.flatnonzero(times)
    mean = sums[met] / times[met, None]
    assert np.allclose(t.p[head + met], p[head + met] + s.rate * mean / np.sqrt(1e-2 + mean**2), atol=1e-4)
    assert np.allclose(g[: x.units + 1, :4], before, atol=1e-5) and np.allclose(g[2 * x.units + 3, :4], scale, atol=1e-5)
    assert (t.met == times).all()
