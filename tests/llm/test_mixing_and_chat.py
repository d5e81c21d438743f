"""Curriculum mix, perspectives and separator scan against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import curriculum, perspectives, separators
from tests.llm.conftest import ODD, frame


def shares(sizes, weights, share, epochs):
    """Target per source by handing out the excess again and again."""
    left, out = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    open_ = set(sizes)
    while left > 1e-9 and open_:
        unit = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            out[s] += unit * weights[s]
            if out[s] >= epochs * sizes[s]:
                left += out[s] - epochs * sizes[s]
                out[s] = epochs * sizes[s]
                open_.discard(s)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(0)
    names = ["a", "b", "é", "Z", None]
    rows = [(i, " ".join(["w"] * int(draw.integers(0, 40))), "en", names[min(int(draw.integers(0, 9)), 4)]) for i in range(400)]
    return frame(spark, [*rows, *ODD])


def test_mix_meets_its_targets(docs):
    rows = curriculum.planned(docs).select("row.source", "doc_id", "size", "source_size", "target", "taken", "position").collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    want = shares(sizes, weights, 1.5, 2)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 0.5
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert all((r["position"] is None) == (r["taken"] == 0) and 0 <= (r["position"] or 0) <= 1 for r in rows)


def test_mix_is_the_same_again_and_in_order(docs):
    plan = lambda d: sorted(map(repr, curriculum.planned(d).select("doc_id", "size", "taken", "position").collect()))
    assert plan(docs) == plan(docs.repartition(7))
    mixed = curriculum.training_order(docs)
    assert [c for c in mixed.columns if c not in docs.columns] == ["epoch", "taken", "position"]
    rows = mixed.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    total = curriculum.planned(docs).agg(F.sum("taken")).first()[0]
    assert sum(r["taken"] for r in rows) == total and all(r["taken"] <= r["size"] for r in rows)


def test_mix_without_words(spark, none):
    assert curriculum.planned(none).count() == 0
    assert curriculum.training_order(none).count() == 0
    rows = curriculum.planned(frame(spark, [(1, None), (2, "", "en", "a")])).collect()
    assert [(r["taken"], r["target"]) for r in rows] == [(0, 0.0)] * 2


@pytest.mark.parametrize("knots", [(0.5, 1.0, 1.5), (1.5, 1.0, 0.5), (1.0, 1.0), (0.0, 2.0), (3.0, 0.1, 0.1, 3.0)])
def test_inverse_of_the_demand(spark, knots):
    times = np.linspace(0, 1, 200001)
    weight = np.interp(times, np.linspace(0, 1, len(knots)), knots)
    due = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    due /= due[-1]
    asked = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999]
    rows = spark.createDataFrame([(x,) for x in asked], "x double").select("x", curriculum.invert(F.col("x"), knots).alias("t")).collect()
    for r in rows:
        assert np.interp(r["t"], times, due) == pytest.approx(r["x"], abs=1e-5)


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|end|> you"), (1, 2, "bob |x>", None), (1, 1, "assistant", "again"), (1, None, None, "late"),
    (1, -1, "system", "be kind"), (2, 0, "system", "nobody"), (None, 0, "user", "a"), (None, 1, "user", "b"), (3, 5, "user", ""), (3, 5, "user", ""),
    *[(4, i, ("ann", "bob", "cy")[i % 3], f"turn {i}") for i in range(30)],
]


def rotate(turns, size):
    out, talks = {}, {}
    for c, at, role, text in turns:
        talks.setdefault(c, []).append((at is None, at or 0, role or "unknown", text or ""))
    for c, rows in talks.items():
        rows.sort()
        for who in {r[2] for r in rows} - {"system"}:
            for piece in range(-(-len(rows) // size)):
                text, masks = "", []
                for _, _, role, body in rows[piece * size : (piece + 1) * size]:
                    name = "".join("_" if ch in " |<>" else ch for ch in role)
                    text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={name}|>\n"
                    start = len(text)
                    text += body.replace("<|", "< |") + "<|end|>\n"
                    if role == who:
                        masks.append((start, len(text)))
                out[c, who, piece] = (text, masks)
    return out


@pytest.mark.parametrize("form", [perspectives.FORMAT, perspectives.Format(turns=4, rows_per_block=5)])
def test_perspectives_equal_brute_force(spark, form):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("number", F.lit("x")).withColumn("piece", F.lit(1)).withColumn("block", F.lit(2))
    got = {(r["conv_id"], r["participant"], r["piece"]): r for r in perspectives.perspectives(turns, form).collect()}
    want = rotate(TURNS, form.turns)
    assert got.keys() == want.keys()
    for key, (text, masks) in want.items():
        assert (got[key]["text"], [tuple(m) for m in got[key]["masks"]]) == (text, masks)
        assert got[key]["n_masked"] == len(masks)
    assert perspectives.perspectives(turns.limit(0), form).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_separator_scan_round_trip(spark, odd, none, block):
    layout = separators.Layout(block_tokens=block)
    encode = separators.encoder().encode_ordinary
    rows = [r for r in ODD if r[0] != 5]
    got = sorted((repr(r["doc_id"]), r["n_tokens"]) for r in separators.token_counts(frame(spark, rows), layout=layout).collect())
    assert got == sorted((repr(r[0]), len(encode(r[1] or ""))) for r in rows)
    assert separators.token_counts(none, layout=layout).count() == 0


def test_separators_across_blocks_and_open_ends(spark, tmp_path):
    draw = np.random.default_rng(2)
    layout = separators.Layout(end_ids=(7, 9), dtype="<u4", block_tokens=64)
    want = {}
    for name, n in (("one", 200_000), ("two", 5), ("three", 70_000)):
        flat = draw.integers(10, 1000, n).astype("<u4")
        ends = np.sort(draw.choice(n, n // 5000 + 1, replace=False)) if name != "two" else np.array([0, 4])
        flat[ends] = draw.choice([7, 9], len(ends))
        if name == "three":
            flat[-1] = 7
            ends = np.unique([*ends, n - 1])
        (tmp_path / name).write_bytes(flat.tobytes())
        sizes = [(int(x), True) for x in np.diff([-1, *ends]) - 1]
        want[name] = sizes + ([(int(n - 1 - ends[-1]), False)] if ends[-1] < n - 1 else [])
    got = {}
    for r in separators.lengths(separators.flat_files(spark, str(tmp_path), layout), layout).orderBy("ordinal").collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["n_tokens"], r["ended"]))
    assert got == want
