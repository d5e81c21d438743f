"""Line windows, fingerprints, anchors and components against brute force."""

import random
import xxhash

import numpy as np
import pytest

from plumbline.llm import anchors, linewindows, links
from tests.llm.conftest import LONG, ODD, frame


def cut_by_hand(rows):
    """(doc_id, text) -> text without the lines of windows seen before, in (doc_id, line) order."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, linewindows_mark(r[1])))
    seen, out = set(), {}
    for doc_id, text in order:
        if text is None:
            out[doc_id, text] = None
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip(" "):
                if window in seen:
                    gone.update(range(i, i + 3))
                seen.add(window)
        out[doc_id, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def linewindows_mark(text):
    return np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64)


def test_line_windows_equal_brute_force(spark, odd):
    rows = [*ODD, (20, "p\nq\nr\nq\nr\np\nq\nr\nz"), (21, "a\na\na\na\na\na"), (22, "x\ny\n\n\n\n\nz"), (23, "x\ny\n\n\n\n\nz")]
    want = cut_by_hand([r[:2] for r in rows])
    got = linewindows.without_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    before = sorted((repr(want[r[0], r[1]]), repr(r[0])) for r in rows)
    assert sorted((repr(r["text"]), repr(r["doc_id"])) for r in got) == before
    assert all(r["n_lines"] == 0 for r in got if r["text"] is None)


def test_line_windows_keep_columns_and_lengths(spark, odd, none):
    done = linewindows.without_repeats(odd)
    assert done.columns == [*odd.columns, "n_lines", "n_removed"]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in done.collect())
    assert linewindows.without_repeats(none).count() == 0


@pytest.mark.parametrize("text", ["", "one", "One two", "a b c d", "a b c d e a b c d", "É b\tc\x0bd e", LONG[:3000]])
def test_fingerprints(text):
    found = text.encode().lower().split()
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(len(found) - 3, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert anchors.fingerprint(text.encode()) % 2**64 == want


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def by_hand(values, bits=4):
    parent = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) % 2**64).count("1") <= bits:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {frozenset(v for v in values if find(parent, v) == r) for r in {find(parent, v) for v in values}}


@pytest.mark.parametrize("homes", [anchors.HOMES, 3])
def test_anchors_lose_no_link(spark, homes):
    draw = random.Random(5)
    values = []
    for _ in range(12):
        centre = draw.getrandbits(64)
        for k in range(12):  # chains and stars of flips over all bits
            flips = sum(1 << b for b in draw.sample(range(64), draw.choice([0, 1, 2, 4, 5])))
            values.append((centre ^ flips if k % 2 or not values else values[-1] ^ flips))
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    prints = spark.createDataFrame([(v, 0, v) for v in values], "fp long, family int, node long")
    got = {}
    for r in anchors.grouped(prints, homes).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == by_hand(values)


def test_every_word_is_near_an_anchor_and_meets_its_neighbours():
    syndromes = anchors._syndromes()
    moves = anchors._moves(21, anchors.REACH, syndromes)
    draw = np.random.default_rng(1)
    for x in draw.integers(0, 1 << 21, 200):
        s = syndromes[x & 0x7FFF]
        home = x ^ (1 << (s - 1) if s else 0)
        assert syndromes[home & 0x7FFF] == 0
        y = x ^ (1 << int(draw.integers(21)))
        assert home in (y ^ moves[syndromes[y & 0x7FFF]])


def test_near_duplicates_of_odd_documents(spark, odd, none):
    rows = anchors.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r["fp"] == 0]
    assert len(empty) == 5 and {r["component_id"] for r in empty} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {2, None}
    assert anchors.near_duplicates(none).count() == 0


def print_by_hand(text, n=4):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + n]) for i in range(max(len(found) - n + 1, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def kept_by_hand(rows):
    """The first (id, text) of every component of fingerprints at most four bits apart, null ids last."""
    prints = {t: print_by_hand(t) for _, t in rows}
    component = {v: min(c) for c in by_hand(sorted(set(prints.values()))) for v in c}
    best = {}
    for i, t in rows:
        best.setdefault(component[prints[t]], []).append((i is None, i or 0))
    return sorted(min(found) for found in best.values())


def test_one_per_group_equals_brute_force(spark, none):
    draw = random.Random(3)
    rows = [r[:2] if len(r) > 1 else (*r, None) for r in ODD if r[0] != 5]
    for k in range(25):
        base = [f"word{draw.randrange(5000)}" for _ in range(draw.choice([3, 40, 300]))]
        rows += [(100 + 10 * k, " ".join(base)), (101 + 10 * k, " ".join(base).upper())]
        for j in range(6):
            at, more = draw.randrange(len(base)), draw.randrange(1, 4)
            rows.append((102 + 10 * k + j, " ".join([*base[:at], *["new"] * more, *base[at + draw.randrange(3) :]])))
    rows += [(31, rows[-1][1]), (31, rows[-1][1]), (None, rows[-1][1])]
    draw.shuffle(rows)
    docs = frame(spark, rows)
    left = anchors.one_per_group(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == kept_by_hand(rows)
    assert anchors.one_per_group(none).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(7)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)] + [(500, 501)],
             "random": [(draw.randrange(80), draw.randrange(80)) for _ in range(50)], "none": []}[shape]
    got = {}
    for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        parent[find(parent, a)] = find(parent, b)
    want = {}
    for x in parent:
        want.setdefault(find(parent, x), set()).add(x)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}
