"""Decontamination and personal data against brute force."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from plumbline.llm import decontaminate, personal
from tests.llm.conftest import LONG, ODD, frame

ITEMS = [
    (1, "What is the name of the river that runs through the old town of Esk? It is the river Ewe."),
    (2, "Compute the sum of all numbers from one to one hundred, both included.\nAnswer: five thousand and fifty"),
    (3, "One sentence alone without an answer but with words enough to be found again"),
    (4, None), (5, ""), (None, "An item without an id has words as well. Indeed it has."), (6, "short one"),
    (1, "What is the name of the river that runs through the old town of Esk? It is the river Ewe."),
]


def share(a, b):
    return len(a & b) / len(a) if a else 1.0


def leaks_by_hand(docs, items):
    out = set()
    for doc_id, text in docs:
        found = decontaminate.terms((text or "").encode())
        for item_id, item in items:
            if not decontaminate.terms((item or "").encode()):
                continue
            question, answer = (decontaminate.terms(x.encode()) for x in decontaminate.question_answer(item))
            n = min(5, len(question))
            q = decontaminate.shingles(question, 5)
            if share(q, {b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)}) >= 0.8 and share(set(answer), set(found)) >= 0.8:
                out.add((doc_id, item_id))
    return out


@pytest.fixture(scope="module")
def passages():
    draw = random.Random(9)
    filler = lambda n: " ".join(draw.choice(["the", "river", "sum", "of", "town", "name", "old", "zzz", "qqq"]) for _ in range(n))
    rows = [(100 + i, f"{filler(i * 7 % 150)} {(ITEMS[i % 8][1] or '').upper()} {filler(i * 13 % 90)}") for i in range(16)]
    edited = ITEMS[0][1].replace("old", "ancient", 1)
    return [*rows, (200, filler(4000)), (201, f"{filler(30)} {edited} {filler(5)}"), (202, ITEMS[1][1].split("\n")[0]), *[r[:2] for r in ODD]]


@pytest.mark.parametrize("rule", [decontaminate.RULE, decontaminate.Rule(shard_chars=90, block=1)])
def test_leaks_equal_brute_force(spark, passages, rule):
    docs = frame(spark, passages)
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, score string")
    got = decontaminate.leaks(docs, items, rule).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaks_by_hand(passages, ITEMS)
    left = decontaminate.clean(docs, items, rule)
    bad = {r["doc_id"] for r in got}
    assert left.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(repr(i) for i, _ in passages if i not in bad)


def test_no_items_and_no_documents(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert decontaminate.leaks(odd, items).count() == 0 and decontaminate.clean(odd, items).count() == odd.count()
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.leaks(none, some).count() == 0


def test_retrieval_equals_plain_bm25():
    draw = random.Random(2)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, weights=range(1, 61), k=draw.randint(3, 25)))) for i in range(80)]
    split = [t.split() for _, t in items]
    df = {w.encode(): sum(w in s for s in split) for w in vocabulary}
    mean = sum(map(len, split)) / len(split)
    rule = decontaminate.Rule(block=4, threshold=0.4)
    index = decontaminate.Index(items, {w: c for w, c in df.items() if c}, len(items), mean, rule)

    def plain(item, passage):
        return sum(math.log1p((80 - df[w.encode()] + 0.5) / (df[w.encode()] + 0.5)) * (c := item.count(w)) * 2.2
                   / (c + 1.2 * (0.25 + 0.75 * len(item) / mean)) for w in sorted(set(item) & set(passage)))

    for _ in range(200):
        passage = draw.choices(vocabulary, k=30) + draw.choice(split)[: draw.randint(0, 25)]
        numbers = np.unique([index.vocabulary[w.encode()] for w in passage if w.encode() in index.vocabulary])
        want = {i: plain(s, passage) / (0.4 * plain(s, s)) for i, s in enumerate(split)}
        want = {i: x for i, x in want.items() if x >= 1}
        got = dict(index.retrieve(numbers))
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)
        hopeful = index.hopeful(numbers, np.zeros(len(numbers), dtype=int))
        assert len(hopeful) == 1 if want else True  # the bound never loses an item


#: The patterns the base must equal.
PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            span = m.group()
            number = re.sub(r"\D", "", span)
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in span.split(".")),
                    "card": 14 <= len(number) <= 19 and luhn(number), "phone": 10 <= len(number) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def odd_texts():
    draw = random.Random(8)
    alphabet = ["a", "b@", "@", ".", "..", "-", "_", "+", "+1", " ", "  ", "(", ")", "é", "日", "😀", "1", "22", "333", "4111 1111 1111 1111", "4111111111111111",
                "a@b.cd", "1.2.3.4", "256.1.1.1", "001.002.003.004", "+1 (771) 555-1655", "+49 30 1234567", "\n", "x@y.z@w.v", "9" * 25, "0-0 0", "call 988-555-2485 "]
    return ["".join(draw.choices(alphabet, k=draw.randint(1, 25))) for _ in range(400)]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [*odd_texts(), "a" * 30_000, "1" * 30_000, "a." * 10_000 + "@b" + ".c" * 10_000, "1." * 9_999 + "1", "+" + "1" * 20_000, "1 " * 10_000, LONG]
    rows = [(i, t) for i, t in enumerate(texts)] + [r[:2] for r in ODD]
    got = personal.summarised(frame(spark, rows)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((repr(i), sha(b := base(t or "")), *(b.count(f"{k}:") for k, _ in PLAIN)) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    texts = {}
    for i, t in rows:
        texts.setdefault(repr(i), []).append(t or "")
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert any(set(x for x in base(t).split(",") if x) <= set(spans) for t in texts[repr(r["doc_id"])])
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_spans_beyond_the_base(spark, none):
    rows = [(i, f"write to bob{i}@mail.org or call +1 (771) 555-{1000 + i} now, card 4111111111111111, page 12, 2024-01-0{i % 9 + 1}, version 1.2.{i}") for i in range(60)]
    rows += [(100, "login password=b7db7aa4a5 or ann (at) mail (dot) org, tel 988-555-2485; see page 12 and 2024-01-02, 1234567812345678")]
    got = {r["doc_id"]: r for r in personal.summarised(frame(spark, rows)).collect()}
    text, spans = rows[-1][1], got[100]["spans"].split(",")
    found = {s.split(":")[0]: text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans}
    assert found == {"secret": "password=b7db7aa4a5", "email": "ann (at) mail (dot) org", "phone": "988-555-2485"}
    assert got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["spans"] == base(rows[3][1])
    assert personal.summarised(none).count() == 0


@pytest.mark.parametrize("form", ['token = "{}"', "password: '{}'", "api_key=[{}]", '{{"secret": "{}"}}', "pwd={}", "TOKEN:= {}"])
def test_secrets_in_quotes_and_brackets(spark, form):
    draw = random.Random(form)
    value = lambda: "".join(draw.choices("0123456789abcdef", k=40))
    rows = [(i, f"words before {form.format(value())} and after, page {i}" if i % 4 == 0 else f"nothing to hide on page {i}, see version 1.{i}") for i in range(40)]
    for r in personal.summarised(frame(spark, rows)).collect():
        text = rows[r["doc_id"]][1]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        found = [text[int(a) : int(b)] for k, a, b in spans if k == "secret"]
        assert len(found) == (r["doc_id"] % 4 == 0) and all(len(f) >= 40 and text[text.index(f) + len(f)] in "\"'])} " for f in found)
        assert all(k == "secret" for k, _, _ in spans)


def test_many_matches_take_linear_time(spark):
    def seconds(n):
        docs = frame(spark, [(1, "a@b.cd " * n)])
        began = time.time()
        assert personal.summarised(docs).collect()[0]["n_email"] == n
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.5)


def test_expectation_maximisation_finds_the_useless_labeler():
    draw = random.Random(3)
    counts = {}
    for _ in range(4000):
        real = draw.random() < 0.4
        vote = lambda p: (1 if draw.random() < p else -1) if draw.random() < 0.8 else 0  # noqa: B023, E731
        row = (vote(0.9 if real else 0.1), vote(0.8 if real else 0.2), vote(0.5))
        counts[row] = counts.get(row, 0) + 1
    learned = personal.maximise(counts)
    ratio = [c[1][0] / c[1][1] for c in learned.chances]
    assert ratio[0] > ratio[1] > ratio[2]
    assert personal.posterior(learned, (1, 1, 0)) > 0.8 and personal.posterior(learned, (-1, -1, 0)) < 0.2
    assert personal.maximise({}).chances == []


def test_items_without_an_answer_mark_are_found_by_their_whole_text(spark):
    item = "A farmer has twelve cows and buys seven more of them at the market in spring before the long dry summer begins again. How many now?"
    docs = frame(spark, [(1, f"before {item} after"), (2, f"before {item.replace('many', 'few')} after"), (3, item.split("How")[0][:60])])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs, items).collect()} == {1, 2}
    marked = spark.createDataFrame([(1, item.replace("How", "\nAnswer: How"))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs, marked).collect()} == {1}


def test_long_secrets_are_whole_candidates():
    value = "aB3" * 50
    pattern = personal.CANDIDATE.split("|(?<![A-Za-z0-9.(+-])")[0]
    assert max(m.end() for m in re.finditer(pattern, f"token={value} and more")) == len(f"token={value}")
