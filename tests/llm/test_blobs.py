"""The blob ledger against plain scans of every version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import blobs
from plumbline.session import scratch_path
from tests.llm.conftest import LONG

KEY = "AKIA" + "Q7" * 8
TEXTS = [
    None, "", "no secret here, token: short", f'password = "{"aB3/" * 4}" and {KEY}', "é😀 TOKEN=abcdefghijkl; pſecret=abcdefghijklmn toKen=token:abcdefghijkl",
    "deadbeefdeadbeef deadbeefdeadbee 0123456789abcdef0", "AKIA AKIAAKIAAKIAAKIAAK AKIA" + "Z" * 13, LONG + " api_key: " + "0f" * 20,
    "a" * 200_000 + "g" + "token" * 20_000 + "=" + "x" * 100_000, "-----BEGIN RSA PRIVATE KEY-----\nabc=\ndef\n-----END RSA PRIVATE KEY----- tail",
    "see https://user:pa55@host/x and ghp_" + "a1B2" * 6, "secret\x20\x20=\x20\x20'...----====____'", "apikey=api-key=api_key=123456789012345678",
]
PLAIN = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
                          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def plain(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, good) in enumerate(PLAIN) for m in p.finditer(text or "") if good(m)]
    return [f"{name}:{start}:{end}" for start, _, name, end in sorted(found)]


def versions(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "path string, version int, text string, blob string, spans int")


def listed(df):
    return sorted(((r["path"], r["version"], [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]]) for r in df.collect()), key=repr)


def base_only(rows):
    names = {name for name, _, _ in PLAIN}
    return [(p, v, [s for s in found if s.split(":")[0] in names]) for p, v, found in rows]


@pytest.mark.parametrize("hot", [1, 1 << 12])
def test_findings_equal_plain_scans(spark, hot):
    rows = [(f"p{i % 5}", i, t) for i, t in enumerate(TEXTS)] + [(None, None, TEXTS[3]), ("p3", 3, TEXTS[3]), ("p3", 3, TEXTS[3])]
    rows += [(f"copy{i}", 0, TEXTS[5]) for i in range(40)]
    data, ledger = versions(spark, rows).repartition(5), scratch_path(spark, "ledger")
    index = blobs.addressed(data)
    blobs.scan(data, index, ledger, hot=hot)
    got = listed(blobs.findings(index, blobs.read_ledger(spark, ledger), hot=hot))
    assert base_only(got) == sorted(((p, v, plain(t)) for p, v, t in rows), key=repr)
    kinds = {s.split(":")[0] for _, _, found in got for s in found}
    assert kinds == {r.name for r in blobs.RULES}


def test_only_unseen_pairs_are_scanned(spark):
    first = [("a", 1, TEXTS[3]), ("b", 1, TEXTS[5]), ("c", 1, TEXTS[3])]
    ledger = scratch_path(spark, "ledger")

    def run(rows, rules):
        data = versions(spark, rows)
        index = blobs.addressed(data)
        todo = sorted((r["blob"], sorted(r["missing"])) for r in blobs.unseen(index, blobs.read_ledger(spark, ledger), rules).collect())
        before = blobs.read_ledger(spark, ledger).count()
        blobs.scan(data, index, ledger, rules)
        assert blobs.read_ledger(spark, ledger).count() == before + len(todo)
        return todo, listed(blobs.findings(index, blobs.read_ledger(spark, ledger), rules))

    name = lambda i: hashlib.sha256(TEXTS[i].encode()).hexdigest()
    keys = ["access@1", "assign@1", "hex@1"]
    assert run(first, blobs.BASE)[0] == sorted([(name(3), keys), (name(5), keys)])
    assert run(first, blobs.BASE)[0] == []
    more = [*first, ("a", 2, TEXTS[5]), ("d", 1, TEXTS[6]), ("c", 2, TEXTS[3])]
    todo, found = run(more, blobs.BASE)
    assert todo == [(name(6), keys)]
    assert found == sorted(((p, v, plain(t)) for p, v, t in more), key=repr)
    newer = (*blobs.BASE[:2], blobs.Rule("hex", 2, r"(?<![0-9a-f])[0-9a-f]{4,16}(?![0-9a-f])"))
    todo, found = run(more, newer)
    assert {m for _, missing in todo for m in missing} == {"hex@2"} and len(todo) == 3
    assert ("b", 1, ["hex:0:16", "hex:17:32"]) in found
    assert run(more, blobs.BASE)[0] == [] and run(more, newer)[0] == []
    # A ledger row that was appended twice changes nothing.
    blobs.read_ledger(spark, ledger).limit(2).write.mode("append").parquet(ledger + "-twice")
    twice = blobs.read_ledger(spark, ledger).unionAll(blobs.read_ledger(spark, ledger + "-twice"))
    assert listed(blobs.findings(blobs.addressed(versions(spark, more)), twice, newer)) == found


def test_nothing_to_scan(spark):
    data, ledger = versions(spark, []), scratch_path(spark, "ledger")
    index = blobs.addressed(data)
    blobs.scan(data, index, ledger)
    assert blobs.findings(index, blobs.read_ledger(spark, ledger)).count() == 0


def test_text_is_taken_once_a_blob(spark):
    data = versions(spark, [(f"p{i}", 1, TEXTS[3 + i % 2]) for i in range(30)]).repartition(1)
    texts = data.select(blobs.blob(F.col("text")).alias("blob"), F.col("text").cast("binary").alias("text"))
    assert blobs._packed(texts).count() == 2
