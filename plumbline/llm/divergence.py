"""How the sources of a language differ in their words, by length-bucketed packing.

Counting goes on in tasks, on whole Arrow batches of texts as one run of bytes. Terms are cut with numpy and dealt over
buckets by length: up to 8 bytes a term is one uint64 word, up to 16 it is two, first byte highest and zeros behind,
so that equal words are equal terms and order of words is order of bytes. Words are sorted by radix, 16 bits at a
time, which is stable: documents stay in order inside a term, and counts and document counts of each source are
lengths of runs. Longer terms go to byte-string buckets of doubling width, sorted as bytes and counted alike. A task
merges what its batches gave by the same sort and sends one row per source and term; nothing grows with repeats.

Rows then meet by (language, term), which no single term can crowd: there is at most one row for each task and source.
Terms in at least `MIN_DOCS` documents of the language are written once, with their counts by source; from them come
the totals, the terms that mark a source, and the sums over all terms for each pair of sources. Those sums are built in
numpy in blocks of `_CHUNK` sources times `_CHUNK` sources, and only for terms that occur in a block; all other terms of
the language have one and the same share there, which is counted in at the end. Pairs of sources are the answer, one
row each way; no pairs of rows are ever made.

The list of sources with their totals goes to every task; it is the square root of what is asked for. It may have up
to `GROUPS` entries; beyond that the job refuses.

Defined results: null text, lang and source are empty texts, and the empty source is a source. Repeated rows are
documents of their own. A source without kept terms has p = 1 + 1000000000 / V for all of them; a language without
kept terms has value 0 for every pair and no terms. A very long text is cut between terms into pieces that are counted
one by one and still are one document; a term may have any length. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import kept, utf8
from plumbline.operators.firsts import first_rows
from plumbline.session import prepare

SCALE, MIN_DOCS, RANKS, GROUPS = 1_000_000_000, 3, 200, 1 << 20
#: Every byte of a term as itself, A-Z in lower case; every other byte as zero.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256))
_PIECE, _HELD, _CHUNK, _CELLS, _EMIT = 1 << 23, 1 << 21, 64, 1 << 20, 1 << 16


@dataclass
class Counts:
    """Sorted runs: terms (one or two words, or byte strings), their group, occurrences and documents."""

    words: list[np.ndarray]
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray

    def __len__(self) -> int:
        return len(self.group)


def _by_radix(order: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """An order refined by unsigned values, lowest 16 bits first; numpy sorts 16-bit integers by radix."""
    for shift in range(0, bits, 16):
        digit = (values >> np.asarray(shift, values.dtype)).astype(np.uint16)[order]
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def _sorted(words: list[np.ndarray]) -> np.ndarray:
    """A stable order by term."""
    if words[0].dtype.kind == "S":
        return np.argsort(words[0], kind="stable")
    order = np.arange(len(words[0]))
    for word in reversed(words):
        order = _by_radix(order, word, 64)
    return order


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _run_counted(words: list[np.ndarray], doc: np.ndarray, group_of: np.ndarray) -> Counts:
    """Occurrences in document order -> runs by term and group; groups must not fall from document to document."""
    order = _sorted(words)
    words, doc = [w[order] for w in words], doc[order]
    group = group_of[doc]
    at, firsts = _starts(*words, group), _starts(*words, doc)
    docs = np.diff(np.searchsorted(firsts, np.append(at, len(doc))))
    return Counts([w[at] for w in words], group[at], np.diff(np.append(at, len(doc))), docs)


def _merged(parts: list[Counts], one_document: bool = False) -> Counts:
    """Runs of several parts as one; pieces of one document add up to one document."""
    wide = max((p.words[0].dtype for p in parts), key=lambda t: t.itemsize)
    words = [np.concatenate([p.words[k].astype(wide) for p in parts]) for k in range(len(parts[0].words))]
    group, n, docs = (np.concatenate([getattr(p, name) for p in parts]) for name in ("group", "n", "docs"))
    order = _by_radix(np.arange(len(group)), group, 32)
    order = order[_sorted([w[order] for w in words])]
    words, group = [w[order] for w in words], group[order]
    at = _starts(*words, group)
    if not len(at):
        return Counts(words, group, n, docs)
    n, docs = np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)
    return Counts([w[at] for w in words], group[at], n, np.ones_like(docs) if one_document else docs)


def _packed(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one word, first byte highest, zeros behind."""
    word = np.zeros(len(start), dtype=np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | flat[start + k]
    spare = np.clip(8 - size, 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(spare < 64, word >> np.minimum(spare, np.uint64(63)) << np.minimum(spare, np.uint64(63)), np.uint64(0))


def _piece(texts: list[bytes], group_of: np.ndarray) -> dict[int, Counts]:
    """Runs of the terms of some texts by bucket: 8 and 16 for words, else the width of the byte strings."""
    data = b"\0".join(texts).translate(_FOLD) + bytes(16)
    flat = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff((flat != 0).view(np.int8), prepend=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    size = end - start
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(begins, start, side="right") - 1
    out = {}
    for bucket, at in ((8, np.flatnonzero(size <= 8)), (16, np.flatnonzero((size > 8) & (size <= 16)))):
        if len(at):
            words = [_packed(flat, start[at], size[at])] + ([_packed(flat, start[at] + 8, size[at] - 8)] if bucket == 16 else [])
            out[bucket] = _run_counted(words, doc[at], group_of)
    long = np.flatnonzero(size > 16)
    width = 1 << np.ceil(np.log2(size[long])).astype(np.int64)
    for bucket in np.unique(width).tolist():
        at = long[width == bucket]
        terms = np.array([data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)], dtype=f"S{bucket}")
        out[bucket] = _run_counted([terms], doc[at], group_of)
    return out


def _cut(text: bytes, size: int) -> list[bytes]:
    """A text in pieces of about `size` bytes that end between terms."""
    folded, out, low = text.translate(_FOLD), [], 0
    while len(text) - low > size:
        high = folded.rfind(b"\0", low, low + size) + 1 or (folded.find(b"\0", low + size) + 1 or len(text))
        out.append(text[low:high])
        low = high
    return [*out, text[low:]]


def counted(texts: list[bytes], groups: np.ndarray, piece: int = _PIECE) -> Iterator[dict[int, Counts]]:
    """Runs by bucket of texts and the numbers of their groups, so many bytes of text at a time."""
    order, waiting, size = np.argsort(groups, kind="stable"), [], 0
    for i in order.tolist():
        if len(texts[i]) > piece:
            parts = [_piece([p], groups[[i]]) for p in _cut(texts[i], piece)]
            yield {b: _merged([p[b] for p in parts if b in p], True) for b in {b for p in parts for b in p}}
            continue
        if waiting and size + len(texts[i]) > piece:
            yield _piece([texts[j] for j in waiting], groups[waiting])
            waiting, size = [], 0
        waiting.append(i)
        size += len(texts[i])
    if waiting:
        yield _piece([texts[j] for j in waiting], groups[waiting])


def _terms(counts: Counts) -> pa.Array:
    """The terms as strings again."""
    words = counts.words
    if words[0].dtype.kind == "S":
        return pa.array(words[0].tolist(), pa.binary()).cast(pa.string())
    cells = np.column_stack(words).astype(">u8").view(np.uint8)
    held = cells != 0
    ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(cells), [None, pa.py_buffer(ends), pa.py_buffer(cells[held].tobytes())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), a term and source seldom more than once a task."""
    numbers: dict[tuple[str, str], int] = {}
    held: dict[int, list[Counts]] = {}

    def out(counts: Counts) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[k] for g in numbers], pa.string()) for k in (0, 1))
        for low in range(0, len(counts), _EMIT):
            at = slice(low, low + _EMIT)
            part = Counts([w[at] for w in counts.words], counts.group[at], counts.n[at], counts.docs[at])
            group = pa.array(part.group)
            columns = [langs.take(group), sources.take(group), _terms(part), pa.array(part.n), pa.array(part.docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        groups = np.array([numbers.setdefault(name, len(numbers)) for name in names], dtype=np.uint32)
        for found in counted(batch.column(2).to_pylist(), groups):
            for bucket, counts in found.items():
                held.setdefault(bucket, []).append(counts)
                if sum(map(len, held[bucket])) * max(16, bucket) > _HELD * 16:
                    whole = _merged(held.pop(bucket))
                    if len(whole) * max(16, bucket) > _HELD * 8:
                        yield from out(whole)
                    else:
                        held[bucket] = [whole]
    for bucket in list(held):
        yield from out(_merged(held.pop(bucket)))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n and places (source, n) of the terms in at least `min_docs` documents of their language."""
    each = docs.select("lang", "source", utf8(F.col("text")).alias("text")).mapInArrow(
        _rows, "lang string, source string, term string, n long, docs long")
    each = each.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("places"))
    return kept(terms.where(F.col("docs") >= min_docs).drop("docs"), "terms")


@dataclass(frozen=True)
class Language:
    """The sources of a language in order, how often kept terms occur in each, and how many terms are kept."""

    sources: list[str]
    totals: np.ndarray
    terms: int


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / (total + terms)), three decimal places at a time, as products might not fit."""
    whole = total + terms
    out, rest = (count + 1) // whole, (count + 1) % whole
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The same as columns."""
    whole, div = F.greatest(total + terms, F.lit(1)), lambda a, b: F.call_function("div", a, b)
    out, rest = div(count + 1, whole), (count + 1) % whole
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, whole), rest * 1000 % whole
    return out + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(languages: dict[str, Language], chunk: int = _CHUNK):
    """Rows of kept terms -> (lang, source, item, value, seen): sums over the terms seen in either chunk of sources."""

    def flush(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), (value, seen) in sums.items():
            names = languages[lang].sources
            left, right = names[a * chunk : (a + 1) * chunk], names[b * chunk : (b + 1) * chunk]
            columns = [np.repeat(left, len(right)).tolist(), list(right) * len(left)]
            size = len(left) * len(right)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size), *[pa.array(c, pa.string()) for c in columns], pa.array(value.ravel()), pa.array(np.full(size, seen))],
                names=["lang", "source", "item", "value", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: {s: i for i, s in enumerate(known.sources)} for lang, known in languages.items()}
        sums: dict = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            places = batch.column(1)
            sizes = np.diff(places.offsets.to_numpy())
            row = np.repeat(np.arange(len(langs)), sizes)
            flat = places.flatten()
            sources, counts = flat.field("source").to_pylist(), flat.field("n").to_numpy()
            for lang in set(langs):
                known, of = languages[lang], index[lang]
                mine = np.flatnonzero((langs == lang)[row])
                _, term = np.unique(row[mine], return_inverse=True)
                where = np.array([of[sources[i]] for i in mine], dtype=np.int64)
                for a, b, part in _blocks(term, where, counts[mine], known, chunk):
                    value, seen = sums.get((lang, a, b), (0, 0))
                    sums[lang, a, b] = value + part[0], seen + part[1]
            if sum(v.size for v, _ in sums.values()) > _CELLS:
                yield from flush(sums)
                sums = {}
        yield from flush(sums)

    return add


def _blocks(term: np.ndarray, where: np.ndarray, count: np.ndarray, known: Language, chunk: int):
    """For each pair of chunks: (sums of f by source pair, how many terms occur in either)."""
    n = int(term.max(initial=-1)) + 1
    last = -(-len(known.sources) // chunk)
    zero = shares(np.zeros_like(known.totals), known.totals, known.terms)
    share = shares(count, known.totals[where], known.terms)
    held = np.zeros((last, n), dtype=bool)
    held[where // chunk, term] = True
    for a in range(last):
        for b in range(last):
            some = held[a] | held[b]
            if not some.any():
                continue
            new = np.cumsum(some) - 1

            def dense(c: int, some=some, new=new) -> np.ndarray:
                out = np.repeat(zero[None, c * chunk : (c + 1) * chunk], int(some.sum()), axis=0)
                at = where // chunk == c
                out[new[term[at]], where[at] % chunk] = share[at]
                return out

            p, q = dense(a), dense(b)
            value = np.stack([((p[:, [g]] - q) ** 2 // q).sum(axis=0) for g in range(p.shape[1])])
            yield a, b, (value, int(some.sum()))


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, chunk: int = _CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank: how far other sources are, and the terms that mark a source."""
    prepare(docs.sparkSession)
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = kept_terms(docs, min_docs)
    own = terms.select("lang", F.explode("places").alias("p")).groupBy("lang", "p.source").agg(F.sum("p.n").alias("total"))
    all_terms = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(all_terms, "lang", "left")
    groups = kept(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")
    if (size := groups.count()) > GROUPS:
        raise ValueError(f"{size} sources of languages; their pairs are asked for, {GROUPS} are the most")
    languages: dict[str, Language] = {}
    listed = sorted((r["lang"], r["source"], r["total"], r["terms"]) for r in groups.collect())
    for lang in sorted({g[0] for g in listed}):
        mine = [g for g in listed if g[0] == lang]
        languages[lang] = Language([g[1] for g in mine], np.array([g[2] for g in mine], dtype=np.int64), mine[0][3])

    sums = terms.select("lang", "places").mapInArrow(_pair_sums(languages, chunk), "lang string, source string, item string, value long, seen long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("its_total"))
    pairs = groups.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    idle = _gap(_share(F.lit(0), F.col("total"), F.col("terms")), _share(F.lit(0), F.col("its_total"), F.col("terms")))
    value = F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + (F.col("terms") - F.coalesce("seen", F.lit(0))) * idle).otherwise(0)
    best = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    each = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("all_n"), F.explode("places").alias("p"))
    each = each.select("lang", "p.source", "item", "all_n", "p.n").join(F.broadcast(groups), ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("all_n"), F.col("lang_total"), F.col("terms"))
    marks = each.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    marks = marks.select("lang", "source", F.lit("term").alias("part"), "item", _gap(F.col("p"), F.col("q")).cast("long").alias("value"))
    marks = first_rows(marks, ["lang", "source"], [F.col("value").desc(), F.col("item")], ranks, rank="rank", spread=["item"])
    return pairs.unionByName(marks)
