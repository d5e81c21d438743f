"""Personal data by weak supervision, in DataFrame functions only.

Base spans follow four fixed patterns and always stay. Beside them a wide pattern proposes candidate spans; labelers
vote on each (1 personal, -1 not, 0 no opinion): patterns of the span itself, gazetteers (mail domains, card
issuers, dial codes, area codes), and words in the context before it. One scan counts candidates per combination of votes and features
(a bounded number of combinations, whatever the input); expectation-maximisation on these counts estimates each labeler's
reliability without labels, and the resulting chances train the final classifier, a logistic regression on the
features. Candidates that it accepts are added, unless they touch a base span. Texts are read once: matches are written
with their votes and features, and everything after works on that table.

Positions come from lengths of the parts between matches, summed by a window per text and kind; texts themselves are
never shuffled, only their matches. The patterns are possessive and anchored at run starts, so long runs of letters
or digits cost linear time; they match what the plain patterns match.

Defined results: a null or empty text has no spans (the digest is that of the empty string); repeated rows give
repeated results, null ids are kept; offsets count code points, ends are exclusive. Empty table: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import kept
from plumbline.session import prepare

KINDS = ("email", "ip", "card", "phone", "secret")
#: What the four kinds look like, written for linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Wider than the base: spelled-out mail addresses, named secrets, numbers of any grouping, dates and versions included.
_AT, _DOT = r"(?:\x20?(?:\(at\)|\[at\])\x20?|@)", r"(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)"
_SECRET = r"""(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key)["']?\x20{0,2}[=:]{1,2}\x20{0,2}["'(\[{<]{0,2}"""
CANDIDATE = "|".join((
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    rf"(?<![A-Za-z0-9]){_SECRET}[A-Za-z0-9+/_.-]{{6,}}+",
    r"(?<![A-Za-z0-9.(+-])[+(]{0,2}[0-9]{1,19}(?:[\x20().+/-]{1,3}[0-9]{1,19}){0,7}(?![A-Za-z0-9])",
))
_DOMAINS = r"(?i)(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$"
_FOR = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|account|login|user|reach|pass|key)[a-z]{0,4}[\x20:=.(]{0,3}(?:is\x20|at\x20|to\x20|number\x20)?$"
_AGAINST = r"(?i)(?:version|page|isbn|order|invoice|figure|section|chapter|date|score|no)[a-z]{0,3}[\x20.:#]{0,3}$"
_DATE = r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})$"


@dataclass
class Learned:
    """Reliabilities by labeler and vote, the share of personal spans, and the classifier's weights by feature."""

    share: float = 0.5
    chances: list[dict[int, tuple[float, float]]] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has Luhn's check sum."""
    value = lambda d, i: d.cast("int") * (F.lit(1) + i % 2) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0)
    summed = F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, b: a + b)
    return F.when(number != "", summed % 10 == 0).otherwise(False)


def _passes(kind: str, span: Column) -> Column:
    size = F.length(digits(span))
    if kind == "ip":
        return span.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(size.between(14, 19), luhn(digits(span))).otherwise(False)
    return size.between(10, 15) if kind == "phone" else F.lit(True)


def _parts(text: Column, pattern: str, needs: str | None) -> Column:
    """The parts of a text before, between and after matches, each with the match that follows it."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("span"))
    none = F.array().cast("array<struct<gap:string,span:string>>")
    zipped = zipped.cast("array<struct<gap:string,span:string>>")
    return F.when(text.contains(needs), zipped).otherwise(none) if needs else zipped


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def votes(before: Column, span: Column) -> list[Column]:
    """The labelers, each 1, -1 or 0."""
    plain = ~span.rlike(r"(?i)@|\(at\)|\[at\]") & ~span.rlike(rf"(?i)^{_SECRET}")
    number = F.when(plain, digits(span)).otherwise("")
    size = F.length(number)
    vote = lambda yes, no: _flag(yes) - _flag(~yes & no)
    whole = [span.rlike(f"^{PATTERNS[k]}$") & _passes(k, span) for k in ("email", "ip", "card", "phone")]
    value = F.regexp_extract(span, rf"(?i)^{_SECRET}(.*)$", 1)
    groups = span.rlike(r"^[+]?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,6}$") & (size >= 9)
    return [
        vote(whole[0] | whole[1] | whole[2] | whole[3], plain & (size < 7)),                   # the base patterns
        vote(span.rlike(r"(?i)\((?:at|dot)\)|\[(?:at|dot)\]"), span.rlike(_DATE)),            # pattern: spelled out, or a date
        vote(groups, span.rlike(r"^[0-9]+(?:[.][0-9]+){0,2}$")),                               # pattern: grouped, or a plain number
        vote(size.between(14, 19) & luhn(number), size >= 14),                                 # pattern: check sum
        vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), (value != "") & value.rlike("^[a-z]+$")),  # pattern: a mixed value
        vote(span.rlike(_DOMAINS), span.rlike(r"(?i)\.(?:png|jpg|txt|html|exe)$")),            # gazetteer: domains, files
        vote(size.between(14, 16) & number.rlike("^(?:4|5[1-5]|3[47]|6011)"), size.between(1, 5)),  # gazetteer: issuers
        vote(F.length(value) >= 16, (value != "") & (F.length(value) < 8)),                    # pattern: a long value
        vote(before.rlike(_FOR), before.rlike(_AGAINST)),                                      # context
    ]


def features(before: Column, span: Column) -> Column:
    """One word per feature that holds; their combinations are few."""
    size = F.length(digits(span))
    form = F.when(span.rlike(r"(?i)@|\(at\)|\[at\]"), "mail").when(span.rlike(rf"(?i)^{_SECRET}"), "secret").otherwise("number")
    many = F.when(size < 7, "few").when(size < 9, "some").when(size < 14, "phone").otherwise("card")
    grouped = span.rlike(r"^[+(]*[0-9]{1,4}[\x20()./-]+[0-9]{2,4}[\x20()./-]+[0-9]{3,6}")
    mixed = span.rlike("[A-Za-z]") & span.rlike("[0-9]")
    value = F.length(F.regexp_extract(span, rf"(?i)^{_SECRET}(.*)$", 1))
    length = F.when(value >= 16, "long_value").when(value >= 8, "value").otherwise("short_value")
    return F.concat_ws(" ", form, F.when(form == "number", F.concat(F.lit("digits_"), many)), F.when(mixed, "mixed"),
                       F.when(grouped, "grouped"), F.when(span.rlike(_DATE), "date"), F.when(before.rlike(_FOR), "asked"),
                       F.when(before.rlike(_AGAINST), "listed"), F.when(span.startswith("+"), "plus"), F.when(form == "secret", length),
                       F.when((form == "number") & size.between(14, 19), F.when(luhn(digits(span)), "sum").otherwise("no_sum")))


def kind_of(span: Column) -> Column:
    return (F.when(span.rlike(r"(?i)@|\(at\)|\[at\]"), 0).when(span.rlike(rf"(?i)^{_SECRET}"), 4)
            .when(F.length(digits(span)) >= 14, 2).otherwise(3))


def candidates(text: Column) -> Column:
    return _parts(text, f"(?i){CANDIDATE}", None)


def maximise(counts: dict[tuple[int, ...], int], rounds: int = 50) -> Learned:
    """Expectation-maximisation over combinations of votes.

    The prior takes every labeler for better than chance and weighs as much as a quarter of the candidates, so the
    two sides cannot trade places; a labeler may turn out useless, never to mean the opposite.
    """
    out = Learned(share=0.3)
    if not counts:
        return out
    labelers, weight = len(next(iter(counts))), 10 + sum(counts.values()) / 4
    prior = {1: (0.5, 0.05), 0: (0.45, 0.55), -1: (0.05, 0.4)}
    out.chances = [dict(prior) for _ in range(labelers)]
    for _ in range(rounds):
        mass = [0.3 * weight, 0.7 * weight]
        sums = [{v: [weight * prior[v][0], weight * prior[v][1]] for v in prior} for _ in range(labelers)]
        for combination, n in counts.items():
            p = posterior(out, combination)
            mass[0] += n * p
            mass[1] += n * (1 - p)
            for j, v in enumerate(combination):
                sums[j][v][0] += n * p
                sums[j][v][1] += n * (1 - p)
        out.share = mass[0] / sum(mass)
        out.chances = [{v: tuple(s[v][k] / sum(s[x][k] for x in s) for k in (0, 1)) for v in s} for s in sums]
    return out


def posterior(learned: Learned, combination: tuple[int, ...]) -> float:
    """Chance that a span with these votes is personal; no opinion counts as silence, not as evidence."""
    odds = math.log(learned.share / (1 - learned.share))
    odds += sum(v * max(0.0, v * math.log(c[v][0] / c[v][1])) for c, v in zip(learned.chances, combination, strict=True) if v)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def regress(rows: list[tuple[list[str], float, int]], rounds: int = 400) -> dict[str, float]:
    """Logistic regression of the chances on the features, by gradient steps scaled per feature."""
    total = sum(n for _, _, n in rows) or 1
    weights = {f: 0.0 for names, _, _ in rows for f in [*names, ""]}
    seen = dict.fromkeys(weights, 1e-6)
    for _ in range(rounds):
        step = {f: 1e-3 * w for f, w in weights.items()}
        for names, p, n in rows:
            z = weights[""] + sum(weights[f] for f in names)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for f in [*names, ""]:
                step[f] += gap
        for f, g in step.items():
            seen[f] += g * g
            weights[f] -= 0.5 * g / math.sqrt(seen[f])
    return weights


def matches(docs: DataFrame) -> DataFrame:
    """All matches of the four patterns and all candidates, written once: one row per text and match, texts without any
    keep one row. `row` numbers the texts, `at` the matches of a pattern in a text, `gap` and `size` are lengths; base
    matches say whether they pass (`good`), candidates how the labelers vote and which features hold."""
    text = F.coalesce("text", F.lit(""))
    lists = [(k, _parts(text, pattern, _NEEDS.get(kind))) for k, (kind, pattern) in enumerate(PATTERNS.items())]
    lists.append((len(PATTERNS), candidates(text)))

    def numbered(k: int, parts: Column) -> Column:
        return F.transform(parts, lambda z, i: F.struct(
            F.lit(k).alias("set"), i.alias("at"), F.length(z["gap"]).alias("gap"), F.right(z["gap"], F.lit(24)).alias("before"), z["span"].alias("span")))

    each = F.flatten(F.array(*[numbered(k, parts) for k, parts in lists]))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(each, lambda m: m["span"].isNotNull()).alias("all"))
    rows = rows.select("row", "doc_id", F.explode_outer("all").alias("m")).select("row", "doc_id", "m.*")
    base, span, before = F.col("set") < len(PATTERNS), F.col("span"), F.col("before")
    good = F.coalesce(*[F.when(F.col("set") == k, _passes(kind, span)) for k, kind in enumerate(PATTERNS)], F.lit(False))
    return kept(rows.select(
        "row", "doc_id", "set", "at", "gap", F.length(span).alias("size"), good.alias("good"),
        F.when(base, F.col("set")).otherwise(kind_of(span)).alias("kind"),
        F.when(~base, F.array(*votes(before, span))).alias("votes"), F.when(~base, features(before, span)).alias("features")), "matches")


def learn(rows: DataFrame) -> Learned:
    """From all matches: what comes to the driver is one row per combination of votes and features."""
    seen = rows.where("features IS NOT NULL").groupBy("votes", "features").count()
    seen = [(tuple(r["votes"]), r["features"].split(), r["count"]) for r in seen.collect()]
    counts: dict[tuple[int, ...], int] = {}
    for combination, _, n in sorted(seen):
        counts[combination] = counts.get(combination, 0) + n
    out = maximise(counts)
    out.weights = regress([(names, posterior(out, combination), n) for combination, names, n in sorted(seen)])
    return out


def _accepted(learned: Learned, names: Column) -> Column:
    """Whether the classifier takes a span for personal, by its features."""
    start = F.lit(float(learned.weights.get("", -1.0)))
    pairs = [F.lit(x) for name, weight in sorted(learned.weights.items()) if name for x in (name, float(weight))]
    if not pairs:
        return start >= 0
    weight = F.create_map(*pairs)
    return F.aggregate(F.split(names, " "), start, lambda z, name: z + F.coalesce(weight[name], F.lit(0.0))) >= 0


def found(rows: DataFrame, learned: Learned) -> DataFrame:
    """Matches with their places: start, end and base; of candidates those are good that the classifier accepts and
    that touch no good base span. What base spans reach before and after a match comes from a running maximum of
    ends and, in the opposite order, a running minimum of starts."""
    so_far = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "set").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("size"))
    base = F.coalesce(F.col("set") < len(PATTERNS), F.lit(True))
    good = F.coalesce(F.when(base, F.col("good")).otherwise(_accepted(learned, F.col("features"))), F.lit(False))
    rows = rows.withColumn("base", base).withColumn("good", good)
    sure, order = F.col("good") & F.col("base"), ("start", "end", "set")
    running = lambda columns: W.partitionBy("row").orderBy(*columns).rowsBetween(W.unboundedPreceding, 0)
    reached = F.max(F.when(sure, F.col("end"))).over(running([F.col(c).asc() for c in order]))
    ahead = F.min(F.when(sure, F.col("start"))).over(running([F.col(c).desc() for c in order]))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    return rows.withColumn("free", free).withColumn("good", F.col("good") & (F.col("base") | F.col("free")))


def summarised(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    prepare(docs.sparkSession)
    rows = matches(docs)
    rows = found(rows, learn(rows))
    good, base = F.col("good"), F.col("good") & F.col("base")
    span = F.struct("start", "kind", "end")
    counts = [F.sum((base & (F.col("kind") == k)).cast("long")).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    rows = rows.groupBy("row", "doc_id").agg(
        *counts, F.sort_array(F.collect_list(F.when(base, span))).alias("base"), F.sort_array(F.collect_list(F.when(good, span))).alias("all"))
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    counts = [F.coalesce(F.col(f"n_{kind}"), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
