"""Built-in row scorers: verdicts from the record itself, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.values import clip, let

# How long values may be in a verdict's evidence.
LONGEST_EVIDENCE = 300
LONGEST_SOURCE = 100
LONGEST_SNIPPET = 200

WORD = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
NEGATED = r"\b(?:non-|not |no )([a-z]+)"

# Entity kinds a text is searched for, by the name a suite file uses for them.
ENTITY_PATTERNS = {
    "product codes": r"\b[A-Z]{2,}-[0-9]+\b",
    "brand names": r"\b[A-Z][a-z]+#[0-9]+",
    "model numbers": r"\b[A-Za-z]+-[0-9][A-Za-z0-9-]*\b",
    "dates": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "prices": r"[$€£][0-9]+(?:[.][0-9]{2})?",
}


def verdict(passed: Column, confidence: Column, reason: Column, evidence: Mapping[str, Column]) -> Column:
    pairs = [part for k, v in evidence.items() for part in (F.lit(k), v.cast("string"))]
    return F.struct(
        passed.alias("passed"),
        confidence.cast("double").alias("confidence"),
        reason.alias("reason"),
        F.create_map(*pairs).alias("evidence"),
    )


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def contradictions(claim: Column, reference: Column) -> Column:
    """What the claim says against the reference: unknown figures, and words under the other sign."""
    said, known = F.lower(claim), F.lower(reference)
    said_words, known_words = _matches(said, WORD), _matches(known, WORD)
    figures = F.filter(said_words, lambda w: w.rlike("[0-9]"))
    unknown = F.array_except(figures, known_words)
    said_not, known_not = _matches(said, NEGATED, 1), _matches(known, NEGATED, 1)
    denied = F.array_except(F.array_intersect(said_not, known_words), known_not)
    asserted = F.array_except(F.array_intersect(known_not, said_words), said_not)
    return F.array_union(unknown, F.array_union(denied, asserted))


def score_consistency(claim: Column, reference: Column) -> Column:
    claim = F.coalesce(claim.cast("string"), F.lit(""))
    reference = F.coalesce(reference.cast("string"), F.lit(""))

    def judge(listed: Column) -> Column:
        passed = listed == ""
        return verdict(
            passed,
            F.lit(1.0),
            F.when(passed, F.lit("no contradiction found")).otherwise(
                F.concat(F.lit("not supported by the reference: "), listed)
            ),
            {
                "ai_value": clip(claim, LONGEST_EVIDENCE),
                "reference_value": clip(reference, LONGEST_EVIDENCE),
                "contradictions": listed,
            },
        )

    return let(F.array_join(F.array_sort(contradictions(claim, reference)), ", "), judge)


def entities(text: Column, kinds: Sequence[str]) -> Column:
    """Distinct entities of the given kinds, lower-cased."""
    found = F.array().cast("array<string>")
    for kind in kinds:
        if kind not in ENTITY_PATTERNS:
            raise ValueError(f"unknown entity type {kind!r}, known: {', '.join(ENTITY_PATTERNS)}")
        found = F.array_union(found, F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[kind]), F.lit(0)))
    return F.transform(found, lambda e: F.lower(F.trim(e)))


def unsupported_entities(text: Column, sources: Sequence[Column], kinds: Sequence[str]) -> Column:
    """Entities in the text that no source column holds, whole or within its text."""
    texts = [F.coalesce(s.cast("string"), F.lit("")) for s in sources]
    # One text to search for entities; the separator keeps sources apart.
    together = F.concat_ws("\u001f", *texts)
    known = F.array_union(F.array(*[F.lower(F.trim(t)) for t in texts]), entities(together, kinds))
    return F.array_sort(F.array_distinct(F.array_except(entities(text, kinds), known)))


def score_entities(text: Column, sources: Mapping[str, Column], kinds: Sequence[str]) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    shown = {
        f"source {name}": clip(F.coalesce(v.cast("string"), F.lit("")), LONGEST_SOURCE)
        for name, v in sources.items()
    }

    def judge(listed: Column) -> Column:
        passed = listed == ""
        return verdict(
            passed,
            F.lit(1.0),
            F.when(passed, F.lit("every entity is in the sources")).otherwise(
                F.concat(F.lit("not in the sources: "), listed)
            ),
            {"ai_value": clip(text, LONGEST_EVIDENCE), **shown, "unmatched": listed},
        )

    return let(F.array_join(unsupported_entities(text, list(sources.values()), kinds), ", "), judge)


def votes(content: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Array of (hits, label): words of the content found in each label's lexicon."""

    def count(words: Column) -> Column:
        def hits(known: Sequence[str]) -> Column:
            return F.size(F.filter(words, lambda word: word.isin(list(known)))) if known else F.lit(0)

        return F.array(*[
            F.struct(hits(known).alias("hits"), F.lit(label).alias("label"))
            for label, known in sorted(lexicon.items(), reverse=True)
        ])

    return let(F.split(F.lower(content), r"[^\p{L}\p{N}]+"), count)


def score_label_by_words(label: Column, content: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """The label with most lexicon hits must be the given one; no hits at all pass unsure."""
    label = F.coalesce(label.cast("string"), F.lit(""))
    content = F.coalesce(content.cast("string"), F.lit(""))

    def judge(counted: Column) -> Column:
        best = F.array_max(F.transform(counted, lambda v: v["hits"]))
        total = F.aggregate(counted, F.lit(0), lambda t, v: t + v["hits"])
        own = F.aggregate(
            F.filter(counted, lambda v: v["label"] == label), F.lit(0), lambda t, v: t + v["hits"]
        )
        winner = F.array_max(
            F.transform(F.filter(counted, lambda v: v["hits"] == best), lambda v: v["label"])
        )
        passed = (best == 0) | (own == best)
        return verdict(
            passed,
            F.when(total == 0, F.lit(0.0)).otherwise(best / total),
            F.when(best == 0, F.lit("no evidence in the content"))
            .when(passed, F.lit("label matches the content"))
            .otherwise(F.concat(F.lit("content reads as "), winner)),
            {"label": label, "content_snippet": clip(content, LONGEST_SNIPPET), "predicted": winner},
        )

    return let(votes(content, lexicon), judge)


def score_label_by_prediction(label: Column, content: Column, predicted: Column, confidence: Column) -> Column:
    """The given label must be the one a classifier put into `predicted`."""
    label = F.coalesce(label.cast("string"), F.lit(""))
    predicted = predicted.cast("string")
    passed = F.coalesce(label == predicted, F.lit(True))
    return verdict(
        passed,
        F.coalesce(confidence, F.lit(0.0)),
        F.when(passed, F.lit("label matches the content")).otherwise(
            F.concat(F.lit("content reads as "), predicted)
        ),
        {"label": label, "content_snippet": clip(content.cast("string"), LONGEST_SNIPPET),
         "predicted": F.coalesce(predicted, F.lit(""))},
    )
