"""Expectations, verdicts and drift over texts and embeddings."""

from __future__ import annotations

import json
import warnings
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F

from catalog import CATALOG
from catalog.frames import settled, table
from plumbline.operators import drift, expectations, scorers, verdicts
from plumbline.plans import suite as suites

RUN = {"run_id": "run-1", "run_at": datetime(2026, 1, 1, tzinfo=timezone.utc)}


def products(spark, folder):
    """`part` with a generated description; one part in twenty each is wrong in some way."""
    p = table(spark, folder, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    told = F.when(key % 20 == 3, size + 1).otherwise(size)
    brand = F.when(key % 20 == 7, F.lit("Brand#99")).otherwise(F.col("p_brand"))
    waterproof = F.when(key % 20 == 11, F.lit("not waterproof")).otherwise(F.lit("waterproof"))
    code = F.when(key % 20 == 13, F.lit(" Batch QV-38 of 1997-05-14 for $86.20.")).otherwise(F.lit(""))
    return p.select(
        "p_partkey", "p_name", "p_brand", "p_type",
        F.concat(F.lit("A "), waterproof, F.lit(" "), F.col("p_name"), F.lit(" by "), brand, F.lit(" in size "),
                 told.cast("string"), F.lit("."), code).alias("description"),
        F.concat(F.col("p_name"), F.lit(", waterproof, size "), size.cast("string"), F.lit(", "),
                 F.col("p_brand")).alias("spec"),
        F.when(key % 20 == 17, F.lit("BIG")).otherwise(F.when(size > 25, F.lit("BIG")).otherwise(F.lit("SMALL")))
        .alias("size_label"),
        F.when(size > 25, F.lit("a large and heavy thing")).otherwise(F.lit("a small light thing")).alias("review"),
    )


PRODUCTS = """products AS (SELECT p_partkey, p_name, p_brand, p_type, p_size,
    'A ' || CASE WHEN p_partkey % 20 = 11 THEN 'not waterproof' ELSE 'waterproof' END || ' ' || p_name || ' by ' ||
    CASE WHEN p_partkey % 20 = 7 THEN 'Brand#99' ELSE p_brand END || ' in size ' ||
    CAST(CASE WHEN p_partkey % 20 = 3 THEN p_size + 1 ELSE p_size END AS VARCHAR) || '.' ||
    CASE WHEN p_partkey % 20 = 13 THEN ' Batch QV-38 of 1997-05-14 for $86.20.' ELSE '' END AS description,
    p_name || ', waterproof, size ' || CAST(p_size AS VARCHAR) || ', ' || p_brand AS spec,
    CASE WHEN p_partkey % 20 = 17 OR p_size > 25 THEN 'BIG' ELSE 'SMALL' END AS size_label FROM part)"""

WORD = scorers.WORD
NEGATED = scorers.NEGATED
# The scorer said again in SQL: figures the reference lacks, and words under the other sign.
CONSISTENT = rf"""{PRODUCTS}, words AS (SELECT *, regexp_extract_all(lower(description), '{WORD}') AS said,
    regexp_extract_all(lower(spec), '{WORD}') AS known,
    regexp_extract_all(lower(description), '{NEGATED}', 1) AS said_not,
    regexp_extract_all(lower(spec), '{NEGATED}', 1) AS known_not FROM products),
  against AS (SELECT p_partkey, list_sort(list_distinct(
    list_concat(
      list_filter(said, lambda w: regexp_matches(w, '[0-9]') AND NOT list_contains(known, w)),
      list_concat(list_filter(said_not, lambda w: list_contains(known, w) AND NOT list_contains(known_not, w)),
                  list_filter(known_not, lambda w: list_contains(said, w) AND NOT list_contains(said_not, w))))))
    AS found FROM words)"""


@CATALOG.add("v1_expect_factual_consistency", f"""WITH {CONSISTENT} SELECT p_partkey, len(found) = 0 AS passed,
  array_to_string(found, ', ') AS contradictions FROM against""")
def v1(spark, folder):
    check = expectations.FactualConsistency("description", "spec")
    rows = products(spark, folder)
    return rows.select("p_partkey", check.verdict(rows).alias("v")).select(
        "p_partkey", "v.passed", F.col("v.evidence")["contradictions"].alias("contradictions")
    )


@CATALOG.add("j3_compare_columns", f"""WITH {CONSISTENT} SELECT found[1] AS first_found, COUNT(*) AS parts
  FROM against WHERE len(found) > 0 GROUP BY 1""")
def j3(spark, folder):
    """The reference text lives in another frame: a keyed join, then the same comparison."""
    rows = products(spark, folder)
    joined = rows.select("p_partkey", "description").join(rows.select("p_partkey", "spec"), "p_partkey")
    against = F.array_sort(scorers.contradictions(F.col("description"), F.col("spec")))
    return joined.where(F.size(against) > 0).groupBy(against[0].alias("first_found")).agg(
        F.count(F.lit(1)).alias("parts")
    )


ENTITY_SQL = """list_distinct(list_transform(list_concat(list_concat(
    regexp_extract_all({t}, '\\b[A-Z]{{2,}}-[0-9]+\\b'), regexp_extract_all({t}, '\\b[A-Z][a-z]+#[0-9]+')),
    list_concat(regexp_extract_all({t}, '\\b[A-Za-z]+-[0-9][A-Za-z0-9-]*\\b'),
    list_concat(regexp_extract_all({t}, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'),
    regexp_extract_all({t}, '[$€£][0-9]+(?:[.][0-9]{{2}})?')))), lambda e: lower(e)))"""
INVENTED = f"""{PRODUCTS}, named AS (SELECT *, {ENTITY_SQL.format(t='description')} AS said FROM products),
  invented AS (SELECT p_partkey, list_sort(list_filter(said, lambda e: NOT list_contains(
    [lower(p_name), lower(p_brand), lower(p_type)], e))) AS found FROM named)"""


@CATALOG.add("v2_expect_no_hallucinated_entities", f"""WITH {INVENTED} SELECT p_partkey, len(found) = 0 AS passed,
  array_to_string(found, ', ') AS unmatched FROM invented""")
def v2(spark, folder):
    check = expectations.NoInventedEntities("description", ["p_name", "p_brand", "p_type"])
    rows = products(spark, folder)
    return rows.select("p_partkey", check.verdict(rows).alias("v")).select(
        "p_partkey", "v.passed", F.col("v.evidence")["unmatched"].alias("unmatched")
    )


@CATALOG.add("u0c_entity_difference", f"""WITH {INVENTED} SELECT e AS entity, COUNT(*) AS parts
  FROM (SELECT UNNEST(found) AS e FROM invented) GROUP BY e""")
def u0c(spark, folder):
    rows = products(spark, folder)
    sources = [F.col("p_name"), F.col("p_brand"), F.col("p_type")]
    left = scorers.unsupported_entities(F.col("description"), sources, list(scorers.ENTITY_PATTERNS))
    return rows.select(F.explode(left).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("parts"))


LEXICON = {"BIG": ["large", "heavy"], "SMALL": ["small", "light"]}
LABELLED = f"""{PRODUCTS}, labelled AS (SELECT p_partkey, size_label = CASE WHEN p_size > 25 THEN 'BIG'
  ELSE 'SMALL' END AS passed FROM products)"""


@CATALOG.add("v3_expect_label_matches_content", f"WITH {LABELLED} SELECT p_partkey, passed FROM labelled")
def v3(spark, folder):
    check = expectations.LabelMatchesContent("size_label", "review", lexicon=LEXICON)
    rows = products(spark, folder)
    return rows.select("p_partkey", check.verdict(rows)["passed"].alias("passed"))


UNIT = """units AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) /
    sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u FROM embeddings),
  dims AS (SELECT vec_id, label, UNNEST(range(64)) AS dim, UNNEST(u) AS x FROM units)"""

NEAREST = f"""{UNIT}, centres AS (SELECT label, dim, AVG(x) AS c FROM dims GROUP BY ALL),
  lengths AS (SELECT label, SQRT(SUM(c * c)) AS len FROM centres GROUP BY label),
  close AS (SELECT d.vec_id, c.label, SUM(d.x * c.c) / MAX(len) AS cos FROM dims d JOIN centres c USING (dim)
    JOIN lengths l ON l.label = c.label GROUP BY ALL),
  nearest AS (SELECT vec_id, arg_max(label, cos) AS predicted, MAX(cos) AS cos FROM close GROUP BY vec_id)"""


def _predicted(spark, folder):
    vectors = table(spark, folder, "embeddings")
    centres = drift.centroids(vectors, "embedding", ["label"])
    return drift.nearest_label(vectors, "embedding", centres, "label")


@CATALOG.add("v3_nearest_centroid", f"""WITH {NEAREST} SELECT vec_id, e.label = predicted AS passed, predicted,
  ROUND(cos, 5) AS closeness FROM nearest JOIN embeddings e USING (vec_id)""")
def v3_nearest(spark, folder):
    rows = _predicted(spark, folder)
    check = expectations.LabelMatchesContent(
        "label", "vec_id", predicted_column="predicted", confidence_column="closeness"
    )
    return rows.select("vec_id", check.verdict(rows)["passed"].alias("passed"), "predicted",
                       F.round("closeness", 5).alias("closeness"))


@CATALOG.add("v3_label_lexicon_documents", r"""WITH words AS (SELECT doc_id, quality,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w IN ('the', 'of', 'and')) AS hits
  FROM documents JOIN labels USING (doc_id))
  SELECT doc_id, quality = 1 OR len(hits) = 0 AS passed, len(hits) = 0 AS unsure FROM words""")
def v3_documents(spark, folder):
    """English function words stand for quality; a text without any says nothing."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    check = expectations.LabelMatchesContent("quality", "text", lexicon={"1": ["the", "of", "and"], "0": []})
    judged = rows.select("doc_id", check.verdict(rows).alias("v"))
    return judged.select("doc_id", "v.passed", (F.col("v.confidence") == 0).alias("unsure"))


@CATALOG.add("g6_centroid", f"""WITH {UNIT} SELECT dim, ROUND(AVG(x), 6) AS mean, COUNT(*) AS n FROM dims GROUP BY dim""")
def g6(spark, folder):
    centre = drift.by_dimension(drift.centroids(table(spark, folder, "embeddings"), "embedding"), [])
    return centre.select("dim", F.round("c", 6).alias("mean"), F.col("vectors").alias("n"))


@CATALOG.add("n8_vector_arithmetic", f"""WITH {UNIT} SELECT vec_id, ROUND(SUM(x * dim), 5) AS weighted,
  ROUND(SQRT(SUM(x * x)), 6) AS length, ROUND(SUM(0.9 * x + 0.1 * dim), 5) AS blended FROM dims GROUP BY vec_id""")
def n8(spark, folder):
    from plumbline.functions import vectors

    u = vectors.unit(F.col("embedding"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    total = F.aggregate(vectors.blend(F.col("u"), F.col("s"), 0.1), F.lit(0.0), lambda t, x: t + x)
    rows = table(spark, folder, "embeddings").select("vec_id", u.alias("u"), steps.alias("s"))
    return rows.select(
        "vec_id", F.round(vectors.dot(F.col("u"), F.col("s")), 5).alias("weighted"),
        F.round(vectors.norm(F.col("u")), 6).alias("length"), F.round(total, 5).alias("blended"),
    )


BATCHES = f"""{UNIT}, batches AS (SELECT vec_id // 100 AS batch, dim, AVG(x) AS c, COUNT(*) AS n FROM dims GROUP BY ALL),
  baseline AS (SELECT batch, dim, n, c, CAST(NULL AS DOUBLE) AS b, c AS b_after FROM batches WHERE batch = 0
    UNION ALL SELECT s.batch, s.dim, s.n, s.c, f.b_after, 0.9 * f.b_after + 0.1 * s.c
    FROM baseline f JOIN batches s ON s.batch = f.batch + 1 AND s.dim = f.dim),
  drifts AS (SELECT batch, MAX(n) AS n, 1 - SUM(c * b) AS drift_dot,
    1 - SUM(c * b) / SQRT(SUM(c * c) FILTER (WHERE b IS NOT NULL) * SUM(b * b)) AS drift_cosine
    FROM baseline GROUP BY batch)"""


def _batched(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vectors.withColumn("batch", F.floor(F.col("vec_id") / 100))


@CATALOG.add("w8_drift_over_batches", f"""WITH RECURSIVE {BATCHES} SELECT batch, n, ROUND(drift_dot, 5) AS drift_dot,
  ROUND(drift_cosine, 5) AS drift_cosine, COALESCE(drift_cosine <= 0.15, TRUE) AS passed FROM drifts""")
def w8(spark, folder):
    judged = drift.drift_over_batches(_batched(spark, folder), "embedding", "batch")
    return judged.select("batch", "n", F.round("drift_dot", 5).alias("drift_dot"),
                         F.round("drift_cosine", 5).alias("drift_cosine"), "passed")


@CATALOG.add("w8_baseline_after_batches", f"""WITH RECURSIVE {BATCHES} SELECT dim, ROUND(b_after, 6) AS baseline
  FROM baseline WHERE batch = (SELECT MAX(batch) FROM batches)""")
def w8_after(spark, folder):
    after = drift.baseline_after_batches(_batched(spark, folder), "embedding", "batch")
    return after.select("dim", F.round("baseline", 6).alias("baseline"))


@CATALOG.add("w9_lookback_baseline", f"""WITH {UNIT}, days AS (SELECT vec_id // 50 AS day, dim, SUM(x) AS s, COUNT(*) AS n
    FROM dims GROUP BY ALL),
  based AS (SELECT day, n, s / n AS c, SUM(s) OVER w / SUM(n) OVER w AS b FROM days
    WINDOW w AS (PARTITION BY dim ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING))
  SELECT day, MAX(n) AS n, ROUND(1 - SUM(c * b), 5) AS drift_dot,
    ROUND(1 - SUM(c * b) / SQRT(SUM(c * c) FILTER (WHERE b IS NOT NULL) * SUM(b * b)), 5) AS drift_cosine
  FROM based GROUP BY day""")
def w9(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn("day", F.floor(F.col("vec_id") / 50))
    judged = drift.drift_against_lookback(vectors, "embedding", "day")
    return judged.select("day", "n", F.round("drift_dot", 5).alias("drift_dot"),
                         F.round("drift_cosine", 5).alias("drift_cosine"))


HALVES = f"""{UNIT}, sides AS (SELECT label >= 5 AS later, dim, AVG(x) AS c, COUNT(*) AS n FROM dims GROUP BY ALL),
  pair AS (SELECT dim, MAX(c) FILTER (WHERE later) AS c, MAX(c) FILTER (WHERE NOT later) AS b,
    MAX(n) FILTER (WHERE later) AS n FROM sides GROUP BY dim),
  compared AS (SELECT MAX(n) AS n, 1 - SUM(c * b) AS drift_dot, 1 - SUM(c * b) / SQRT(SUM(c * c) * SUM(b * b))
    AS drift_cosine FROM pair)"""


def _halves(spark, folder):
    vectors = table(spark, folder, "embeddings")
    baseline = drift.centroids(vectors.where("label < 5"), "embedding").select("centroid")
    return vectors.where("label >= 5"), baseline


@CATALOG.add("v4_expect_semantic_drift_below", f"""WITH {HALVES} SELECT n AS total_records, drift_cosine <= 0.15 AS passed,
  ROUND(drift_dot, 5) AS drift_dot, ROUND(drift_cosine, 5) AS drift_cosine FROM compared""")
def v4(spark, folder):
    later, baseline = _halves(spark, folder)
    check = expectations.SemanticDrift("embedding", baseline=baseline)

    def figure(name):
        return F.round(F.col("evidence")[name].cast("double"), 5).alias(name)

    return check.evaluate(later).select("total_records", "passed", figure("drift_dot"), figure("drift_cosine"))


@CATALOG.add("e6_baseline_injection", f"""WITH {HALVES} SELECT dim, ROUND(0.9 * b + 0.1 * c, 6) AS baseline FROM pair""")
def e6(spark, folder):
    later, baseline = _halves(spark, folder)
    check = expectations.SemanticDrift("embedding")
    check.set_baseline(baseline)
    moved = check.next_baseline(later)
    return moved.select(F.posexplode("centroid").alias("dim", "x")).select("dim", F.round("x", 6).alias("baseline"))


@CATALOG.add("j4_join_baseline", f"""WITH {UNIT}, centres AS (SELECT label, dim, AVG(x) AS c FROM dims GROUP BY ALL),
  base AS (SELECT dim, AVG(x) AS b FROM dims GROUP BY dim)
  SELECT label, ROUND(1 - SUM(c * b), 6) AS drift_dot FROM centres JOIN base USING (dim) GROUP BY label""")
def j4(spark, folder):
    """Every label as a batch of its own, against one stored baseline."""
    vectors = table(spark, folder, "embeddings")
    stored = drift.centroids(vectors, "embedding").select("centroid").scalar()
    by_dot, _ = drift.drift_columns(F.col("centroid"), F.col("stored"))
    centres = drift.centroids(vectors, "embedding", ["label"]).withColumn("stored", stored)
    return centres.select("label", F.round(by_dot, 6).alias("drift_dot"))


SUITE = f"""{CONSISTENT}, named AS (SELECT *, {ENTITY_SQL.format(t='description')} AS said FROM products),
  invented AS (SELECT p_partkey, list_sort(list_filter(said, lambda e: NOT list_contains(
    [lower(p_name), lower(p_brand), lower(p_type)], e))) AS found FROM named),
  labelled AS (SELECT p_partkey, size_label = CASE WHEN p_size > 25 THEN 'BIG' ELSE 'SMALL' END AS passed FROM products),
  judged AS (
    SELECT 'expect_column_to_be_factually_consistent_with' AS expectation, 'description' AS column_name, p_partkey,
      len(found) = 0 AS passed, CAST(0.95 AS DOUBLE) AS threshold FROM against
    UNION ALL SELECT 'expect_column_to_not_hallucinate_entities', 'description', p_partkey, len(found) = 0, 0.9 FROM invented
    UNION ALL SELECT 'expect_label_to_match_content', 'size_label', p_partkey, passed, 0.9 FROM labelled),
  results AS (SELECT expectation, column_name, COUNT(*) AS total_records,
    COUNT(*) FILTER (WHERE passed) AS passed_records, COUNT(*) FILTER (WHERE NOT passed) AS failed_records,
    COUNT(*) FILTER (WHERE passed) / COUNT(*) AS pass_rate, MAX(threshold) AS threshold,
    COUNT(*) FILTER (WHERE passed) / COUNT(*) >= MAX(threshold) AS passed FROM judged GROUP BY ALL)"""


def product_suite():
    return (
        suites.Suite("products")
        .add(expectations.FactualConsistency("description", "spec"))
        .add(expectations.NoInventedEntities("description", ["p_name", "p_brand", "p_type"], threshold=0.9))
        .add(expectations.LabelMatchesContent("size_label", "review", lexicon=LEXICON))
    )


def _run(spark, folder):
    return product_suite().run(products(spark, folder), index="p_partkey", **RUN)


RESULT_COLUMNS = "expectation, column_name, total_records, passed_records, failed_records, pass_rate, passed"


@CATALOG.add("v8_run_suite", f"""WITH {SUITE} SELECT 'run-1' AS run_id, 'products' AS suite_name, expectation, column_name,
  total_records, passed_records, failed_records, ROUND(pass_rate, 9) AS pass_rate, threshold, passed FROM results""")
def v8(spark, folder):
    results = _run(spark, folder).results
    return results.drop("dataset_name", "run_at", "metadata").withColumn("pass_rate", F.round("pass_rate", 9))


@CATALOG.add("g3_expectation_rollup", f"""WITH {LABELLED} SELECT 'label' AS expectation, 'size_label' AS column_name,
  COUNT(*) AS total_records, COUNT(*) FILTER (WHERE passed) AS passed_records,
  COUNT(*) FILTER (WHERE NOT passed) AS failed_records, ROUND(COUNT(*) FILTER (WHERE passed) / COUNT(*), 9) AS pass_rate,
  COUNT(*) FILTER (WHERE passed) / COUNT(*) >= 0.95 AS passed FROM labelled""")
def g3(spark, folder):
    rows = products(spark, folder)
    check = expectations.LabelMatchesContent("size_label", "review", lexicon=LEXICON)
    judged = rows.select(F.lit("label").alias("expectation"), F.lit("size_label").alias("column_name"),
                         check.verdict(rows)["passed"].alias("passed"))
    return suites.rollup_verdicts(judged, 0.95).withColumn("pass_rate", F.round("pass_rate", 9))


@CATALOG.add("g4_suite_rollup", f"""WITH {SUITE} SELECT 'products' AS suite_name, 'run-1' AS run_id,
  COUNT(*) AS expectations, COUNT(*) FILTER (WHERE NOT passed) AS failed_expectations, bool_and(passed) AS passed,
  ROUND(SUM(passed_records) / SUM(total_records), 9) AS overall_pass_rate FROM results""")
def g4(spark, folder):
    return _run(spark, folder).overall().withColumn("overall_pass_rate", F.round("overall_pass_rate", 9))


@CATALOG.add("n15_summary_text", f"""WITH {SUITE} SELECT expectation, column_name, printf('[%s] %s(%s) pass_rate=%.1f%% (%d/%d)',
  CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END, expectation, column_name, ROUND(pass_rate * 100 + 1e-9, 1), passed_records, total_records)
  AS summary FROM results""")
def n15(spark, folder):
    return _run(spark, folder).summary()


@CATALOG.add("w6_first_n_failures", f"""WITH {SUITE} SELECT expectation, p_partkey AS record_index FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY expectation ORDER BY p_partkey) AS rn FROM judged WHERE NOT passed)
  WHERE rn <= 100""")
def w6(spark, folder):
    return _run(spark, folder).verdicts.select("expectation", "record_index")


@CATALOG.add("l4_sample_rows", """SELECT doc_id, ROW_NUMBER() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS record_index
  FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 150""")
def l4(spark, folder):
    drawn = suites.sample_rows(table(spark, folder, "documents").select("doc_id"), 150, "doc_id")
    return drawn.select("doc_id", "record_index")


@CATALOG.add("s8_load_suite_config", f"""WITH {SUITE} SELECT {RESULT_COLUMNS} FROM (SELECT * REPLACE (
  pass_rate >= 0.5 AS passed, ROUND(pass_rate, 9) AS pass_rate) FROM results)
  WHERE expectation <> 'expect_label_to_match_content'""")
def s8(spark, folder):
    config = {"models": {"products": {"checks": [
        {"type": "factual_consistency", "column": "description", "reference_column": "spec", "threshold": 0.5},
        {"type": "hallucination_detection", "column": "description",
         "source_columns": ["p_name", "p_brand", "p_type"], "threshold": 0.5},
        {"type": "no_such_type", "column": "description"},
    ]}}}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        suite = suites.Suite.from_config(config, "products")
    results = suite.run(products(spark, folder), index="p_partkey", **RUN).results
    return results.select(*[c.strip() for c in RESULT_COLUMNS.split(",")]).withColumn(
        "pass_rate", F.round("pass_rate", 9)
    )


@CATALOG.add("e5_expectation_registry", """SELECT 'documents' AS suite_name, 'expect_min_length' AS expectation,
  COUNT(*) AS total_records, COUNT(*) FILTER (WHERE LENGTH(text) >= 100) AS passed_records FROM documents""")
def e5(spark, folder):
    @expectations.register_expectation("min_length")
    class MinLength(expectations.RowExpectation):
        """An expectation of the user's own."""

        name = "expect_min_length"

        def __init__(self, column, shortest, threshold=0.95):
            super().__init__(column, threshold)
            self.shortest = shortest

        def judge(self, df):
            passed = F.coalesce(F.length(self.column) >= self.shortest, F.lit(False))
            return scorers.verdict(passed, F.lit(1.0), F.lit(""), {"column": F.lit(self.column)})

    config = {"models": {"documents": {"checks": [{"type": "min_length", "column": "text", "shortest": 100}]}}}
    suite = suites.Suite.from_config(config, "documents")
    results = suite.run(table(spark, folder, "documents"), index="doc_id", **RUN).results
    return results.select("suite_name", "expectation", "total_records", "passed_records")


@CATALOG.add("e1_row_scorer", """SELECT doc_id, lang = 'en' AS passed FROM documents""")
def e1(spark, folder):
    def only_english(expectation, df):
        return scorers.verdict(F.col(expectation.column) == "en", F.lit(1.0), F.lit(""), {"lang": F.col("lang")})

    check = expectations.LabelMatchesContent("lang", "text", scorer=only_english)
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", check.verdict(docs)["passed"].alias("passed"))


@CATALOG.add("e2_batch_expectation", """SELECT 'expect_languages' AS expectation, COUNT(*) AS total_records,
  CASE WHEN COUNT(DISTINCT lang) >= 3 THEN COUNT(*) ELSE 0 END AS passed_records FROM documents""")
def e2(spark, folder):
    class Languages(expectations.BatchExpectation):
        """At least three languages in a batch."""

        name = "expect_languages"

        def evaluate(self, df):
            return df.agg(F.count(F.lit(1)).alias("total_records"),
                          (F.count_distinct(self.column) >= 3).alias("passed")).select(
                "*", F.lit(1.0).alias("confidence"), F.lit("").alias("reason"),
                F.create_map().cast("map<string,string>").alias("evidence"))

    results = suites.Suite("documents").add(Languages("lang")).run(
        table(spark, folder, "documents"), index="doc_id", **RUN).results
    return results.select("expectation", "total_records", "passed_records")


PAYLOADS = "payloads AS (SELECT doc_id, text AS shown FROM documents)"


def _payloads(spark, folder):
    check = expectations.FactualConsistency("text", "source", context="invented prose")
    return check.payloads(table(spark, folder, "documents"), "doc_id")


@CATALOG.add("v5_judge_payload", f"""WITH {PAYLOADS} SELECT doc_id AS record_index, shown, LENGTH(shown) AS shown_length
  FROM payloads""")
def v5(spark, folder):
    shown = F.get_json_object("payload", "$.record.text")
    return _payloads(spark, folder).select(
        "record_index", shown.alias("shown"), F.length(shown).cast("long").alias("shown_length")
    )


def _judge(payloads: pd.Series) -> pd.Series:
    """A stand-in for an outside judge: passes records with a short text."""
    short = payloads.map(lambda p: len(json.loads(p)["record"]["text"]) <= 250)
    return short.map({True: '{"passed": true, "confidence": 0.8}', False: '{"passed": false, "reason": "long"}'})


@CATALOG.add("v7_apply_scorer", """SELECT doc_id AS record_index, LENGTH(text) <= 250 AS passed,
  CASE WHEN LENGTH(text) <= 250 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents""")
def v7(spark, folder):
    judged = verdicts.apply_scorer(_payloads(spark, folder), _judge)
    read = judged.select("record_index", verdicts.parse_verdict(F.col("response")).alias("v"))
    return read.select("record_index", "v.passed", "v.confidence")


def _strict_judge(payloads: pd.Series) -> pd.Series:
    """The stand-in again, but answering in prose where a text has a multiple of seven characters."""
    lengths = payloads.map(lambda p: len(json.loads(p)["record"]["text"]))
    return _judge(payloads).where(lengths % 7 != 0, "let me think about it")


@CATALOG.add("v8_suite_with_judge", """WITH judged AS (
    SELECT doc_id, LENGTH(text) % 7 = 0 AS error, LENGTH(text) % 7 = 0 OR LENGTH(text) <= 250 AS ok FROM documents)
  SELECT COUNT(*) AS total_records, SUM(ok::INT)::BIGINT AS passed_records, SUM((NOT ok)::INT)::BIGINT AS failed_records,
    SUM(error::INT)::VARCHAR AS judge_errors, SUM((NOT ok)::INT)::BIGINT AS verdicts,
    MIN(CASE WHEN NOT ok THEN doc_id END) AS first_failing FROM judged""")
def v8_judge(spark, folder):
    """A suite whose verdicts come from outside: whole texts as payloads, unreadable answers counted."""
    suite = suites.Suite("judged").add(expectations.FactualConsistency("text", "source", context="invented prose"))
    run = suite.run(table(spark, folder, "documents"), index="doc_id", judge=_strict_judge, failures_kept=None)
    failing = run.verdicts.agg(F.count(F.lit(1)).alias("verdicts"), F.min("record_index").alias("first_failing"))
    counted = run.results.select(
        "total_records", "passed_records", "failed_records", F.col("metadata")["judge_errors"].alias("judge_errors")
    )
    return counted.withColumns({c: failing.select(c).scalar() for c in ("verdicts", "first_failing")})


RESPONSES = """responses AS (SELECT event_id, CASE event_id % 8
    WHEN 0 THEN '{"passed": true, "confidence": 0.9, "reason": "ok", "evidence": {"k": 1}}'
    WHEN 1 THEN '{"passed": false, "reason": "bad"}'
    WHEN 2 THEN '```json' || chr(10) || '{"passed": false, "confidence": 0.25, "reason": "fenced"}' || chr(10) || '```'
    WHEN 3 THEN 'not json at all ' || event_id
    WHEN 4 THEN '{"passed": "false", "confidence": 1, "reason": "text"}'
    WHEN 5 THEN '[1, 2, 3]'
    WHEN 6 THEN '{"confidence": 0.7}'
    ELSE NULL END AS response FROM events)"""


@CATALOG.add("v6_parse_verdict", """SELECT event_id,
    CASE event_id % 8 WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE TRUE END AS passed,
    CAST(CASE event_id % 8 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS confidence,
    CASE event_id % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad' WHEN 2 THEN 'fenced'
      WHEN 3 THEN 'Judge unavailable: response is not a JSON object'
      WHEN 4 THEN 'Judge unavailable: passed is not a boolean'
      WHEN 5 THEN 'Judge unavailable: response is not a JSON object'
      WHEN 6 THEN 'Judge unavailable: passed is not a boolean' ELSE 'Judge unavailable: no response' END AS reason,
    CASE event_id % 8 WHEN 0 THEN '{"k":1}' ELSE '{}' END AS evidence,
    event_id % 8 > 2 AS judge_error FROM events""")
def v6(spark, folder):
    cases = {
        0: '{"passed": true, "confidence": 0.9, "reason": "ok", "evidence": {"k": 1}}',
        1: '{"passed": false, "reason": "bad"}',
        2: '```json\n{"passed": false, "confidence": 0.25, "reason": "fenced"}\n```',
        4: '{"passed": "false", "confidence": 1, "reason": "text"}',
        5: "[1, 2, 3]",
        6: '{"confidence": 0.7}',
    }
    kind = F.col("event_id") % 8
    response = F.when(kind == 3, F.concat(F.lit("not json at all "), F.col("event_id").cast("string")))
    for case, text in cases.items():
        response = response.when(kind == case, F.lit(text))
    events = table(spark, folder, "events").select("event_id", response.alias("response"))
    return events.select("event_id", verdicts.parse_verdict(F.col("response")).alias("v")).select("event_id", "v.*")


@CATALOG.add("v9_parse_fix_response", """SELECT event_id, CASE event_id % 3
    WHEN 0 THEN 'SELECT ' || event_id || ' AS a'
    WHEN 1 THEN 'select ' || event_id || chr(10) || 'with x as (select 1)'
    ELSE 'no statement for ' || event_id END AS sql,
  CASE event_id % 3 WHEN 0 THEN 'because of ' || event_type ELSE '' END AS explanation FROM events""")
def v9(spark, folder):
    key = F.col("event_id").cast("string")
    kind = F.col("event_id") % 3
    fenced = F.concat(F.lit("Explanation: because of "), F.col("event_type"), F.lit("\n```sql\nSELECT "), key,
                      F.lit(" AS a\n```\n"))
    lines = F.concat(F.lit("try this\nselect "), key, F.lit("\nwith x as (select 1)\nthanks"))
    response = F.when(kind == 0, fenced).when(kind == 1, lines).otherwise(
        F.concat(F.lit("no statement for "), key))
    events = table(spark, folder, "events").select("event_id", response.alias("response"))
    return events.select("event_id", verdicts.parse_fix(F.col("response")).alias("f")).select("event_id", "f.*")


@CATALOG.add("v4_word_drift", """WITH words AS (
    SELECT lang, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents),
  counted AS (SELECT lang, word, COUNT(*)::DOUBLE AS n FROM words GROUP BY ALL),
  norms AS (SELECT lang, SUM(n * n) AS squares FROM counted GROUP BY lang),
  dots AS (SELECT a.lang, SUM(a.n * b.n) AS dot FROM counted a JOIN counted b ON a.word = b.word AND b.lang = 'en' GROUP BY a.lang)
  SELECT n.lang, 1 - COALESCE(dot, 0) / SQRT(n.squares * e.squares) AS drift FROM norms n LEFT JOIN dots USING (lang)
  JOIN norms e ON e.lang = 'en'""")
def v4_words(spark, folder):
    """Languages as batches: how far each one's word frequencies are from the English ones."""
    found = drift.word_frequencies(table(spark, folder, "documents"), "text", ["lang"])
    return drift.word_drift(found, found.where("lang = 'en'").drop("lang"), ["lang"])


@CATALOG.add("v4_text_drift")
def v4_text(spark, folder):
    """Languages as batches: each language's hashed words against the English ones. No SQL twin: word hashing."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    vectors = drift.text_vectors(docs, "text", "vector", dimensions=256)
    centres = drift.centroids(vectors, "vector", ["lang"])
    english = centres.where("lang = 'en'").select("centroid").scalar()
    by_dot, by_cosine = drift.drift_columns(F.col("centroid"), F.col("_en"))
    return centres.withColumn("_en", english).select(
        "lang", "n", by_dot.alias("drift_dot"), by_cosine.alias("drift_cosine")
    )
