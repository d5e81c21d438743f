"""The corpus pipeline, stage by stage, on the smallest tables and on odd documents; queries against their SQL."""

import pytest
from compare import database, rows_of, spark_rows, sql_rows
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import anchors, curriculum, decontaminate, linewindows, quality, queries
from tests.llm.conftest import COLUMNS, ODD, frame

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_follow_their_operators(spark, stages):
    documents, good, cut, single, clean, mixed = stages
    assert all(s.columns == documents.columns for s in stages[1:-1])
    labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(good) == ids(quality.scored(documents, labels).where("predicted = 1"))
    wrong = good.join(labels, "doc_id").where("quality = 0").count()
    kept, there = good.join(labels, "doc_id").where("quality = 1").count(), labels.where("quality = 1").count()
    assert wrong <= 1 and kept >= 0.9 * there  # 65 labels to learn from
    assert ids(good) - ids(cut) == ids(linewindows.without_repeats(good).where("n_removed > 0 AND n_removed = n_lines"))
    assert ids(single) <= ids(cut) and anchors.one_per_group(single).count() == single.count()
    assert cut.select("text").distinct().count() >= single.count()
    leaked = {r["doc_id"] for r in decontaminate.leaks(single, items).collect()}
    assert ids(clean) == ids(single) - leaked
    plan = curriculum.planned(clean).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum("taken")).first()[0] == plan


def test_run_equals_the_stages(spark, stages):
    done = corpus_pipeline.run(spark, FOLDER)
    want = stages[-1].select("doc_id", "source", "epoch", "size", "taken", "position", F.md5("text").alias("digest"))
    assert rows_of(done.columns, map(tuple, done.collect())) == rows_of(want.columns, map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_documents(spark, rows):
    docs = frame(spark, rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, FOLDER)
        assert left.columns == docs.columns and left.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).where("taken < 1").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, FOLDER))
    if name in queries.SQL:
        assert got == sql_rows(database(FOLDER), queries.SQL[name])
    else:
        assert got[1]
