"""Reading the run results and manifests a dbt project leaves behind."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Artifact names, statuses that count as failing, defaults of missing fields.
RUN_RESULTS = "target/run_results.json"
MANIFEST = "target/manifest.json"
FAILING = ("fail", "error")
DEFAULT_TEST_TYPE = "generic"

RESULTS = "results array<struct<unique_id string, status string, failures bigint, message string>>"
NODE = (
    "struct<name string, resource_type string, "
    "test_metadata struct<name string, kwargs struct<`values` array<string>>>, "
    "attached_node string, column_name string, compiled_code string, compiled_sql string, "
    "columns map<string, struct<name string, description string, data_type string>>>"
)


def scan_run_results(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """One row per test result, from documents that are files or lines."""
    # A broken document is an error: read as nulls it would pass for "no failures".
    documents = spark.read.schema(RESULTS).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    return documents.select(F.inline("results"))


def scan_manifest(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """One row per manifest node: `unique_id` and the fields the scans need."""
    reader = spark.read.schema(f"nodes map<string, {NODE}>").option("multiLine", multiline).option("mode", "FAILFAST")
    documents = reader.json(path)
    return documents.select(F.explode("nodes").alias("unique_id", "_n")).select("unique_id", "_n.*")


def _or_empty(value: Column | str) -> Column:
    return F.coalesce(value, F.lit(""))


def compiled(code: Column, sql: Column) -> Column:
    """The compiled code, from the older field name where the newer is empty."""
    return F.coalesce(F.when(code != "", code), sql, F.lit(""))


def failing_tests(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Failed and erroneous results with what the manifest knows about them.

    A result without a manifest node keeps its id as name.
    """
    unique_id = _or_empty("unique_id")
    failed = results.where(F.col("status").isin(*FAILING)).withColumn("unique_id", unique_id)
    known = failed.join(nodes, "unique_id", "left")
    return known.select(
        "unique_id",
        "status",
        F.coalesce("name", "unique_id").alias("node_name"),
        F.coalesce("test_metadata.name", F.lit(DEFAULT_TEST_TYPE)).alias("test_type"),
        _or_empty("attached_node").alias("model"),
        _or_empty("column_name").alias("column_name"),
        F.coalesce("failures", F.lit(0).cast("long")).alias("failures"),
        _or_empty("message").alias("message"),
        compiled(F.col("compiled_code"), F.col("compiled_sql")).alias("compiled_code"),
        F.col("test_metadata.kwargs.values").alias("accepted_values"),
    )


def scan_failing_tests(spark: SparkSession, project: str) -> DataFrame:
    """The failing tests of a project's last run; none where it has not run."""
    folder = project.rstrip("/")
    try:
        results = scan_run_results(spark, f"{folder}/{RUN_RESULTS}")
    except AnalysisException as problem:
        _only_if_missing(problem)
        results = spark.createDataFrame([], RESULTS).select(F.inline("results"))
    return failing_tests(results, _manifest_or_none(spark, folder))


def _only_if_missing(problem: AnalysisException) -> None:
    """What has not been written yet reads as empty; any other error is one."""
    if problem.getCondition() != "PATH_NOT_FOUND":
        raise problem


def _manifest_or_none(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return scan_manifest(spark, f"{folder}/{MANIFEST}")
    except AnalysisException as problem:
        _only_if_missing(problem)
        empty = spark.createDataFrame([], f"nodes map<string, {NODE}>")
        return empty.select(F.explode("nodes").alias("unique_id", "_n")).select("unique_id", "_n.*")


def models(nodes: DataFrame) -> DataFrame:
    """(model, sql) of every model in a manifest."""
    return nodes.where(F.col("resource_type") == "model").select(
        F.col("name").alias("model"),
        compiled(F.col("compiled_code"), F.col("compiled_sql")).alias("sql"),
        "columns",
    )


def model_sql(spark: SparkSession, project: str, model: str) -> DataFrame:
    """One row `sql`: from the manifest, else from a compiled file of that name, else empty."""
    folder = project.rstrip("/")
    known = models(_manifest_or_none(spark, folder)).where(F.col("model") == model).select("sql").limit(1)
    try:
        files = (
            spark.read.option("pathGlobFilter", f"{model}.sql")
            .text(f"{folder}/target", wholetext=True, recursiveFileLookup=True)
            .select(F.col("value").alias("sql"), F.input_file_name().alias("_file")).orderBy("_file").limit(1)
        )
    except AnalysisException as problem:
        _only_if_missing(problem)
        files = known.limit(0)
    choices = known.select(F.lit(0).alias("_rank"), "sql").unionByName(
        files.select(F.lit(1).alias("_rank"), "sql")
    )
    return choices.agg(F.coalesce(F.min_by("sql", "_rank"), F.lit("")).alias("sql"))


def model_columns(nodes: DataFrame, model: str) -> DataFrame:
    """(column_name, description, data_type) of a model."""
    columns = models(nodes).where(F.col("model") == model).select(F.explode("columns").alias("column_name", "_c"))
    return columns.select("column_name", "_c.description", "_c.data_type")
