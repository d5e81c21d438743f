"""Table scans: snapshots by name, CSV uploads, lineage documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import last_name_part


def scan_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The snapshot of a table; a missing one is an error, not an empty table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header. Without a schema every column is text and nothing is read ahead."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def register_table(df: DataFrame, name: str) -> DataFrame:
    """Make a frame readable in SQL under a name, in its own session."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


_NAMED = "fullyQualifiedName string"
LINEAGE = (
    f"nodes array<struct<{_NAMED}, name string, type string>>, "
    f"upstreamEdges array<struct<fromEntity struct<{_NAMED}>, toEntity struct<{_NAMED}>>>"
)


def scan_lineage(spark: SparkSession, path: str, *, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lineage documents: one per file, or one per line."""
    documents = spark.read.schema(LINEAGE).option("multiLine", multiline).json(path)
    return lineage_nodes(documents), lineage_edges(documents)


def lineage_nodes(documents: DataFrame) -> DataFrame:
    """(fqn, name, node_type); the name defaults to the last part of the full one."""
    node = documents.select(F.explode("nodes").alias("n"))
    fqn = F.coalesce("n.fullyQualifiedName", F.lit(""))
    return node.select(
        fqn.alias("fqn"),
        F.coalesce("n.name", last_name_part(fqn)).alias("name"),
        F.lower(F.coalesce("n.type", F.lit("table"))).alias("node_type"),
    )


def lineage_edges(documents: DataFrame) -> DataFrame:
    edge = documents.select(F.explode("upstreamEdges").alias("e"))
    return edge.select(
        F.coalesce("e.fromEntity.fullyQualifiedName", F.lit("")).alias("src"),
        F.coalesce("e.toEntity.fullyQualifiedName", F.lit("")).alias("dst"),
    )
