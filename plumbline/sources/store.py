"""The store: Parquet tables under one folder, appended to and read back by latest state.

Plain Parquet has no upsert, so what the engine would update is appended and
the latest (or first) values per key are taken on reading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.incidents import current_state
from plumbline.schemas import BASELINE, INCIDENT, INCIDENT_EVENT, RESULT, VERDICT, VIOLATION

# Fixed value: severity of a violation that carries none.
DEFAULT_SEVERITY = "warning"

# Schema of each table, the time its partitions are taken from, and how wide they are.
# Violations come in volume; of the others a month makes a folder worth having.
TABLES: dict[str, tuple[T.StructType, str, str]] = {
    "violations": (VIOLATION, "timestamp", "day"),
    "results": (RESULT, "run_at", "month"),
    "verdicts": (VERDICT, "created_at", "day"),
    "baselines": (BASELINE, "snapshot_at", "month"),
    "incident_events": (INCIDENT_EVENT, "created_at", "month"),
    "incidents": (INCIDENT, "first_seen", "month"),
}
DATE = "date"
BATCH = "batch_id"


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    missing = F.lit(None)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else missing).cast(f.dataType).alias(f.name)
        for f in schema
    ])


@dataclass(frozen=True)
class Store:
    """Tables of results, violations, baselines and incidents under `folder`."""

    spark: SparkSession
    folder: str

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def append(self, table: str, df: DataFrame, *, batch_id: int | None = None) -> None:
        """Add rows, partitioned by date.

        Rows are brought together by date first, or every task would write a file
        per date; `rebalance` lets Spark split dates that hold too much for one task.
        With a batch id the rows replace what an earlier try of that batch
        wrote, so a micro-batch that runs twice is stored once.
        """
        schema, time, width = TABLES[table]
        dated = _shaped(df, schema).withColumn(DATE, F.to_date(F.date_trunc(width, f"`{time}`")))
        rows = dated.hint("rebalance", DATE)
        if batch_id is None:
            rows.withColumn(BATCH, F.lit(-1).cast("long")).write.mode("append").partitionBy(
                BATCH, DATE
            ).parquet(self.path(table))
            return
        # The batch folder is named in full, so only it is replaced.
        rows.write.mode("overwrite").partitionBy(DATE).parquet(
            f"{self.path(table)}/{BATCH}={int(batch_id)}"
        )

    def save_violations(self, found: DataFrame, *, batch_id: int | None = None) -> None:
        filled = found.withColumn("severity", F.coalesce("severity", F.lit(DEFAULT_SEVERITY))).withColumn(
            "value", F.coalesce("value", F.lit(""))
        )
        self.append("violations", filled, batch_id=batch_id)

    def save_run(self, run) -> None:
        """Results and sampled verdicts of a suite run."""
        self.append("results", run.results)
        self.append("verdicts", run.verdicts)

    def save_baselines(self, snapshot: DataFrame, *, batch_id: int | None = None) -> None:
        self.append("baselines", snapshot, batch_id=batch_id)

    def save_incident_events(self, events: DataFrame) -> None:
        self.append("incident_events", events)

    def read(self, table: str) -> DataFrame:
        """The table; empty where nothing was saved yet. Filters on `date` prune folders."""
        schema, _, _ = TABLES[table]
        partitions = T.StructType([T.StructField(BATCH, T.LongType()), T.StructField(DATE, T.DateType())])
        try:
            return self.spark.read.schema(T.StructType([*schema, *partitions])).parquet(self.path(table))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], T.StructType([*schema, *partitions]))

    def read_batch(self, table: str, batch_id: int) -> DataFrame:
        """What one micro-batch saved. Only its own folder is listed, however many batches came before."""
        schema, _, _ = TABLES[table]
        dated = T.StructType([*schema, T.StructField(DATE, T.DateType())])
        return self.spark.read.schema(dated).parquet(f"{self.path(table)}/{BATCH}={int(batch_id)}")

    def violations(self) -> DataFrame:
        return self.read("violations").drop(BATCH)

    def baselines(self) -> DataFrame:
        """The latest baseline of every (topic, rule)."""
        return latest_baselines(self.read("baselines"))

    def incident_states(self) -> DataFrame:
        return current_state(self.read("incident_events"))


def latest_per_key(rows: DataFrame, keys: list[str], newest: Column | str) -> DataFrame:
    """The newest row per key, by a map-side combined aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_r"))
    return latest.select(*keys, "_r.*")


def latest_baselines(snapshots: DataFrame) -> DataFrame:
    return latest_per_key(snapshots, ["topic", "rule_name"], "snapshot_at")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A store table kept in a database instead, by the session's JDBC driver."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
