"""Session settings and the shared folder that cut lineage is written to."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

_shipped: set[tuple[str, str]] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leave everything else to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark, PACKAGE)
    return spark


def ship_package(spark: SparkSession, package: Path) -> None:
    """Send a package to the Python workers, once per application.

    The archive is made next to the driver only; Spark hands it to the executors.
    """
    application = spark.sparkContext.applicationId
    if (application, package.name) in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-package-")) / package.name
    shutil.make_archive(str(archive), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(f"{archive}.zip")
    _shipped.add((application, package.name))


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: `spark.checkpoint.dir`, else the session's checkpoint folder, else one in the
    warehouse, which executors share by its nature."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/plumbline-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: same rows, same partitions, same order on every later read."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
