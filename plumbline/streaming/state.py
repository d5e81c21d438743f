"""Settings a stateful query starts with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTINGS = {
    # State on disk; what a query with its own state operators needs.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Sessions are merged per task before the shuffle: a hot key sends one row per session it saw, not one per violation.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def state_settings(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """Start stateful queries inside: a query keeps the settings it was started with, the session gets its own back.

    `parts` is the number of state partitions; a checkpoint keeps the number it was begun with.
    """
    wanted = {**_SETTINGS, **({"spark.sql.shuffle.partitions": str(parts)} if parts else {})}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
