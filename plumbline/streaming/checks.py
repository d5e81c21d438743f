"""Rule sets over streams.

Per-record rules are the batch expressions on a streaming frame. Rules that look
back keep their state in Spark's state store (`lookback`). Both are branches of one
query, so a batch that runs again after a failure starts from the state its
predecessor left and replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import rowchecks
from plumbline.rules import RuleSet
from plumbline.schemas import VIOLATION
from plumbline.sources.store import Store
from plumbline.streaming import lookback
from plumbline.streaming.state import state_settings


def stream_violations(stream: DataFrame, rules: RuleSet, **options) -> DataFrame:
    """Per-record violations of a stream; stateless, so append mode and no watermark."""
    return rowchecks.violations(stream, rules, **options)


def run_checks(
    stream: DataFrame,
    rules: RuleSet,
    store: Store,
    checkpoint: str,
    *,
    order: Sequence[str] = (),
    keys: Sequence[str] = (),
    time_column: str | None = None,
    id_columns: Sequence[str] = rowchecks.ID_COLUMNS,
    messages: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    ttl_seconds: float | None = None,
    state_parts: int | None = None,
) -> StreamingQuery:
    """Start the whole job of one rule set: check, store, publish, snapshot baselines.

    Violations replace those of an earlier try of the same batch. A failing
    sink fails the batch, which Spark then runs again. `messages` receives
    (key, value) rows with one JSON array per offending record.
    """
    options = {"time_column": time_column, "id_columns": id_columns}
    found = rowchecks.violations(stream, rules, **options)
    looks_back = bool(rules.of("null_rate", "statistical"))
    if looks_back:
        results = lookback.look_back_results(stream, rules, order=order, keys=keys, ttl_seconds=ttl_seconds, **options)
        if rules.per_record:
            found = found.unionByName(results, allowMissingColumns=True)
        else:
            found = results.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in VIOLATION])

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            whole = batch
            if looks_back:
                parts = [batch.where("rule IS NULL"), *lookback.violations_of_results(batch.where("rule IS NOT NULL"), rules)]
                whole = reduce(DataFrame.unionByName, [p.select(*[f"`{f.name}`" for f in VIOLATION]) for p in parts])
            store.save_violations(whole, batch_id=batch_id)
            if rules.statistical and not keys:
                store.save_baselines(lookback.snapshots_of_results(batch, rules), batch_id=batch_id)
            if messages is not None:
                messages(as_messages(store.read_batch("violations", batch_id)), batch_id)
        finally:
            batch.unpersist()

    with state_settings(stream.sparkSession, state_parts):
        return (
            found.writeStream.foreachBatch(handle)
            .option("checkpointLocation", f"{checkpoint.rstrip('/')}/query")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def as_messages(found: DataFrame) -> DataFrame:
    """One JSON array of violations per record; a record breaks each rule at most once.

    Violations of records without an id cannot be told apart by record and go
    out one by one, so no group outgrows the rule set.
    """
    fields = F.struct(*[F.col(f"`{f.name}`") for f in VIOLATION])
    nameless = F.when(F.col("record_id") == "", F.monotonically_increasing_id())
    listed = F.array_sort(F.collect_list(F.struct("rule_name", fields.alias("v"))))
    grouped = found.withColumn("_nameless", nameless).groupBy("topic", "record_id", "timestamp", "_nameless")
    return grouped.agg(F.to_json(F.transform(listed, lambda s: s["v"])).alias("value")).select(
        F.col("record_id").alias("key"), "value"
    )
