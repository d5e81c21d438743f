"""Verdicts of outside judges: payloads to send, a scorer to run, responses to read.

The judge itself is the caller's: any function from a batch of payloads to a
batch of response texts. Everything around it is a plain DataFrame job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import ellipsize, let

# What a response without the field means.
DEFAULT_CONFIDENCE = 0.5
UNAVAILABLE = "Judge unavailable: "

# Bytes of payloads a scorer is handed at once: records may be whole texts.
PAYLOAD_BYTES = 4 << 20


def payload(
    criterion: str, record: Mapping[str, Column], context: str = "", *, longest_value: int | None = None
) -> Column:
    """JSON with the criterion, the record and the context; values are whole unless `longest_value` cuts them."""

    def shown_value(value: Column) -> Column:
        whole = F.coalesce(value.cast("string"), F.lit(""))
        return whole if longest_value is None else ellipsize(whole, longest_value)

    shown = F.struct(*[shown_value(value).alias(label) for label, value in record.items()])
    parts = [F.lit(criterion).alias("criterion"), shown.alias("record")]
    if context:
        parts.append(F.lit(context).alias("context"))
    return F.to_json(F.struct(*parts))


def apply_scorer(payloads: DataFrame, scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """`payloads` with a `response` column. A scorer gets up to `PAYLOAD_BYTES` of payloads at a time, or one that is longer."""
    limit = PAYLOAD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("payload")), 0).to_numpy(zero_copy_only=False)
            low = 0
            while low < len(sizes):
                fits = int(np.searchsorted(np.cumsum(sizes[low:], dtype=np.int64), limit, side="right"))
                part = batch.slice(low, max(fits, 1))
                response = pa.array(scorer(part.column("payload").to_pandas().rename("payload")), pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*part.columns, response], names=[*part.schema.names, "response"])
                low += part.num_rows

    schema = T.StructType([*payloads.schema, T.StructField("response", T.StringType())])
    return payloads.mapInArrow(run, schema)


def without_fence(text: Column) -> Column:
    """The inside of a ``` block where the text is one, else the text; trimmed."""
    fenced = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*[ \t]*\n?(.*?)\s*```\s*$", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(text))


def parse_verdict(response: Column) -> Column:
    """Struct of passed, confidence, reason, evidence and judge_error.

    A response that cannot be read passes with confidence 0, as a missing judge
    must not raise alarms; `judge_error` keeps such rows countable. `passed`
    has to be a JSON boolean.
    """
    body = without_fence(response)
    # Parsed once per row; text that starts with a brace can only parse to an object.
    parsed = F.when(body.startswith("{"), F.try_parse_json(body))
    return let(F.struct(response.alias("response"), parsed.alias("parsed")), _read_verdict)


def _read_verdict(given: Column) -> Column:
    parsed = given["parsed"]

    def part(name: str, kind: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", kind)

    passed = F.to_json(part("passed", "variant"))
    confidence = part("confidence", "double")
    unreadable = (
        F.when(given["response"].isNull(), F.lit("no response"))
        .when(parsed.isNull(), F.lit("response is not a JSON object"))
        .when(~F.coalesce(passed, F.lit("")).isin("true", "false"), F.lit("passed is not a boolean"))
        .when(
            confidence.isNull() & part("confidence", "variant").isNotNull(),
            F.lit("confidence is not a number"),
        )
    )
    failed = unreadable.isNotNull()
    evidence = F.coalesce(F.to_json(part("evidence", "variant")), F.lit("{}"))
    return F.struct(
        (failed | (passed == "true")).alias("passed"),
        F.when(failed, F.lit(0.0))
        .otherwise(F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)))
        .alias("confidence"),
        F.coalesce(F.concat(F.lit(UNAVAILABLE), unreadable), part("reason", "string"), F.lit(""))
        .alias("reason"),
        F.when(failed, F.lit("{}")).otherwise(evidence).alias("evidence"),
        failed.alias("judge_error"),
    )


# The fence a query comes in, and the word before its explanation.
FENCE = "```"
EXPLANATION = "explanation:"


def parse_fix(response: Column) -> Column:
    """Struct of the SQL in a response and the explanation given with it.

    Fences cut a response into text and blocks by turns. The SQL is the first block
    marked as sql, else the lines of the text that a query can begin with, else
    everything. The explanation is what follows its mark on the same line.
    """
    # A null response stays null in both fields.
    return let(F.struct(response.alias("whole"), F.split(response, FENCE, -1).alias("parts")), _read_fix)


def _read_fix(given: Column) -> Column:
    whole, parts = given["whole"], given["parts"]
    # Every second part is inside a fence, if the fence is closed again.
    blocks = F.filter(parts, lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1) & F.lower(p).rlike(r"^sql\s*\n"))
    inside = F.regexp_replace(F.get(blocks, F.lit(0)), r"^[^\n]*\n", "")
    begins = F.filter(F.split(whole, "\n"), _begins_a_query)
    sql = F.coalesce(_stripped(inside), F.when(F.size(begins) > 0, F.array_join(begins, "\n")), whole)
    told = F.filter(F.split(whole, "\n"), lambda line: F.lower(line).contains(EXPLANATION))
    first = F.get(told, F.lit(0))
    after = F.substr(first, F.locate(EXPLANATION, F.lower(first)) + F.lit(len(EXPLANATION)))
    explanation = F.substring_index(after, FENCE, 1)
    return F.struct(sql.alias("sql"), F.when(whole.isNotNull(), F.coalesce(_stripped(explanation), F.lit(""))).alias("explanation"))


def _begins_a_query(line: Column) -> Column:
    word = F.upper(F.regexp_extract(line, r"^\s*([A-Za-z]+)", 1))
    return word.isin("SELECT", "WITH", "CREATE", "INSERT")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
