"""The first rows of groups that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts a group is first cut down in. One part suffices for any but the largest inputs.
SALTS = 64


def first_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], limit: int, *,
    rank: str | None = None, spread: Sequence[str] | None = None,
) -> DataFrame:
    """The first `limit` rows of each group in `order`, numbered from 1 in `rank` if named.

    Spark limits each group per input task ahead of the shuffle. What is left
    still grows with the number of tasks, so groups are cut down in salted parts
    first and the parts' winners meet after that. Rows go to parts by a hash of
    `spread`, by default the order columns.
    """
    place = rank or "_place"
    in_part = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    in_group = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*(spread or order)), F.lit(SALTS)))
    parts = salted.withColumn(place, in_part).where(F.col(place) <= limit).drop(place, "_salt")
    firsts = parts.withColumn(place, in_group).where(F.col(place) <= limit)
    return firsts if rank else firsts.drop(place)
