"""Window operators: keep rows by a window result, first rows of a key, neighbours of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.neighbours import HOT, HOT_ROWS, SEGMENT, long_keys, neighbours, with_segments

_KEPT = "__kept"


def qualify(df: DataFrame, condition: str) -> DataFrame:
    """Keep the rows for which a SQL condition over window functions holds."""
    return df.withColumn(_KEPT, F.expr(condition)).filter(_KEPT).drop(_KEPT)


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark cuts each input partition to ``n`` rows per key
    before shuffling, so a key holding most rows is no burden."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_KEPT, F.row_number().over(window)).filter(F.col(_KEPT) <= n).drop(_KEPT)


def _segmented(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int) -> DataFrame:
    return with_segments(df, long_keys(df, keys, order, hot_rows), keys, order)


def previous(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str,
    prefix: str = "PRE_", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the columns of the previous row of the key; ``order`` is unique within a key."""
    segmented = _segmented(df, keys, order, hot_rows)
    return neighbours(segmented, keys, order, columns, "previous", prefix).drop(SEGMENT, HOT)


def next_start(
    df: DataFrame, keys: Sequence[str], start: str, out: str, high: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``out``: the start of the next row of the key, or the high date after the last."""
    segmented = _segmented(df, keys, start, hot_rows)
    found = neighbours(segmented, keys, start, [start], "next", "__next_")
    return found.withColumn(out, F.coalesce(F.col(f"`__next_{start}`"), high)).drop(f"__next_{start}", SEGMENT, HOT)
