"""Checks on staged and mart tables: required values and unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.dictionary import SourceTable


class CheckError(ValueError):
    """A table breaks a declared rule."""


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of missing values; one pass, no shuffle of rows."""
    counts = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)))
    pairs = (F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("missing")) for i, c in enumerate(columns))
    return counts.select(F.inline(F.array(*pairs)))


def check_not_null(df: DataFrame, table: SourceTable) -> None:
    """Raise when a key or non-nullable column of the dictionary misses a value."""
    if table.required:
        broken = null_counts(df, table.required).filter("missing > 0").collect()
        if broken:
            found = ", ".join(f"{r['column_name']}: {r['missing']}" for r in broken)
            raise CheckError(f"{table.schema}.{table.name} has missing values in {found}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; counted before the shuffle."""
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key occurs more than once."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise CheckError(f"key {list(keys)} is not unique, for example {found[0].asDict()}")
