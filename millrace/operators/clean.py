"""Cleaning of text and numbers, lists of wanted values, reserved words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as blank at the ends of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _columns_of(df: DataFrame, *types: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def trim_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Cut blanks, tabs, line ends and other white space from both ends of every text column."""
    chosen = _columns_of(df, T.StringType) if columns is None else columns
    return df.withColumns({c: F.btrim(F.col(f"`{c}`"), F.lit(BLANKS)) for c in chosen})


def fill_missing(df: DataFrame, value: str | int | float = "") -> DataFrame:
    """Replace missing values: NULL text by a text, NULL and NaN numbers by a number.

    A text leaves numbers missing, but as NULL: a NaN is a missing value too.
    """
    floats = _columns_of(df, T.FloatType, T.DoubleType)
    df = df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats})
    return df.fillna(value)


def truncate_floats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Cut the fraction of floating point columns; missing values stay missing."""
    chosen = _columns_of(df, T.FloatType, T.DoubleType) if columns is None else columns
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)).cast("long") for c in chosen})


def filter_in(df: DataFrame, filters: Sequence[tuple[str, Sequence | DataFrame]]) -> DataFrame:
    """Rows whose columns are in the given lists, all of them; a list may be a table of one column.

    Lists are pushed into the scan, a table becomes a semi join.
    """
    for column, values in filters:
        if isinstance(values, DataFrame):
            wanted = values.toDF("__wanted")
            df = df.join(wanted, F.col(f"`{column}`") == F.col("__wanted"), "left_semi")
        else:
            df = df.filter(F.col(f"`{column}`").isin(list(values)))
    return df


def rename_reserved(df: DataFrame, words: DataFrame, source: str, columns: Iterable[str]) -> DataFrame:
    """Append ``_`` to values that are reserved words of a source.

    ``words`` has the columns ``Reserved words source`` and ``Reserved words``. It is metadata, a
    list of words per source, and read like the other spec tables; the values are compared in place.
    """
    wanted = words.filter(F.col("Reserved words source") == source).select("Reserved words").distinct()
    reserved = [row[0] for row in wanted.collect() if row[0] is not None]

    def renamed(c: str) -> Column:
        value = F.col(f"`{c}`")
        return F.when(value.isin(reserved), F.concat(value, F.lit("_"))).otherwise(value) if reserved else value

    return df.withColumns({c: renamed(c) for c in columns})
