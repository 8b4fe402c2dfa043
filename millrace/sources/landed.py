"""Landed files: read them by name, and stage them with declared types."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.types import cast_to, load_time
from millrace.sources.dictionary import DUMPED_AT, FILE_NAME, STAGE_BATCH, SourceColumn, SourceTable

_SPECIAL = r"[\\*?\[\]{},^]"  # fixed value: what has a meaning of its own in a file name pattern


def landed_pattern(contains: str) -> str:
    """A file name pattern for names that contain a text, whatever characters it has."""
    return f"*{re.sub(_SPECIAL, lambda c: chr(92) + c[0], contains)}*" if contains else "*"


def read_landed(
    spark: SparkSession,
    path: str,
    fmt: str,
    contains: str = "",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Files below ``path`` whose name contains a text, with the name of each row's file.

    Text formats need a schema: types are declared, never guessed.
    """
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"{fmt} files need a schema")
    reader = spark.read.format(fmt).option("pathGlobFilter", landed_pattern(contains)).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path).withColumn(FILE_NAME, F.col("_metadata.file_name"))


def text_schema(table: SourceTable) -> T.StructType:
    """All columns as text, for landed files that are typed only when staged."""
    return T.StructType([T.StructField(c.name, T.StringType()) for c in table.columns])


def stage(
    df: DataFrame, table: SourceTable, batch: int, as_of: dt.datetime | str | None = None, check: bool = False
) -> DataFrame:
    """Stage rows: declared columns at their types and names, then batch, file and dump time.

    With ``check`` a row without a required value fails the query that reads it, so nothing
    is read twice.
    """
    filename = F.col(FILE_NAME) if FILE_NAME in df.columns else F.lit(None)
    def value(column: SourceColumn) -> Column:
        found = cast_to(F.col(f"`{column.name}`"), column.ctype)
        if not check or column.name not in table.required:
            return found
        message = F.lit(f"{table.schema}.{table.name} has missing values in {column.name}")
        return F.when(found.isNull(), F.raise_error(message).cast(column.ctype.spark)).otherwise(found)

    return df.select(
        *(value(c).alias(c.name) for c in table.columns),
        F.lit(batch).cast("int").alias(STAGE_BATCH),
        filename.cast("string").alias(FILE_NAME),
        load_time(as_of, "TIMESTAMP(0)").alias(DUMPED_AT),
    )
