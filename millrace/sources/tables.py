"""Tables in Parquet: write, append, replace, and read a part."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.clean import fill_missing, filter_in


SCHEMA_FOLDER = "_schema"  # Spark's readers pass over names that begin with an underscore
LOAD = "LOAD"
EMPTY = "\x01"
"""Stands for an empty text in the name of a partition folder, which otherwise reads back as NULL;
goes before a text that begins with it, too."""


def named(value: Column) -> Column:
    """A text as it is written into the name of a partition folder."""
    return F.when((value == "") | value.startswith(EMPTY), F.concat(F.lit(EMPTY), value)).otherwise(value)


def unnamed(value: Column) -> Column:
    """A text as read back from the name of a partition folder."""
    return F.when(value.startswith(EMPTY), F.substring(value, 2, 1 << 30)).otherwise(value)


def _texts(schema: T.StructType, columns: Iterable[str]) -> list[str]:
    """Those of the columns that are texts, by name in any letter case."""
    wanted = {c.lower() for c in columns}
    return [f.name for f in schema.fields if f.name.lower() in wanted and isinstance(f.dataType, T.StringType)]


def write_table(
    df: DataFrame,
    table: str,
    bucket_by: tuple[int, Sequence[str]] | None = None,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    path: str | None = None,
) -> None:
    """Save a catalog table spread by the hash of its key and partitioned by key columns.

    Loads join on the whole key, so a bucketed target is not shuffled again; rows are dealt to one
    task per bucket before the write, so each bucket is one file (per partition). The rebalance
    before a write that is only partitioned cuts large partitions into several tasks instead of
    sending each partition to one.
    """
    if bucket_by:
        df = df.repartition(bucket_by[0], *(F.col(f"`{k}`") for k in bucket_by[1]))
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        buckets, keys = bucket_by
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(table)


def append_archive(stage: DataFrame, archive: DataFrame) -> DataFrame:
    """The archive with all stage rows added: nothing is filtered, repeats stay."""
    return archive.unionByName(stage, allowMissingColumns=True)


def append_to(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a table at a path; what is there is not read."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def archive_to(df: DataFrame, path: str, load: str | None = None) -> None:
    """Add a load to a raw archive, as a folder of its own; nothing is filtered, repeats stay.

    Batches and arrivals come in this way alone. A load that fails and is repeated under the
    same name replaces what it had written, so it neither loses nor repeats a row.
    """
    df.write.mode("overwrite").parquet(f"{path}/{LOAD}={load or uuid.uuid4().hex}")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a raw archive."""
    return spark.read.parquet(path).drop(LOAD)


def save_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    text_columns: Iterable[str] | None = None,
    mode: str = "append",
) -> None:
    """Save rows with missing text written as empty text, and the schema beside them.

    An empty table adds no rows; with ``mode="overwrite"`` it leaves an empty table.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = texts if text_columns is None else list(text_columns)
    rows = df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in chosen})
    schema = rows.schema
    rows = rows.withColumns({c: named(F.col(f"`{c}`")) for c in _texts(schema, partition_by)})
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)
    about = json.dumps({"schema": schema.json(), "partition_by": list(partition_by)})
    df.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/{SCHEMA_FOLDER}"
    )


def _with_text_partitions(spark: SparkSession, path: str) -> DataFrame:
    """A table of which nothing is known but its files, with its partition columns as text.

    What types folder names would be read as is asked for once, and the schema given instead.
    """
    inferred = spark.read.parquet(path)
    files = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    own = {f.name for f in files.fields}
    fields = [f if f.name in own else T.StructField(f.name, T.StringType()) for f in inferred.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def load_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    filters: Sequence[tuple[str, Sequence]] = (),
) -> DataFrame:
    """Read some columns of rows whose values are in given lists; both reach the scan.

    A table written by :func:`save_parquet` has the types it was saved with. In others, partition
    columns are text: what a folder is called says nothing about its type.
    """
    try:
        about = json.loads(spark.read.text(f"{path}/{SCHEMA_FOLDER}").first()[0])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = _with_text_partitions(spark, path)
    else:
        schema = T.StructType.fromJson(json.loads(about["schema"]))
        df = spark.read.schema(schema).parquet(path).select(*(F.col(f"`{f.name}`") for f in schema.fields))
        df = df.withColumns({c: unnamed(F.col(f"`{c}`")) for c in _texts(schema, about["partition_by"])})
    df = filter_in(df, filters)
    return df if columns is None else df.select(*columns)


def read_spec(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", **options: str
) -> DataFrame:
    """A mapping, dictionary or key/value table with a declared schema; missing text becomes empty."""
    defaults = {"header": "true", "multiLine": "true"} if fmt == "csv" else {}
    return fill_missing(spark.read.format(fmt).options(**(defaults | options)).schema(schema).load(path))
