"""Landed files taken up as they arrive: each file goes into the archive, or a model, exactly once."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.apply import ApplyResult
from millrace.sources.dictionary import FILE_NAME, SourceTable
from millrace.sources.landed import landed_pattern, stage
from millrace.sources.publish import publish_load
from millrace.sources.tables import archive_to


def arrivals(
    spark: SparkSession, path: str, fmt: str, contains: str, schema: T.StructType | str, **options: str
) -> DataFrame:
    """A stream of the files below ``path`` whose name contains a text."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", landed_pattern(contains))
    return reader.options(**options).load(path).withColumn(FILE_NAME, F.col("_metadata.file_name"))


def archive_arrivals(
    stream: DataFrame,
    table: SourceTable,
    archive: str,
    progress: str,
    batch: int,
    as_of: dt.datetime | str | None = None,
) -> None:
    """Stage all files that arrived since the last run and append them to the archive.

    ``progress`` is a shared folder that remembers which files were taken. Each run's rows are a
    load of the archive named after it, so a run that fails and is repeated neither loses nor
    repeats a row, and loads of other origin stand beside them.
    """
    source = hashlib.sha256(progress.encode()).hexdigest()[:16]

    def take(rows: DataFrame, epoch: int) -> None:
        archive_to(stage(rows, table, batch, as_of), archive, f"{source}-{epoch}")

    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()
    run.awaitTermination()


def publish_arrivals(
    stream: DataFrame,
    root: str,
    table: str,
    progress: str,
    prepare: Callable[[DataFrame], DataFrame],
    apply: Callable[[DataFrame, DataFrame], ApplyResult],
) -> None:
    """Load all files that arrived since the last run into a published table, batch by batch.

    ``prepare`` makes load rows of a batch's rows, ``apply`` the result of load and model. The commit of a
    batch names the stream and the batch's number, so a batch that is repeated, because a run failed
    between the commit and its note in ``progress``, is recognised and left out.
    """
    source = hashlib.sha256(progress.encode()).hexdigest()[:16]

    def take(rows: DataFrame, epoch: int) -> None:
        load = prepare(rows)
        publish_load(rows.sparkSession, root, table, load, lambda model: apply(load, model), epoch=(source, epoch))

    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()
    run.awaitTermination()
