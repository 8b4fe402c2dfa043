"""Numbering all rows of a table in one order, without passing them through one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
COPIES_AT_ONCE = 100_000
_PART_BITS = 33  # monotonically_increasing_id: partition above, row within the partition below


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    own = tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def session_folder(spark: SparkSession) -> str:
    """Where a session keeps what it cuts off from its lineage; see :func:`forget_frozen`."""
    return f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"


def frozen(df: DataFrame) -> DataFrame:
    """The same rows cut off from their lineage: written once as Parquet to the shared folder and read from
    there, with all that Spark knows to do with such files.

    A lazy result may read the copy at any time, so it stays until the session is done with its results
    and calls :func:`forget_frozen`.
    """
    folder = f"{session_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget_frozen(spark: SparkSession) -> None:
    """Delete all copies of this session; results made from them can't be read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _copies(df: DataFrame, count: str, longest: int, at_once: int = COPIES_AT_ONCE) -> DataFrame:
    """Repeat each row ``count`` times, with the repeat number; long runs are spread over tasks."""
    n = F.col(count)
    if longest <= 1:
        return df.withColumn("__copy", F.lit(0).cast("long"))
    short = df.filter(n <= at_once).withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    if longest <= at_once:
        return short
    pieces = df.filter(n > at_once).withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(at_once).cast("long")))
    )
    spread = pieces.repartition(F.col("__from"), F.xxhash64(*df.columns))
    last = F.least(F.col("__from") + at_once, n) - 1
    long = spread.withColumn("__copy", F.explode(F.sequence(F.col("__from"), last))).drop("__from")
    return short.unionByName(long)


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    out: str,
    above: Column | int | Callable[[int], int] = 0,
    counted: str | None = None,
    at_once: int = COPIES_AT_ONCE,
) -> DataFrame:
    """Add ``out``: consecutive numbers above ``above`` in the given order.

    ``above`` may also be a function, which is told how many rows there are.

    Equal rows are counted before anything is sorted (or come with their count in the column
    ``counted``), so a value that fills a third of the table is one row here. Distinct rows
    are range-partitioned in order, ties by all columns, and frozen so that the ranges cannot
    change. They are numbered within their range above the total of the ranges before it;
    those totals, one row per range and so at most one per shuffle partition, are all that
    comes to the driver. Adaptive execution joins neighbouring small ranges.
    """
    spark = df.sparkSession
    if counted is None:
        counted = "__n"
        df = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias(counted))
    columns = [c for c in df.columns if c != counted]
    ordering = [*order, *(F.col(f"`{c}`").asc() for c in columns)]
    ranges = frozen(
        df.repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .withColumn("__at", F.monotonically_increasing_id())
    ).withColumns({"__part": F.shiftright("__at", _PART_BITS), "__row": F.col("__at").bitwiseAND((1 << _PART_BITS) - 1)})
    totals = (
        ranges.groupBy("__part").agg(F.sum(counted).alias("rows"), F.max(counted).alias("longest")).orderBy("__part")
    ).collect()
    offsets, total = [], 0
    for part in totals:
        offsets.append((part["__part"], total))
        total += part["rows"]
    longest = max((part["longest"] for part in totals), default=0)

    offset = F.broadcast(spark.createDataFrame(offsets, "__part long, __offset long"))
    if longest <= 1:
        before = F.col("__row")
    else:
        within = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
        before = F.sum(counted).over(within) - F.col(counted)
    placed = ranges.join(offset, "__part").withColumn("__first", F.col("__offset") + before + 1)
    above = above if isinstance(above, (int, Column)) else above(total)
    above = F.lit(above) if isinstance(above, int) else above
    number = above + F.col("__first") + F.col("__copy")
    placed = placed.drop("__at", "__part", "__row", "__offset")
    return _copies(placed, counted, longest, at_once).select(
        number.cast("long").alias(out), *(F.col(f"`{c}`") for c in columns)
    )
