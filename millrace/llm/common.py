"""What several operators share: words, lines, temporary names and stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.numbering import shared_folder

SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for NULL."""
    return F.array_remove(F.split(whole(text), r"[\x20\x09-\x0D]+", -1), "")


def lines(text: Column) -> Column:
    """What stands between line feeds; one empty line for NULL."""
    return F.split(whole(text), "\n", -1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; plain ``lower`` does it wherever a text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def row_key(*columns: Column) -> list[Column]:
    """128 bits that stand for a row's values, as two longs that are never NULL.

    Each value goes in with a mark of whether it is NULL, so (NULL, 'a') is not ('a', NULL).
    """
    marked = [part for c in columns for part in (c.isNull(), c)]
    return [F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)]


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """Names like the given ones that no column has."""
    taken = {t.lower() for t in taken}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def with_results(df: DataFrame, results: dict[str, Column]) -> DataFrame:
    """The table with the results; columns of the same name, in any letter case, give way."""
    new = {name.lower() for name in results}
    kept = [col(c) for c in df.columns if c.lower() not in new]
    return df.select(*kept, *(column.alias(name) for name, column in results.items()))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder where all executors reach it."""
    return f"{shared_folder(spark)}/millrace/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows, written once to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    folder = folder or fresh_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder given as a path or URI."""
    if "://" in folder or folder.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder


def discard(folder: str) -> None:
    """Delete a stored table that nothing reads any more, where pyarrow can reach it; else it stays."""
    try:
        store, path = open_folder(folder)
        store.delete_dir(path)
    except (OSError, pyarrow.ArrowException):  # a store that only Spark can open
        pass
