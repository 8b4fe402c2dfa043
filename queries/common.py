"""Inputs shared by the queries: the given tables and loads derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.numbering import shared_folder

AS_OF = "2024-06-01 00:00:00"
KNOWN_UNTIL = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for the tables a query writes, where all executors reach it."""
    return f"{shared_folder(spark)}/millrace/{uuid.uuid4().hex}"


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def day(text: str):
    return F.lit(text).cast("date")
