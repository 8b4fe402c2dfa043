"""Surrogates loaded into a published table, by several loads at once if need be."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.keys import append_surrogates
from millrace.plans.spec import SurrogateSpec
from millrace.sources.commits import Commit, CommitConflict, last_commit, reserve
from millrace.sources.publish import publish, read_model


def publish_surrogates(
    spark: SparkSession, root: str, table: str, tables: dict[str, DataFrame], spec: SurrogateSpec,
    batch_log: DataFrame, as_of: dt.datetime | str | None = None, distinct: bool = False, attempts: int = 5,
) -> Commit:
    """Number the new natural keys of a stage and add them to a published surrogate table.

    The ids a load needs are reserved in the table's commit log before they are given out: above the
    highest of the table and above all reserved before. So loads at the same time give different ids, each
    an unbroken range, natural key descending. A load that finds, when it commits, that another
    has added surrogates since it looked for new keys looks again, as some may be known by now;
    the range it had reserved stays unused.
    """
    for attempt in range(attempts):
        base = last_commit(spark, root, table)
        known = read_model(spark, root, table, base)

        def above(highest: int, count: int) -> int:
            return reserve(spark, root, table, count, highest) if count else highest

        result = append_surrogates(tables, known, spec, batch_log, as_of, distinct, above)
        try:
            return publish(spark, root, table, result, base=base)
        except CommitConflict:
            if attempt == attempts - 1:
                raise
    raise ValueError("a load needs at least one attempt")
