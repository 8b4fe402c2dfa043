"""Data mart loads from stage: merge on keys, or insert of new rows when all columns are key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import key_equal
from millrace.functions.types import ColumnType, load_time
from millrace.operators.apply import DEST, MASKED, MODEL, ApplyResult
from millrace.operators.checks import check_not_null, check_unique
from millrace.plans.bloom import prefiltered
from millrace.plans.matching import (
    LoadFacts, Pairs, changes_of, examine, met, need_unique, null_key, paired, rows_of_interest, size_of,
)
from millrace.sources.dictionary import (
    FILE_NAME, MART_INSERTED, MART_UPDATED, STAGE_BATCH, SourceTable,
)

Types = dict[str, ColumnType]


def _inserted(column: str, stage_value: Column, now: Column) -> Column:
    """A mart row made from a stage row; the file name stays behind in stage."""
    name = column.lower()
    if name == FILE_NAME:
        return F.lit(None).cast("string")
    if name == MART_INSERTED:
        return now
    if name == MART_UPDATED:
        return F.lit(None).cast("timestamp_ntz")
    return stage_value


def _need_keys(keys: Sequence[str]) -> None:
    if not keys:
        raise ValueError("a mart load needs key columns to match on")


def merge_mart(
    stage: DataFrame, mart: DataFrame, keys: Sequence[str], as_of: dt.datetime | str | None = None,
    types: Types | None = None, case_blind: bool = False, check_keys: bool = True, small_load: bool | None = None,
) -> DataFrame:
    """The mart after a merge: matched rows take new values, update and dump time; others are added.

    Batch and insert time of a matched row stay. A NULL key matches nothing, so such a row is
    added by every run.
    """
    facts = _measured(stage, keys, types, case_blind, check_keys, small_load)
    pairs = paired(mart, stage, list(keys), facts.small, types, case_blind)
    value = _merged(stage, mart, keys, as_of, pairs)
    return pairs.rows.select(*(value(c).alias(c) for c in mart.columns))


def _measured(
    stage: DataFrame, keys: Sequence[str], types: Types | None, case_blind: bool, check_keys: bool,
    small_load: bool | None,
) -> LoadFacts:
    _need_keys(keys)
    if not check_keys and small_load is not None:
        return LoadFacts(is_small=small_load)
    facts = examine(stage, keys, types, case_blind) if check_keys else size_of(stage)
    need_unique(facts, "stage")
    return replace(facts, is_small=small_load)


def _merged(
    stage: DataFrame, mart: DataFrame, keys: Sequence[str], as_of: dt.datetime | str | None, pairs: Pairs
) -> Callable[[str], Column]:
    """What a merge writes into a column of the mart."""
    now = load_time(as_of, "TIMESTAMP(0)")
    incoming = {c.lower(): c for c in stage.columns}
    key_names = {k.lower() for k in keys}
    stays = {STAGE_BATCH, FILE_NAME, MART_INSERTED} | key_names

    def value(c: str) -> Column:
        name = c.lower()
        new = pairs.new(incoming[name]) if name in incoming else F.lit(None)
        if name == MART_UPDATED:
            matched = now
        elif name in stays or name not in incoming:
            matched = pairs.old(c)
        else:
            matched = new
        return (
            F.when(~pairs.has_old, _inserted(c, new, now))
            .when(pairs.has_new, matched)
            .otherwise(pairs.old(c))
            .cast(mart.schema[c].dataType)
        )

    return value


def mart_changes(
    stage: DataFrame, mart: DataFrame, keys: Sequence[str], as_of: dt.datetime | str | None = None,
    types: Types | None = None, case_blind: bool = False, check_keys: bool = True, small_load: bool | None = None,
    facts: LoadFacts | None = None,
) -> DataFrame:
    """Only the rows a merge writes, tagged DEST: matched rows as they were, to be masked, and all rows of the stage."""
    facts = facts or _measured(stage, keys, types, case_blind, check_keys, small_load)
    pairs = met(mart, stage, list(keys), facts, types, case_blind)
    value = _merged(stage, mart, keys, as_of, pairs)
    return changes_of(pairs, [
        (pairs.has_old, {c: pairs.old(c) for c in mart.columns} | {DEST: F.lit(MASKED)}),
        (pairs.has_new, {c: value(c) for c in mart.columns} | {DEST: F.lit(MODEL)}),
    ], T.StructType([*mart.schema.fields, T.StructField(DEST, T.StringType())]))


def new_mart_rows(
    stage: DataFrame, mart: DataFrame, keys: Sequence[str], as_of: dt.datetime | str | None = None,
    types: Types | None = None, case_blind: bool = False, small_load: bool | None = None, prefilter: bool = False,
) -> DataFrame:
    """Stage rows without a mart row of the same key, as mart rows to append.

    ``prefilter`` keeps mart rows that no key of a large stage can meet out of the shuffle, by a Bloom filter.
    """
    _need_keys(keys)
    small = size_of(stage).small if small_load is None else small_load
    now = load_time(as_of, "TIMESTAMP(0)")
    mart_rows = prefiltered(mart.select(*(F.col(f"`{k}`") for k in keys)), stage, list(keys)) if prefilter and not small else mart
    known = rows_of_interest(mart_rows, stage, keys, (), small, types, case_blind)
    new = (
        stage.filter(~null_key(keys)).alias("new")
        .join(known.alias("old"), key_equal("new", "old", keys, types, case_blind), "left_anti")
        .union(stage.filter(null_key(keys)))
    )
    incoming = {c.lower(): c for c in stage.columns}
    return new.select(
        *(
            _inserted(c, F.col(f"`{incoming[c.lower()]}`") if c.lower() in incoming else F.lit(None), now)
            .cast(mart.schema[c].dataType)
            .alias(c)
            for c in mart.columns
        )
    )


def insert_new_mart(
    stage: DataFrame, mart: DataFrame, keys: Sequence[str], as_of: dt.datetime | str | None = None, **options
) -> DataFrame:
    """The mart after adding stage rows with new keys; existing rows are not touched."""
    return mart.unionByName(new_mart_rows(stage, mart, keys, as_of, **options))


def apply_mart(
    stage: DataFrame, mart: DataFrame, table: SourceTable, as_of: dt.datetime | str | None = None,
    check: bool = False, **options,
) -> ApplyResult:
    """Merge, or insert of new rows when the table consists of key columns only, ready to publish.

    New rows are appended; a merge replaces the mart rows it was given, which for a published mart
    with a layout are those of the folders the stage reaches. Keys compare as the dictionary
    declares them. With ``check``, required values and, for inserts, unique keys are checked first.
    """
    nothing = mart.filter(F.lit(False))
    options = {"types": table.types} | options
    if check:
        check_not_null(stage, table)
    if len(table.keys) == len(table.columns):
        if check:
            check_unique(stage, table.keys)
        new = new_mart_rows(stage, mart, table.keys, as_of, **options)
        return ApplyResult(mart.unionByName(new), nothing, stage, new.withColumn(DEST, F.lit(MODEL)), appends=True)
    facts = _measured(
        stage, table.keys, options["types"], options.get("case_blind", False), options.pop("check_keys", True),
        options.pop("small_load", None),
    )
    options |= {"check_keys": False, "small_load": facts.small}
    merged = merge_mart(stage, mart, table.keys, as_of, **options)
    return ApplyResult(
        target=merged, duplicates=nothing, flagged=stage, outcome=merged.withColumn(DEST, F.lit(MODEL)), appends=False,
        changes=mart_changes(stage, mart, table.keys, as_of, facts=facts, **options),
    )


def load_mart(
    stage: DataFrame, mart: DataFrame, table: SourceTable, as_of: dt.datetime | str | None = None, **options
) -> DataFrame:
    """The mart after a merge, or after an insert of new rows when it consists of key columns only."""
    return apply_mart(stage, mart, table, as_of, **options).target
