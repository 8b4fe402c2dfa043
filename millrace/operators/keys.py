"""Surrogate keys: find natural keys without one, number them, and look them up."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import folded
from millrace.functions.types import cast_to, load_time, parse_type
from millrace.operators.apply import DEST, MODEL, ApplyResult
from millrace.operators.transform import TEXT, batch_id, joined
from millrace.plans.bloom import prefiltered
from millrace.plans.numbering import number_rows
from millrace.plans.spec import (
    BATCH_ID, INSERTED_AT, RECORD_ID, SURROGATE_SET, UPDATED_AT, SurrogateSpec,
)

Above = Callable[[int, int], int]


def max_key(sgk: DataFrame, key: str) -> Column:
    """The highest surrogate of the whole table, whatever its SGK_ID; 0 when there is none."""
    return sgk.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()


def _without_surrogate(values: DataFrame, sgk: DataFrame, spec: SurrogateSpec, prefilter: bool = False) -> DataFrame:
    """Rows whose natural key has no surrogate in this SGK_ID; NULLs never have one and skip the join."""
    ctype, name = parse_type(spec.natural_type), spec.natural_key
    known = sgk.filter((F.col(SURROGATE_SET) == spec.sgk_id) & F.col(f"`{name}`").isNotNull()).select(
        F.col(f"`{name}`").alias("known")
    )
    if prefilter:
        known = prefiltered(known, values.select(cast_to(F.col(f"`{name}`"), ctype).alias("known")), ["known"])
    same = folded(cast_to(F.col(f"s.`{name}`"), ctype), ctype, spec.case_blind) == folded(
        F.col("k.known"), ctype, spec.case_blind
    )
    is_null = F.col(f"`{name}`").isNull()
    fresh = values.filter(~is_null).alias("s").join(known.alias("k"), same, "left_anti")
    return fresh.union(values.filter(is_null))


def _natural_keys(stage: DataFrame, spec: SurrogateSpec) -> DataFrame:
    column = spec.source_column if "." in spec.source_column else f"`{spec.source_column}`"
    return stage.select(F.col(column).alias(spec.natural_key))


def _distinct_keys(values: DataFrame, spec: SurrogateSpec) -> DataFrame:
    """One row per natural key as the surrogate table tells keys apart: cast to its type, and without
    regard to case if it compares so; of spellings the least stays."""
    ctype, name = parse_type(spec.natural_type), spec.natural_key
    typed = values.select(cast_to(F.col(f"`{name}`"), ctype).alias(name))
    same = folded(F.col(f"`{name}`"), ctype, spec.case_blind).alias("__same")
    return typed.groupBy(same).agg(F.min(f"`{name}`").alias(name)).select(name)


def new_keys(
    stage: DataFrame, sgk: DataFrame, spec: SurrogateSpec, distinct: bool = False, prefilter: bool = False
) -> DataFrame:
    """Natural keys in stage without a surrogate in this SGK_ID; repeats stay unless ``distinct``.

    ``prefilter`` is for a surrogate table much larger than the stage, of which the stage meets few rows: a Bloom
    filter of the stage's keys then keeps all others where they are.
    """
    values = _natural_keys(stage, spec)
    return _without_surrogate(_distinct_keys(values, spec) if distinct else values, sgk, spec, prefilter)


def _assigned(
    fresh: DataFrame, sgk: DataFrame, spec: SurrogateSpec, counted: str | None, above: Above | None = None
) -> DataFrame:
    natural = F.col(f"`{spec.natural_key}`")
    highest = sgk.agg(F.coalesce(F.max(spec.key), F.lit(0)).cast("long")).first()[0]
    begin = highest if above is None else lambda count: above(highest, count)
    numbered = number_rows(fresh, [natural.desc()], spec.key, begin, counted)
    return numbered.withColumn(spec.natural_key, cast_to(natural, parse_type(spec.natural_type)))


def assign_keys(new: DataFrame, sgk: DataFrame, spec: SurrogateSpec) -> DataFrame:
    """Number new natural keys above the highest surrogate, natural key descending."""
    return _assigned(new.select(spec.natural_key), sgk, spec, None)


def load_surrogates(
    tables: dict[str, DataFrame],
    sgk: DataFrame,
    spec: SurrogateSpec,
    batch_log: DataFrame,
    as_of: dt.datetime | str | None = None,
    distinct: bool = False,
    above: Above | None = None,
    prefilter: bool = False,
) -> DataFrame:
    """Rows to append to the surrogate table: new keys, numbered, with technical columns.

    Natural keys are counted first, so a key that fills much of the stage is one row in the
    join and the numbering; its copies appear only in the result. ``above`` gives the number to count
    from, of the highest in the table and the number of new rows; the highest itself without it.
    ``prefilter`` as for :func:`new_keys`.
    """
    stage = joined(tables, spec.source_table, spec.joins)
    if spec.where:
        stage = stage.filter(spec.where)
    values = _natural_keys(stage, spec)
    if distinct:
        counted = _distinct_keys(values, spec).withColumn("copies", F.lit(1).cast("long"))
    else:
        counted = values.groupBy(spec.natural_key).agg(F.count(F.lit(1)).alias("copies"))
    fresh = _assigned(_without_surrogate(counted, sgk, spec, prefilter), sgk, spec, "copies", above)
    now = load_time(as_of, "TIMESTAMP(0)")
    filled = {c: F.lit(None).cast(sgk.schema[c].dataType) for c in spec.null_columns if c in sgk.columns}
    return fresh.withColumns(
        filled
        | {
            SURROGATE_SET: F.lit(spec.sgk_id).cast("short"),
            RECORD_ID: F.lit(spec.record_id),
            BATCH_ID: batch_id(batch_log, spec.source),
            INSERTED_AT: now,
            UPDATED_AT: now,
        }
    ).select(*sgk.columns)


def append_surrogates(
    tables: dict[str, DataFrame], sgk: DataFrame, spec: SurrogateSpec, batch_log: DataFrame,
    as_of: dt.datetime | str | None = None, distinct: bool = False, above: Above | None = None,
) -> ApplyResult:
    """New surrogates as a load that only adds rows, ready to publish."""
    rows = load_surrogates(tables, sgk, spec, batch_log, as_of, distinct, above)
    return ApplyResult(
        target=sgk.unionByName(rows), duplicates=sgk.filter(F.lit(False)), flagged=rows,
        outcome=rows.withColumn(DEST, F.lit(MODEL)), appends=True,
    )


def lookup_key(
    df: DataFrame, sgk: DataFrame, source: str, natural_key: str, sgk_id: int, key: str, out: str,
    case_blind: bool = False,
) -> DataFrame:
    """Add ``out``: the surrogate of ``source`` within one SGK_ID, NULL when it has none.

    A left join; Spark broadcasts the surrogates of the set when they are few and splits
    hot values when they are not. With ``case_blind`` letter case tells no keys apart.
    """
    wanted = sgk.filter(F.col(SURROGATE_SET) == sgk_id).select(
        F.col(natural_key).alias("__natural"), F.col(key).alias(out)
    )
    same = folded(F.col(source), TEXT, case_blind) == folded(F.col("__natural"), TEXT, case_blind)
    return df.join(wanted, same, "left").drop("__natural")
