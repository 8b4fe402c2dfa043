"""Transformations: stage tables to load-ready rows, one rule per target column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import folded
from millrace.functions.types import BARE_CONSTANT_TYPES, cast_to, high_value, load_time, parse_type
from millrace.operators.windows import qualify
from millrace.plans.spec import (
    BATCH_ID, END, INSERTED_AT, RECORD_ID, START, SURROGATE_SET, UPDATED_AT, UPSERT,
    ColumnSpec, Join, Lookup, MappingSpec, SpecError,
)

TEXT = parse_type("VARCHAR")

# Words of the rule column.
DIRECT, NULL_RULE = "1:1", "NULL"
CONSTANT_WORDS = ("HARDCODE TO", "SET TO")
CONSTANT_SOURCE, JOB_SOURCE, TOOL_SOURCE = "HCV", "JOB", "ETL"


def const(value: str, type_text: str) -> Column:
    """A constant of a rule: bare for whole numbers and floats, text for every other type."""
    ctype = parse_type(type_text)
    bare = type_text.strip().upper() in BARE_CONSTANT_TYPES
    return cast_to(F.expr(value) if bare else F.lit(value), ctype)


def direct(table: str, column: str, type_text: str) -> Column:
    return cast_to(F.col(f"`{table}`.`{column}`"), parse_type(type_text))


def job_start(as_of: dt.datetime | str | None, type_text: str) -> Column:
    return load_time(as_of, type_text)


def open_end(type_text: str) -> Column:
    ctype = parse_type(type_text)
    return cast_to(high_value(ctype), ctype)


def expr_rule(sql: str, type_text: str) -> Column:
    return cast_to(F.expr(sql), parse_type(type_text))


def batch_id(batch_log: DataFrame, source: str) -> Column:
    """The latest batch of a source, 0 when it has none; one value, read once per query."""
    latest = batch_log.filter(F.col("B_SOURCE") == source).agg(F.max(BATCH_ID).alias(BATCH_ID))
    return latest.select(F.coalesce(F.col(BATCH_ID), F.lit(0)).alias(BATCH_ID)).scalar()


def technical_columns(
    df: DataFrame, record_id: int, batch: Column | int, as_of: dt.datetime | str | None = None
) -> DataFrame:
    now = load_time(as_of)
    return df.withColumns(
        {
            RECORD_ID: F.lit(record_id),
            BATCH_ID: F.lit(batch) if isinstance(batch, int) else batch,
            INSERTED_AT: now,
            UPDATED_AT: now,
        }
    )


def rule_column(column: ColumnSpec, spec: MappingSpec, as_of: dt.datetime | str | None) -> Column:
    """The expression of one target column; the first rule that fits wins."""
    name, load_type = column.name.upper(), spec.load_type
    source, source_column = column.source_table.upper(), column.source_column.upper()
    rule = column.rule.replace("\n", " ").upper().strip()
    keeps_history = "HISTORY" in load_type
    role = column.role.upper() if keeps_history else ""
    ctype = column.ctype

    if source == source_column == CONSTANT_SOURCE and ("_END_" not in name or load_type == UPSERT):
        if rule == NULL_RULE:
            return F.lit(None).cast(ctype.spark)
        for word in CONSTANT_WORDS:
            rule = rule.replace(word, " ")
        return const(rule.replace("'", "").strip(), column.type)
    if rule == DIRECT and source not in (JOB_SOURCE, TOOL_SOURCE):
        return direct(column.source_table, column.source_column, column.type)
    if source == JOB_SOURCE and ("_STRT_" in name or role == START):
        return job_start(as_of, column.type)
    if source == TOOL_SOURCE and rule == DIRECT and source_column == INSERTED_AT:
        return load_time(as_of, column.type)
    if role == END:
        return open_end(column.type)
    if column.expr is not None:
        return expr_rule(column.expr, column.type)
    raise SpecError(
        f"record {spec.record_id}: column {column.name} follows the rule {column.rule!r}, "
        "which needs an expression in the spec"
    )


def joined(tables: dict[str, DataFrame], from_table: str, joins: Iterable[Join], base: DataFrame | None = None) -> DataFrame:
    """The from table with its declared joins, each table under its alias."""
    df = (tables[from_table] if base is None else base).alias(from_table)
    for join in joins:
        df = df.join(tables[join.table].alias(join.alias or join.table), F.expr(join.on), join.how)
    return df


def _with_lookups(df: DataFrame, tables: dict[str, DataFrame], lookups: Iterable[Lookup]) -> DataFrame:
    for lookup in lookups:
        surrogates = tables[lookup.table].filter(F.col(SURROGATE_SET) == lookup.sgk_id).alias(lookup.alias)
        natural = F.col(f"`{lookup.alias}`.`{lookup.natural_key}`")
        match = folded(F.expr(lookup.source), TEXT, lookup.case_blind) == folded(natural, TEXT, lookup.case_blind)
        df = df.join(surrogates, match, "left")
    return df


def grouped(df: DataFrame, columns: Sequence[str], where: str | None = None) -> DataFrame:
    """The distinct values of the columns, after the filter: a grouping rule without measures."""
    kept = df.filter(where) if where else df
    return kept.select(*columns).distinct()


def transform(
    spec: MappingSpec,
    tables: dict[str, DataFrame],
    batch_log: DataFrame,
    as_of: dt.datetime | str | None = None,
    apply_filters: bool = True,
) -> DataFrame:
    """Load-ready rows of one mapping: joins, lookups, filter, rules and technical columns.

    A grouping rule filters and groups the from table before the joins; other filters run
    after them. Columns are resolved by name.
    """
    base = tables[spec.from_table]
    where = spec.where if apply_filters else None
    if apply_filters and spec.group_by:
        base, where = grouped(base, spec.group_by, where), None
    df = _with_lookups(joined(tables, spec.from_table, spec.joins, base), tables, spec.lookups)
    if where:
        df = df.filter(where)
    if apply_filters and spec.qualify:
        df = qualify(df, spec.qualify)
    rows = df.select(*(rule_column(c, spec, as_of).alias(c.name) for c in spec.mapped))
    return technical_columns(rows, spec.record_id, batch_id(batch_log, spec.source), as_of)


def run_transforms(
    specs: Iterable[MappingSpec],
    tables: dict[str, DataFrame],
    batch_log: DataFrame,
    as_of: dt.datetime | str | None = None,
    apply_filters: bool = False,
) -> dict[str, DataFrame]:
    """Load-ready tables of all mappings, named ``<entity>_R<record id>``.

    The combined run joins surrogate tables only and applies no filters unless asked to.
    """
    return {
        f"{spec.entity}_R{spec.record_id}": transform(spec, tables, batch_log, as_of, apply_filters)
        for spec in specs
    }
