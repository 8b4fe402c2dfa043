"""Run a mapping from stage to model: transform, then the load its type asks for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from millrace.operators.apply import (
    ApplyResult, apply_delete_insert, apply_history_delete_insert, apply_insert, apply_upsert,
)
from millrace.operators.history import apply_history, apply_history_auto
from millrace.operators.transform import transform
from millrace.plans.numbering import frozen
from millrace.plans.spec import (
    DELETE_INSERT, HISTORY, HISTORY_DELETE_INSERT, HISTORY_LEGACY, INSERT, SURROGATE_SUFFIX, UPSERT,
    MappingSpec, SpecError,
)


def run_load(
    spec: MappingSpec,
    load: DataFrame,
    target: DataFrame,
    initial: bool = False,
    allow_special: bool = False,
    exclude_sources: tuple[str, ...] = (),
) -> ApplyResult:
    """Apply a load-ready table to its model table by the load type of the spec.

    Mappings marked for special handling are left to a person unless allowed; mappings of
    excluded sources and surrogate tables are not loaded this way.
    """
    spec = spec.resolved()
    if spec.special and not allow_special:
        raise SpecError(f"record {spec.record_id} is marked for special handling")
    if {s.upper() for s in spec.source_systems} & {s.upper() for s in exclude_sources}:
        raise SpecError(f"record {spec.record_id} comes from an excluded source system")
    if spec.entity.upper().endswith(SURROGATE_SUFFIX):
        raise SpecError(f"record {spec.record_id} fills a surrogate table: use load_surrogates")
    if spec.load_type == DELETE_INSERT:
        return apply_delete_insert(load, target, spec.record_id)
    if spec.load_type == HISTORY_DELETE_INSERT:
        return apply_history_delete_insert(load, target, spec.record_id)
    if spec.load_type == HISTORY_LEGACY:
        return apply_history_auto(load, target, spec, initial)
    return {INSERT: apply_insert, UPSERT: apply_upsert, HISTORY: apply_history}[spec.load_type](load, target, spec)


def run_mapping(
    spec: MappingSpec,
    tables: dict[str, DataFrame],
    target: DataFrame,
    batch_log: DataFrame,
    as_of: dt.datetime | str | None = None,
    **options,
) -> ApplyResult:
    """Transform stage tables by a mapping into the load-ready table, and apply that.

    The load-ready rows are stored before they are applied: stage tables are read once, and the
    rows checked are the rows matched, also where a rule has ties.
    """
    load = frozen(transform(spec, tables, batch_log, as_of))
    return run_load(spec, load, target, **options)
