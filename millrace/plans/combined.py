"""The combined run: all mappings of a spec in one pass over each stage table, surrogates first."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import any_of, folded
from millrace.functions.types import load_time
from millrace.operators.keys import load_surrogates
from millrace.operators.transform import TEXT, batch_id, joined, rule_column, transform
from millrace.plans.numbering import frozen, session_folder
from millrace.plans.spec import (
    BATCH_ID, INSERTED_AT, RECORD_ID, SURROGATE_SET, UPDATED_AT, Lookup, MappingSpec, SpecError, SurrogateSpec,
)

READY = "LOAD_READY"
MOST_ALIKE = 1000  # surrogates of one natural key that may come with a stage row as a list


def ready_name(spec: MappingSpec) -> str:
    return f"{spec.entity}_R{spec.record_id}"


@dataclass(frozen=True)
class _Found:
    """A surrogate table as lists by natural key, and the most that one key has."""

    rows: DataFrame
    most: int


def _by_natural_key(lookup: Lookup, tables: dict[str, DataFrame]) -> _Found:
    rows = tables[lookup.table].filter((F.col(SURROGATE_SET) == lookup.sgk_id) & F.col(f"`{lookup.natural_key}`").isNotNull())
    natural = folded(F.col(f"`{lookup.natural_key}`"), TEXT, lookup.case_blind)
    keyed = rows.withColumn("__natural", natural)
    most = keyed.groupBy("__natural").count().agg(F.max("count")).first()[0] or 0
    held = F.collect_list(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    return _Found(keyed.groupBy("__natural").agg(held.alias("__held")), most)


def _same_search(lookup: Lookup) -> tuple:
    return lookup.source, lookup.table, lookup.natural_key, lookup.sgk_id, lookup.case_blind


def _row(spec: MappingSpec, batch: Column, as_of: dt.datetime | str | None) -> Column:
    """A load-ready row of a mapping as one struct."""
    now = load_time(as_of)
    return F.struct(
        *(rule_column(c, spec, as_of).alias(c.name) for c in spec.mapped),
        F.lit(spec.record_id).alias(RECORD_ID), batch.alias(BATCH_ID), now.alias(INSERTED_AT), now.alias(UPDATED_AT),
    )


def fused(
    specs: Sequence[MappingSpec], tables: dict[str, DataFrame], batch_log: DataFrame,
    as_of: dt.datetime | str | None = None, apply_filters: bool = False,
) -> DataFrame:
    """Load-ready rows of several mappings of one stage table with the same joins, from one scan of it.

    A stage row becomes one row for each mapping, tagged ``LOAD_READY``, with the mapping's columns in a
    struct of that name; other structs are NULL. Lookups are joined as lists by natural key, so that
    a natural key with several surrogates repeats the rows of the mapping that looks it up, and no others.
    """
    first = specs[0]
    rows = joined(tables, first.from_table, first.joins)
    lists: dict[tuple, str] = {}
    for lookup in (lookup for spec in specs for lookup in spec.lookups):
        if _same_search(lookup) not in lists:
            held, key = f"__held_{len(lists)}", f"__natural_{len(lists)}"
            lists[_same_search(lookup)] = held
            found = _by_natural_key(lookup, tables).rows.toDF(key, held)
            source = folded(F.expr(lookup.source), TEXT, lookup.case_blind)
            rows = rows.join(found, source == F.col(key), "left")
    tags = F.array(*(F.lit(ready_name(spec)) for spec in specs))
    rows = rows.withColumn(READY, F.explode(tags))
    for spec in specs:
        for lookup in spec.lookups:
            # a list of none gives one row without a surrogate, as a left join does
            mine = F.when(F.col(READY) == ready_name(spec), F.col(lists[_same_search(lookup)]))
            rows = rows.withColumn(f"__{spec.record_id}_{lookup.alias}", F.explode_outer(mine))
    made = []
    for spec in specs:
        named = rows
        for lookup in spec.lookups:
            named = named.withColumn(lookup.alias, F.col(f"__{spec.record_id}_{lookup.alias}"))
        mine = F.col(READY) == ready_name(spec)
        wanted = F.when(mine, F.expr(spec.where)).otherwise(False) if apply_filters and spec.where else mine
        out = f"__row_{spec.record_id}"
        rows = named.withColumn(out, F.when(wanted, _row(spec, batch_id(batch_log, spec.source), as_of)))
        rows = rows.drop(*(lookup.alias for lookup in spec.lookups))
        made.append(F.col(out).alias(ready_name(spec)))
    return rows.select(READY, *made).filter(any_of(F.col(f"`{ready_name(spec)}`").isNotNull() for spec in specs))


def _alone(spec: MappingSpec, tables: dict[str, DataFrame], apply_filters: bool) -> bool:
    """Whether a mapping needs a pass of its own: groups and windows look at all rows of its own."""
    if apply_filters and (spec.qualify or spec.group_by):
        return True
    return any(_by_natural_key(lookup, tables).most > MOST_ALIKE for lookup in spec.lookups)


def write_transforms(
    specs: Iterable[MappingSpec],
    tables: dict[str, DataFrame],
    batch_log: DataFrame,
    as_of: dt.datetime | str | None = None,
    apply_filters: bool = False,
    surrogates: Iterable[SurrogateSpec] = (),
) -> dict[str, DataFrame]:
    """Load-ready tables of all mappings, written once and named ``<entity>_R<record id>``.

    Surrogates are loaded first, those whose stage joins other surrogates after these, and the mappings
    look up what was loaded. Then each stage table is read once for all its mappings with the same
    joins, and their rows are written in one pass, a folder for each. The combined run applies no
    filters unless asked to; mappings that group or qualify then have a pass of their own.
    """
    tables = with_surrogates(surrogates, tables, batch_log, as_of)
    groups: dict[tuple, list[MappingSpec]] = {}
    ready: dict[str, DataFrame] = {}
    for spec in specs:
        if ready_name(spec) in ready or any(ready_name(spec) == ready_name(s) for g in groups.values() for s in g):
            raise SpecError(f"two mappings fill {ready_name(spec)}")
        if _alone(spec, tables, apply_filters):
            ready[ready_name(spec)] = frozen(transform(spec, tables, batch_log, as_of, apply_filters))
        else:
            groups.setdefault((spec.from_table, spec.joins), []).append(spec)
    for group in groups.values():
        rows = fused(group, tables, batch_log, as_of, apply_filters)
        folder = f"{session_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
        rows.write.partitionBy(READY).parquet(folder)
        for spec in group:
            name = ready_name(spec)
            schema = T.StructType([rows.schema[name], T.StructField(READY, T.StringType())])
            stored = rows.sparkSession.read.schema(schema).parquet(folder).filter(F.col(READY) == name)
            ready[name] = stored.select(f"`{name}`.*")
    return ready


def with_surrogates(
    surrogates: Iterable[SurrogateSpec], tables: dict[str, DataFrame], batch_log: DataFrame,
    as_of: dt.datetime | str | None = None,
) -> dict[str, DataFrame]:
    """The tables with the new surrogates of all specs in them, each loaded after those its stage is joined with."""
    tables, left = dict(tables), list(surrogates)
    while left:
        pending = {spec.entity for spec in left}
        free = [s for s in left if not pending & {s.source_table, *(j.table for j in s.joins)} - {s.entity}]
        if not free:
            raise SpecError(f"surrogate loads wait for each other: {sorted(pending)}")
        spec = free[0]
        known = tables[spec.entity]
        new = frozen(load_surrogates(tables, known, spec, batch_log, as_of, distinct=True))
        tables[spec.entity] = known.unionByName(new)
        left.remove(spec)
    return tables
