"""Insert, upsert and delete-insert loads of a model table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import all_of, key_equal, sentinel_equal
from millrace.plans.matching import (
    LoadFacts, changes_of, examine, met, need_unique, null_key, paired, rows_of_interest, size_of,
)
from millrace.plans.spec import FLAG, INSERTED_AT, RECORD_ID, MappingSpec

# What happened to an incoming row.
INSERTED, UPDATED, DUPLICATE, IGNORED, REPLACED = "I", "U", "D", "X", "DI"

DEST = "DEST"
MODEL, DUPLICATES, MASKED = "model", "duplicates", "masked"


@dataclass(frozen=True)
class ApplyResult:
    """What a load makes of its rows.

    ``target``      the model table after the load
    ``duplicates``  rows for the duplicate table
    ``flagged``     the load with FLAG; a row with a NULL key has a NULL flag and goes nowhere
    ``outcome``     rows to write, tagged DEST: new model rows and duplicates in one pass
    ``appends``     the model rows of ``outcome`` are added to the model; else they replace it
    ``replaces``    added after all model rows with these values (as text) in a column are taken out
    ``kept``        model rows passed through as they are, not in ``outcome``
    ``final``       the SQL condition all kept rows meet, and all rows a later load will keep
    ``changes``     instead of ``outcome``, only what the load changes, tagged DEST: new rows, duplicates, and
                    model rows that count no more, as they were, tagged masked
    """

    target: DataFrame
    duplicates: DataFrame
    flagged: DataFrame
    outcome: DataFrame
    appends: bool
    replaces: tuple[str, tuple[str, ...]] | None = None
    kept: DataFrame | None = None
    final: str | None = None
    changes: DataFrame | None = None


def model_columns(load: DataFrame) -> list[str]:
    return [c for c in load.columns if c.upper() != FLAG]


def aligned(load: DataFrame, target: DataFrame, spec: MappingSpec) -> tuple[DataFrame, MappingSpec]:
    """Load and spec with column names spelled as the model spells them; letter case tells nothing apart."""
    known = {c.upper(): c for c in target.columns}
    same = load.select(*(F.col(f"`{c}`").alias(known.get(c.upper(), c)) for c in model_columns(load)))
    return same, spec.spelled(known)


def _measured(load: DataFrame, spec: MappingSpec, check_keys: bool, small_load: bool | None) -> LoadFacts:
    """Check that keys are unique and measure the load, as far as the caller does not know already."""
    if not check_keys and small_load is not None:
        return LoadFacts(is_small=small_load)
    if check_keys:
        facts = examine(load, spec.primary_key, spec.types, spec.case_blind)
        need_unique(facts, f"load of record {spec.record_id}")
    else:
        facts = size_of(load)
    return replace(facts, is_small=small_load)


def flag_rows(load: DataFrame, target: DataFrame, spec: MappingSpec, changed: str, small: bool) -> DataFrame:
    """Flag load rows against the model by primary key: new, equal, or ``changed``."""
    keys, compared = spec.primary_key, spec.compare_columns
    types = spec.types
    load = load.select(*model_columns(load))
    old = rows_of_interest(target, load, keys, compared, small, types, spec.case_blind)
    joined = (
        load.filter(~null_key(keys)).alias("new")
        .join(old.alias("old"), key_equal("new", "old", keys, types, spec.case_blind), "left")
    )
    flag = F.when(F.col(f"old.`{keys[0]}`").isNull(), INSERTED)
    if compared:
        flag = flag.when(
            all_of(
                sentinel_equal(F.col(f"new.`{c}`"), F.col(f"old.`{c}`"), types[c], spec.case_blind)
                for c in compared
            ),
            DUPLICATE,
        )
    flagged = joined.select("new.*", flag.otherwise(changed).alias(FLAG))
    return flagged.union(
        load.filter(null_key(keys)).select("*", F.lit(None).cast("string").alias(FLAG))
    )


def _flagged_rows(flagged: DataFrame, *flags: str) -> DataFrame:
    return flagged.filter(F.col(FLAG).isin(*flags)).drop(FLAG)


def _tagged(flagged: DataFrame, model_flags: tuple[str, ...]) -> DataFrame:
    """Load rows bound for the model or the duplicate table."""
    dest = F.when(F.col(FLAG).isin(*model_flags), MODEL).when(F.col(FLAG) == DUPLICATE, DUPLICATES)
    return flagged.withColumn(DEST, dest).filter(F.col(DEST).isNotNull()).drop(FLAG)


def apply_insert(
    load: DataFrame, target: DataFrame, spec: MappingSpec, check_keys: bool = True, small_load: bool | None = None
) -> ApplyResult:
    """Insert rows with new keys, set equal rows aside, ignore changed ones.

    The model is only ever added to, so none of it is rewritten or shuffled beyond its
    key and compare columns.
    """
    load, spec = aligned(load, target, spec)
    flagged = flag_rows(load, target, spec, IGNORED, _measured(load, spec, check_keys, small_load).small)
    new = _flagged_rows(flagged, INSERTED)
    return ApplyResult(
        target=target.unionByName(new, allowMissingColumns=True),
        duplicates=_flagged_rows(flagged, DUPLICATE),
        flagged=flagged,
        outcome=target.filter(F.lit(False))
        .withColumn(DEST, F.lit(MODEL))
        .unionByName(_tagged(flagged, (INSERTED,)), allowMissingColumns=True),
        appends=True,
    )


def apply_upsert(
    load: DataFrame, target: DataFrame, spec: MappingSpec, check_keys: bool = True, small_load: bool | None = None
) -> ApplyResult:
    """Insert rows with new keys, overwrite changed ones, set equal rows aside.

    An overwrite keeps R_ID, INSRT_DTTM and the start date filled by the job.
    """
    load, spec = aligned(load, target, spec)
    keys, types = spec.primary_key, spec.types
    facts = _measured(load, spec, check_keys, small_load)
    flagged = flag_rows(load, target, spec, UPDATED, facts.small)

    pairs = paired(target, load, keys, facts.small, types, spec.case_blind)
    old, new = pairs.old, pairs.new
    matched = pairs.has_old & pairs.has_new
    same = all_of(
        [F.lit(bool(spec.compare_columns))]
        + [sentinel_equal(new(c), old(c), types[c], spec.case_blind) for c in spec.compare_columns]
    )
    updated = matched & ~same
    inserted = pairs.has_new & ~pairs.has_old & all_of(new(k).isNotNull() for k in keys)
    keep = {c.upper() for c in (*keys, RECORD_ID, INSERTED_AT, spec.job_start) if c}

    def new_value(c: str) -> Column:
        return new(c) if c in load.columns else F.lit(None).cast(target.schema[c].dataType)

    def old_value(c: str, is_updated: Column) -> Column:
        if c.upper() in keep or c not in load.columns:
            return old(c)
        return F.when(is_updated, new_value(c)).otherwise(old(c))

    model = pairs.rows.filter(pairs.has_old | inserted).select(
        *(F.when(pairs.has_old, old_value(c, updated)).otherwise(new_value(c)).alias(c) for c in target.columns)
    )
    outcome = pairs.emitted(
        {c: old_value(c, F.col("__updated")) for c in target.columns} | {DEST: F.lit(MODEL)},
        {c: new_value(c) for c in target.columns} | {DEST: F.when(pairs.has_old, DUPLICATES).otherwise(MODEL)},
        with_new=inserted | (matched & ~F.col("__updated")),
        __updated=updated,
    )
    hits = met(target, load, keys, facts, types, spec.case_blind)
    overwritten, added = hits.has_old & ~same, ~hits.has_old & all_of(new(k).isNotNull() for k in keys)
    new_row = {c: new_value(c) for c in target.columns}
    changes = changes_of(hits, [
        (overwritten, {c: old(c) for c in target.columns} | {DEST: F.lit(MASKED)}),
        (overwritten, {c: old_value(c, F.lit(True)) for c in target.columns} | {DEST: F.lit(MODEL)}),
        (added, new_row | {DEST: F.lit(MODEL)}),
        (hits.has_old & same, new_row | {DEST: F.lit(DUPLICATES)}),
    ], outcome.schema)
    return ApplyResult(
        target=model,
        duplicates=_flagged_rows(flagged, DUPLICATE),
        flagged=flagged,
        outcome=outcome,
        appends=False,
        changes=changes,
    )


def apply_delete_insert(load: DataFrame, target: DataFrame, record_id: int) -> ApplyResult:
    """Replace all model rows of the record id by the load; nothing is joined or shuffled."""
    load = load.select(*model_columns(load))
    others = target.filter(~F.col(RECORD_ID).eqNullSafe(F.lit(record_id)))
    nothing = target.filter(F.lit(False))
    return ApplyResult(
        target=others.unionByName(load, allowMissingColumns=True),
        duplicates=load.filter(F.lit(False)),
        flagged=load.withColumn(FLAG, F.lit(REPLACED)),
        outcome=nothing.unionByName(load, allowMissingColumns=True).withColumn(DEST, F.lit(MODEL)),
        appends=False,
        replaces=(RECORD_ID, (str(record_id),)),
    )


def apply_history_delete_insert(load: DataFrame, target: DataFrame, record_id: int) -> ApplyResult:
    """Delete-insert of an entity whose source keeps its own history: versions come ready made."""
    return apply_delete_insert(load, target, record_id)
