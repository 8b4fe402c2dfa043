"""History loads: close-and-insert versions, and rebuilding versions from dated rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import all_of, any_of, folded, key_equal, sentinel_equal
from millrace.functions.types import end_before, high_text, high_value
from millrace.operators.apply import (
    DEST, DUPLICATE, DUPLICATES, INSERTED, MASKED, MODEL, UPDATED, ApplyResult, aligned, model_columns,
)
from millrace.operators.windows import first_by
from millrace.plans.matching import (
    LoadFacts, changes_of, examine, met, need_unique, null_key, paired, rows_of_interest, size_of,
)
from millrace.plans.neighbours import HOT_ROWS, long_keys, neighbours, with_segments
from millrace.plans.spec import BATCH_ID, FLAG, UPDATED_AT, MappingSpec


def _open(spec: MappingSpec) -> Column:
    """Whether a row is an open version; false for a missing end date."""
    return F.coalesce(F.col(f"`{spec.end}`") == high_value(spec.types[spec.end]), F.lit(False))


def flag_versions(
    load: DataFrame, versions: DataFrame, spec: MappingSpec, small: bool, match: list[str] | None = None
) -> DataFrame:
    """Flag load rows against the version of their history key and end date: new, equal or changed.

    ``match`` are the columns of both sides that are compared; the history key alone when both
    hold open versions only.
    """
    keys, start, types = spec.history_keys, spec.start, spec.types
    match = match or [*keys, spec.end]
    load = load.select(*model_columns(load))
    needs = [*keys, start]
    keyed = load.filter(~null_key(needs))
    candidates = rows_of_interest(versions, keyed, match, spec.history_columns, small, types, spec.case_blind)
    joined = keyed.alias("new").join(
        candidates.alias("old"), key_equal("new", "old", match, types, spec.case_blind), "left"
    )
    same = all_of(
        sentinel_equal(F.col(f"new.`{c}`"), F.col(f"old.`{c}`"), types[c], spec.case_blind)
        for c in spec.history_columns
    )
    flag = F.when(F.col(f"old.`{keys[0]}`").isNull(), INSERTED).when(same, DUPLICATE).otherwise(UPDATED)
    return joined.select("new.*", flag.alias(FLAG)).union(
        load.filter(null_key(needs)).select("*", F.lit(None).cast("string").alias(FLAG))
    )


def apply_history(
    load: DataFrame, target: DataFrame, spec: MappingSpec, check_keys: bool = True, small_load: bool | None = None
) -> ApplyResult:
    """Close the version a changed row meets, insert new and changed rows, set equal rows aside.

    A load row meets the model row of its key and its own end date. A closed version ends one
    unit of the end date's type before the new start and takes batch and update time from
    the load. A change on the day a version started leaves its end before its start.

    In the usual load every row is open: it meets open versions only, and closed ones pass
    through untouched. Where ends come from the source, rows may also meet closed versions;
    a row without an end date meets none and is new.
    """
    load, spec = aligned(load, target, spec)
    keys, types = spec.history_keys, spec.types
    if check_keys:
        facts = examine(load, keys, types, spec.case_blind, ~_open(spec))
    elif small_load is None:
        facts = size_of(load, ~_open(spec))
    else:
        facts = LoadFacts(counted=int(not load.filter(~_open(spec)).isEmpty()))
    if not facts.counted:
        match, closed = keys, target.filter(~_open(spec))
        versions = target.filter(F.col(f"`{spec.end}`") == high_value(types[spec.end]))
    else:
        match, closed, versions = [*keys, spec.end], None, target
        need_unique(
            examine(load, [*keys, spec.start], types, spec.case_blind),
            f"load of record {spec.record_id} by key and start",
        )
        facts = examine(load, match, types, spec.case_blind)
    small = facts.small if small_load is None else small_load
    flagged = flag_versions(load, versions, spec, small, match)
    changes = None
    if facts.repeated is None:
        outcome = _one_row_per_key(load, versions, spec, small, match)
        changes = _changed_versions(load, versions, spec, replace(facts, is_small=small), match)
    else:
        outcome = _several_rows_per_key(load, flagged, versions, spec, small, match)
    model = outcome.filter(F.col(DEST) == MODEL).drop(DEST)
    return ApplyResult(
        target=model if closed is None else closed.unionByName(model),
        duplicates=flagged.filter(F.col(FLAG) == DUPLICATE).drop(FLAG),
        flagged=flagged,
        outcome=outcome,
        appends=False,
        kept=closed,
        final=final_versions(spec),
        changes=changes,
    )


def final_versions(spec: MappingSpec) -> str:
    """The condition that tells closed versions, which no later close-and-insert load touches."""
    ctype = spec.types[spec.end]
    literal = "DATE" if ctype.kind == "date" else "TIMESTAMP_NTZ"
    return f"NOT (`{spec.end}` <=> {literal} '{high_text(ctype)}')"


def _closing(spec: MappingSpec, target: DataFrame, new: Callable[[str], Column]) -> dict[str, Column]:
    """What a changed row writes into the version it closes."""
    new_end = end_before(new(spec.start), spec.types[spec.end]).cast(target.schema[spec.end].dataType)
    return {spec.end: new_end} | {c: new(c) for c in target.columns if c.upper() in (BATCH_ID, UPDATED_AT)}


def _one_row_per_key(
    load: DataFrame, versions: DataFrame, spec: MappingSpec, small: bool, match: list[str]
) -> DataFrame:
    """The usual load: each version meets at most one row, so one join decides both."""
    types, columns = spec.types, versions.columns
    keyed = load.filter(~null_key([*spec.history_keys, spec.start]))
    pairs = paired(versions, keyed, match, small, types, spec.case_blind)
    old, new = pairs.old, pairs.new
    same = pairs.has_old & pairs.has_new & all_of(
        sentinel_equal(new(c), old(c), types[c], spec.case_blind) for c in spec.history_columns
    )
    closing, changed = _closing(spec, versions, new), pairs.has_old & pairs.has_new & ~F.col("__same")
    return pairs.emitted(
        {c: F.when(changed, closing[c]).otherwise(old(c)) if c in closing else old(c) for c in columns}
        | {DEST: F.lit(MODEL)},
        {
            c: (new(c) if c in load.columns else F.lit(None)).cast(versions.schema[c].dataType)
            for c in columns
        }
        | {DEST: F.when(F.col("__same"), DUPLICATES).otherwise(MODEL)},
        with_new=pairs.has_new,
        __same=same,
    )


def _changed_versions(
    load: DataFrame, versions: DataFrame, spec: MappingSpec, facts: LoadFacts, match: list[str]
) -> DataFrame:
    """Only what the usual load writes: versions it closes, as they were, to be masked, and closed; its own rows.

    A table of versions that takes such changes tells the versions of a key apart by their end.
    """
    columns = versions.columns
    keyed = load.filter(~null_key([*spec.history_keys, spec.start]))
    pairs = met(versions, keyed, match, facts, spec.types, spec.case_blind)
    old, new = pairs.old, pairs.new
    same = pairs.has_old & all_of(
        sentinel_equal(new(c), old(c), spec.types[c], spec.case_blind) for c in spec.history_columns
    )
    closing = _closing(spec, versions, new)
    new_row = {c: new(c) if c in load.columns else F.lit(None) for c in columns}
    return changes_of(pairs, [
        (pairs.has_old & ~same, {c: old(c) for c in columns} | {DEST: F.lit(MASKED)}),
        (pairs.has_old & ~same, {c: closing.get(c, old(c)) for c in columns} | {DEST: F.lit(MODEL)}),
        (~same, new_row | {DEST: F.lit(MODEL)}),
        (same, new_row | {DEST: F.lit(DUPLICATES)}),
    ], T.StructType([*versions.schema.fields, T.StructField(DEST, T.StringType())]))


def _several_rows_per_key(
    load: DataFrame, flagged: DataFrame, versions: DataFrame, spec: MappingSpec, small: bool, match: list[str]
) -> DataFrame:
    """A load with several starts of a key: equal rows may repeat, but one row at most may be new."""
    keys, start, types = spec.history_keys, spec.start, spec.types
    need_unique(
        examine(load, [*keys, start], types, spec.case_blind), f"load of record {spec.record_id} by key and start"
    )
    applied = flagged.filter(F.col(FLAG).isin(INSERTED, UPDATED))
    need_unique(
        examine(applied.select(*match), match, types, spec.case_blind),
        f"load of record {spec.record_id}, new versions",
    )
    changes = applied.filter(F.col(FLAG) == UPDATED).select(
        *dict.fromkeys([*match, start, *(c for c in load.columns if c.upper() in (BATCH_ID, UPDATED_AT))])
    )
    if small:
        changes = F.broadcast(changes)
    closing = _closing(spec, versions, lambda c: F.col(f"new.`{c}`"))
    hit = F.col(f"new.`{keys[0]}`").isNotNull()
    maybe_closed = versions.alias("old").join(
        changes.alias("new"), key_equal("old", "new", match, types, spec.case_blind), "left"
    ).select(
        *(
            (F.when(hit, closing[c]).otherwise(F.col(f"old.`{c}`")) if c in closing else F.col(f"old.`{c}`")).alias(c)
            for c in versions.columns
        ),
        F.lit(MODEL).alias(DEST),
    )
    dest = F.when(F.col(FLAG) == DUPLICATE, DUPLICATES).otherwise(MODEL)
    incoming = flagged.filter(F.col(FLAG).isNotNull()).withColumn(DEST, dest).drop(FLAG)
    return maybe_closed.unionByName(incoming, allowMissingColumns=True)


def apply_history_legacy(
    load: DataFrame, target: DataFrame, spec: MappingSpec, hot_rows: int = HOT_ROWS
) -> ApplyResult:
    """Rebuild versions from dated rows.

    Model rows sharing key and start with a load row are taken out, merged with the load
    (lowest batch wins, then the existing row) and put back as versions: a row stays when
    all its previous values are NULL or one of them differs, and ends where the next kept
    row starts. Model rows of other starts are neither read again nor ended anew.
    """
    load, spec = aligned(load, target, spec)
    keys, start, end, compared = spec.history_keys, spec.start, spec.end, spec.history_columns
    types = spec.types
    at = [*keys, start]
    folded_keys = [f"__key_{i}" for i in range(len(keys))]
    as_keys = {
        n: folded(F.col(f"`{k}`"), types.get(k), spec.case_blind) for n, k in zip(folded_keys, keys)
    }
    # one row is kept per key and start, so these are counted and cut, not the load's rows
    dated = load.withColumns(as_keys).select(*folded_keys, start).distinct()
    long = long_keys(dated, folded_keys, start, hot_rows)
    spots = load.filter(~null_key(at)).select(*at).distinct()
    spots = F.broadcast(spots) if long.small else spots
    same_spot = key_equal("old", "new", at, types, spec.case_blind)
    # Both branches read the same shuffled target; rows with a NULL match nothing and skip it.
    keyed = target.filter(~null_key(at)).alias("old")
    touched = keyed.join(spots.alias("new"), same_spot, "left_semi")
    untouched = keyed.join(spots.alias("new"), same_spot, "left_anti").union(target.filter(null_key(at)))

    merged = load.withColumn("__incoming", F.lit(1)).unionByName(
        touched.select(*(c for c in target.columns if c in load.columns)).withColumn("__incoming", F.lit(0)),
        allowMissingColumns=True,
    )
    tie_break = [F.col(BATCH_ID).asc(), F.col("__incoming").asc()]
    tie_break += [F.col(f"`{c}`").asc() for c in load.columns if c not in at and c.upper() != BATCH_ID]
    spot = [folded(F.col(f"`{c}`"), types.get(c), spec.case_blind) for c in at]
    single = first_by(merged, spot, tie_break).drop("__incoming")

    cut = with_segments(single.withColumns(as_keys), long, folded_keys, start)
    seen = neighbours(cut, folded_keys, start, compared, "previous", "__pre_")
    changed = seen.filter(
        all_of(F.col(f"`__pre_{c}`").isNull() for c in compared)
        | any_of(
            folded(F.col(f"`__pre_{c}`"), types[c], spec.case_blind)
            != folded(F.col(f"`{c}`"), types[c], spec.case_blind)
            for c in compared
        )
    )
    ended = neighbours(changed, folded_keys, start, [start], "next", "__next_")
    versions = ended.withColumn(
        end, F.coalesce(F.col(f"`__next_{start}`").cast(types[end].spark), high_value(types[end]))
    ).select(*load.columns)
    model = untouched.unionByName(versions, allowMissingColumns=True)
    return ApplyResult(
        target=model,
        duplicates=load.filter(F.lit(False)),
        flagged=load.withColumn(FLAG, F.lit(None).cast("string")),
        outcome=model.withColumn(DEST, F.lit(MODEL)),
        appends=False,
        final=final_versions(spec),
    )


def apply_history_auto(
    load: DataFrame, target: DataFrame, spec: MappingSpec, initial: bool, **options
) -> ApplyResult:
    """First load of a legacy history by rebuild, later loads by close-and-insert."""
    return apply_history_legacy(load, target, spec, **options) if initial else apply_history(
        load, target, spec, **options
    )
