import datetime as dt
import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.apply import (
    apply_delete_insert, apply_history_delete_insert, apply_insert, apply_upsert,
)
from millrace.plans.matching import RepeatedKey, examine, size_of
from millrace.plans.spec import ColumnSpec, MappingSpec

SPEC = MappingSpec(1, "T", "UPSERT", (
    ColumnSpec("ID", "INTEGER", pk=True),
    ColumnSpec("VAL", "VARCHAR(10)"),
    ColumnSpec("NUM", "INTEGER"),
    ColumnSpec("ROW_STRT_DT", "DATE", source_table="JOB"),
))
SCHEMA = "ID int, VAL string, NUM int, ROW_STRT_DT date, R_ID int, B_ID long, INSRT_DTTM timestamp_ntz, UPDT_DTTM timestamp_ntz"
OLD, NEW = dt.datetime(2020, 1, 1), dt.datetime(2024, 6, 1)


def table(spark, values, at, batch, record=1):
    lines = [(i, v, n, at.date(), record, batch, at, at) for i, v, n in values]
    return spark.createDataFrame(lines, SCHEMA)


@pytest.fixture
def null_rules(spark):
    target = table(spark, [(1, "-", 1), (2, None, 1), (3, "y", 1), (4, "same", 1), (None, "gone", 1)], OLD, 1)
    load = table(spark, [(1, None, 1), (2, "-", 1), (3, "z", 1), (None, "n", 1), (4, "same", 1), (5, "new", 1)], NEW, 2, 9)
    return load, target


@pytest.mark.parametrize("small", [True, False, None])
def test_upsert_flags_follow_null_rules(null_rules, small):
    load, target = null_rules
    result = apply_upsert(load, target, SPEC, small_load=small)
    assert rows(result.flagged, "ID", "FLAG") == [(None, None), (1, "D"), (2, "D"), (3, "U"), (4, "D"), (5, "I")]
    assert rows(result.duplicates, "ID", "VAL") == [(1, None), (2, "-"), (4, "same")]


@pytest.mark.parametrize("small", [True, False])
def test_upsert_keeps_origin_of_updated_rows(null_rules, small):
    load, target = null_rules
    found = rows(apply_upsert(load, target, SPEC, small_load=small).target)
    assert found == rows(target.sparkSession.createDataFrame([
        (None, "gone", 1, OLD.date(), 1, 1, OLD, OLD),
        (1, "-", 1, OLD.date(), 1, 1, OLD, OLD),
        (2, None, 1, OLD.date(), 1, 1, OLD, OLD),
        (3, "z", 1, OLD.date(), 1, 2, OLD, NEW),
        (4, "same", 1, OLD.date(), 1, 1, OLD, OLD),
        (5, "new", 1, NEW.date(), 9, 2, NEW, NEW),
    ], SCHEMA))


@pytest.mark.parametrize("small", [True, False])
def test_insert_ignores_changed_rows(null_rules, small):
    load, target = null_rules
    result = apply_insert(load, target, SPEC, small_load=small)
    assert rows(result.flagged, "ID", "FLAG") == [(None, None), (1, "D"), (2, "D"), (3, "X"), (4, "D"), (5, "I")]
    assert rows(result.target, "ID", "VAL") == rows(target.union(load.filter("ID = 5")), "ID", "VAL")
    assert result.appends


def test_second_upsert_finds_only_duplicates(null_rules):
    load, target = null_rules
    once = apply_upsert(load, target, SPEC).target
    again = apply_upsert(load, once, SPEC)
    assert {f for (f,) in rows(again.flagged, "FLAG")} == {"D", None}
    assert rows(again.target) == rows(once)


def test_without_comparable_columns_every_match_is_an_update(spark):
    spec = MappingSpec(1, "T", "UPSERT", (ColumnSpec("ID", "INTEGER", pk=True),))
    target = spark.createDataFrame([(1, 1)], "ID int, B_ID long")
    load = spark.createDataFrame([(1, 2), (2, 2)], "ID int, B_ID long")
    result = apply_upsert(load, target, spec)
    assert rows(result.flagged, "ID", "FLAG") == [(1, "U"), (2, "I")]
    assert rows(result.target) == [(1, 2), (2, 2)]
    assert rows(apply_insert(load, target, spec).flagged, "ID", "FLAG") == [(1, "X"), (2, "I")]


def test_repeated_load_keys_are_refused(spark):
    target = table(spark, [], OLD, 1)
    load = table(spark, [(1, "a", 1), (1, "b", 1)], NEW, 2)
    for apply in (apply_insert, apply_upsert):
        with pytest.raises(RepeatedKey, match="record 1: several rows for the key 1"):
            apply(load, target, SPEC)
    nulls = table(spark, [(None, "a", 1), (None, "b", 1)], NEW, 2)
    assert apply_upsert(nulls, target, SPEC).target.count() == 0


def test_keys_may_ignore_case(spark):
    spec = MappingSpec(1, "T", "UPSERT", (
        ColumnSpec("CODE", "VARCHAR(5)", pk=True), ColumnSpec("VAL", "VARCHAR(5)"),
    ), case_blind=True)
    target = spark.createDataFrame([("ab", "x"), ("cd", "y")], "CODE string, VAL string")
    load = spark.createDataFrame([("AB", "X"), ("CD", "z"), ("ef", "w")], "CODE string, VAL string")
    for small in (True, False):
        result = apply_upsert(load, target, spec, small_load=small)
        assert rows(result.flagged, "CODE", "FLAG") == [("AB", "D"), ("CD", "U"), ("ef", "I")]
        assert rows(result.target) == [("ab", "x"), ("cd", "z"), ("ef", "w")]
    assert rows(apply_upsert(load, target, replace(spec, case_blind=False)).flagged, "FLAG") == [("I",)] * 3
    twice = spark.createDataFrame([("ab", "x"), ("AB", "y")], "CODE string, VAL string")
    with pytest.raises(RepeatedKey):
        apply_upsert(twice, target, spec)


def test_columns_of_other_mappings_stay(spark):
    target = spark.createDataFrame([(1, "a", "extra")], "ID int, VAL string, OTHER string")
    load = spark.createDataFrame([(1, "b"), (2, "c")], "ID int, VAL string")
    spec = MappingSpec(1, "T", "UPSERT", (ColumnSpec("ID", "INTEGER", pk=True), ColumnSpec("VAL", "VARCHAR(5)")))
    assert rows(apply_upsert(load, target, spec).target) == [(1, "b", "extra"), (2, "c", None)]


def test_delete_insert_replaces_one_record_id(spark):
    schema = "ID int, R_ID int"
    target = spark.createDataFrame([(1, 7), (2, 8), (3, None)], schema)
    load = spark.createDataFrame([(9, 7)], schema)
    for apply in (apply_delete_insert, apply_history_delete_insert):
        result = apply(load, target, 7)
        assert rows(result.target) == [(2, 8), (3, None), (9, 7)]
        assert rows(result.flagged, "FLAG") == [("DI",)]
        assert rows(apply(load, result.target, 7).target) == rows(result.target)
        assert rows(apply(load.limit(0), target, 7).target) == [(2, 8), (3, None)]


def reference_upsert(load, target):
    """Row by row, as the rules read."""
    flags, duplicates = {}, []
    model = {row[0]: row for row in target}
    sent = lambda v, s: s if v is None else v
    result = dict(model)
    for key, text, number in load:
        if key not in model:
            flags[key], result[key] = "I", (key, text, number)
        elif (sent(text, "-"), sent(number, -1)) == (sent(model[key][1], "-"), sent(model[key][2], -1)):
            flags[key] = "D"
            duplicates.append(key)
        else:
            flags[key], result[key] = "U", (key, text, number)
    return flags, sorted(duplicates), sorted(result.values(), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_upsert_agrees_with_row_by_row_rules(spark, seed):
    rng = random.Random(seed)

    def some():
        keys = rng.sample(range(60), 40)
        return [(k, rng.choice(["a", "b", "-", None]), rng.choice([1, -1, None])) for k in keys]

    load, target = some(), some()
    flags, duplicates, model = reference_upsert(load, target)
    for small in (True, False):
        result = apply_upsert(table(spark, load, NEW, 2), table(spark, target, OLD, 1), SPEC, small_load=small)
        assert dict(rows(result.flagged, "ID", "FLAG")) == flags
        assert sorted(k for (k,) in rows(result.duplicates, "ID")) == duplicates
        assert sorted(rows(result.target, "ID", "VAL", "NUM"), key=str) == model
        by_flag = dict(result.flagged.groupBy("FLAG").count().collect())
        assert sum(by_flag.values()) == len(load)
        assert rows(result.outcome.filter("DEST = 'duplicates'"), "ID") == rows(result.duplicates, "ID")


def test_examine_measures_and_finds_repeats(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (2, "x" * 1000), (None, "a"), (None, "b")], "k int, v string")
    facts = examine(df, ["k"])
    assert facts.repeated == "2" and facts.bytes > 1000
    assert size_of(df).bytes == facts.bytes
    assert examine(df.filter("k = 1 OR k IS NULL"), ["k"]).repeated is None
    nested = df.select("k", F.array(F.repeat("v", F.lit(1000))).alias("a"))
    assert size_of(nested).bytes > 1_000_000


def test_letter_case_of_names_does_not_matter(spark):
    target = spark.createDataFrame([(1, "a", 1, OLD), (2, "b", 1, OLD)], "Id int, val string, b_id long, updt_dttm timestamp_ntz")
    load = spark.createDataFrame([(1, "x", 2, NEW), (3, "c", 2, NEW)], "ID int, VAL string, B_ID long, UPDT_DTTM timestamp_ntz")
    spec = MappingSpec(1, "T", "UPSERT", (ColumnSpec("id", "INTEGER", pk=True), ColumnSpec("Val", "VARCHAR(5)")))
    expected = [(1, "x", 2, NEW), (2, "b", 1, OLD), (3, "c", 2, NEW)]
    for small in (True, False):
        found = apply_upsert(load, target, spec, small_load=small).target
        assert rows(found) == expected and found.columns == target.columns
    assert rows(apply_insert(load, target, spec).target, "Id", "val") == [(1, "a"), (2, "b"), (3, "c")]
