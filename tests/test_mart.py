import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.checks import CheckError, check_not_null, check_unique, duplicate_keys, null_counts
from millrace.operators.mart import apply_mart, insert_new_mart, load_mart, merge_mart
from millrace.plans.matching import RepeatedKey
from millrace.sources.dictionary import SourceColumn, SourceTable
from millrace.sources.publish import NO_VALUE, Layout, last_commit, publish_load, reached, read_model, truncate_load
from millrace.sources.tables import append_archive

AS_OF, OLD = dt.datetime(2024, 6, 1, 8, 30), dt.datetime(2020, 1, 1)
STAGE = "id int, val string, batch_id int, filename string, dump_dttm timestamp_ntz"
MART = "id int, val string, batch_id int, filename string, insrt_dttm timestamp_ntz, updt_dttm timestamp_ntz, dump_dttm timestamp_ntz"


def stage(spark, values):
    return spark.createDataFrame([(i, v, 7, "f.csv", AS_OF) for i, v in values], STAGE)


def mart(spark, values):
    return spark.createDataFrame([(i, v, 3, None, OLD, None, OLD) for i, v in values], MART)


@pytest.mark.parametrize("small", [True, False, None])
def test_merge(spark, small):
    found = merge_mart(
        stage(spark, [(1, "a2"), (2, None), (4, "d"), (None, "n")]),
        mart(spark, [(1, "a"), (2, "b"), (3, "c"), (None, "m")]), ["id"], AS_OF, small_load=small,
    )
    assert rows(found) == [
        (None, "m", 3, None, OLD, None, OLD),
        (None, "n", 7, None, AS_OF, None, AS_OF),
        (1, "a2", 3, None, OLD, AS_OF, AS_OF),
        (2, None, 3, None, OLD, AS_OF, AS_OF),
        (3, "c", 3, None, OLD, None, OLD),
        (4, "d", 7, None, AS_OF, None, AS_OF),
    ]


def test_merge_adds_null_keys_every_run(spark):
    load, model = stage(spark, [(None, "n")]), mart(spark, [])
    once = merge_mart(load, model, ["id"], AS_OF)
    assert merge_mart(load, once, ["id"], AS_OF).count() == 2


def test_merge_needs_unique_keys(spark):
    with pytest.raises(ValueError, match="key columns"):
        merge_mart(stage(spark, []), mart(spark, []), [], AS_OF)
    with pytest.raises(RepeatedKey):
        merge_mart(stage(spark, [(1, "a"), (1, "b")]), mart(spark, []), ["id"], AS_OF)


@pytest.mark.parametrize("small", [True, False])
def test_insert_new_leaves_matches_alone(spark, small):
    found = insert_new_mart(
        stage(spark, [(1, "a2"), (4, "d")]), mart(spark, [(1, "a")]), ["id"], AS_OF, small_load=small
    )
    assert rows(found, "id", "val", "batch_id") == [(1, "a", 3), (4, "d", 7)]


def test_load_mart_chooses_by_dictionary(spark):
    some_keys = SourceTable("s", "t", (SourceColumn("id", "INTEGER", key=True), SourceColumn("val", "VARCHAR(5)")))
    all_keys = SourceTable("s", "t", (
        SourceColumn("id", "INTEGER", key=True), SourceColumn("val", "VARCHAR(5)", key=True),
    ))
    load, model = stage(spark, [(1, "b")]), mart(spark, [(1, "a")])
    assert rows(load_mart(load, model, some_keys, AS_OF), "id", "val") == [(1, "b")]
    assert rows(load_mart(load, model, all_keys, AS_OF), "id", "val") == [(1, "a"), (1, "b")]


def test_partitions_the_stage_does_not_reach_are_neither_read_nor_written(spark, plan, tmp_path):
    columns = "p string, id int, val string, batch_id int, insrt_dttm timestamp_ntz, updt_dttm timestamp_ntz, dump_dttm timestamp_ntz"
    model = [(p, i, "old", 3, OLD, None, OLD) for p in "abc" for i in range(3)] + [(None, 1, "old", 3, OLD, None, OLD)]
    root = str(tmp_path)
    layout = Layout(keys=("p", "id"), partition_by=("p",))
    mart = truncate_load(spark.createDataFrame(model, columns), root, "M", layout=layout)
    whole = rows(mart)
    stage = spark.createDataFrame(
        [("a", 1, "new", 7, AS_OF), ("d", 9, "new", 7, AS_OF), (None, 1, "new", 7, AS_OF)],
        "p string, id int, val string, batch_id int, dump_dttm timestamp_ntz",
    )
    table = SourceTable("s", "t", (
        SourceColumn("p", "VARCHAR(1)", key=True, partition=True), SourceColumn("id", "INTEGER", key=True),
        SourceColumn("val", "VARCHAR(5)"),
    ))
    before = last_commit(spark, root, "M")
    read = reached(spark, before, stage)
    assert [f.rpartition("=")[2] for f in read] == [NO_VALUE, "a"]
    expected = rows(load_mart(stage, mart, table, AS_OF, small_load=False))
    after = publish_load(spark, root, "M", stage, lambda part: apply_mart(stage, part, table, AS_OF))
    found = read_model(spark, root, "M")
    assert rows(found) == expected and len(expected) == len(whole) + 2
    assert set(before.model) & set(after.model) == {"VERSION=1/DEST=model/p=b", "VERSION=1/DEST=model/p=c"}
    assert "PartitionFilters: [" in plan(found.filter("p = 'b'"))


def test_keys_compare_as_the_dictionary_declares(spark):
    blind = SourceTable("s", "t", (
        SourceColumn("val", "VARCHAR(5)", key=True, case_blind=True), SourceColumn("id", "INTEGER"),
    ))
    load, model = stage(spark, [(9, "A"), (8, "b")]), mart(spark, [(1, "a")])
    assert rows(load_mart(load, model, blind, AS_OF), "val", "id") == [("a", 9), ("b", 8)]
    exact = SourceTable("s", "t", (SourceColumn("val", "VARCHAR(5)", key=True), SourceColumn("id", "INTEGER")))
    assert rows(load_mart(load, model, exact, AS_OF), "val") == [("A",), ("a",), ("b",)]
    assert rows(load_mart(load, model, exact, AS_OF, case_blind=True), "val") == [("a",), ("b",)]
    with pytest.raises(ValueError, match="type of every key"):
        merge_mart(load, model, ["val"], AS_OF, case_blind=True)


def test_a_mart_load_may_be_checked(spark):
    table = SourceTable("s", "t", (SourceColumn("id", "INTEGER", key=True), SourceColumn("val", "VARCHAR(5)")))
    with pytest.raises(CheckError, match="id: 1"):
        load_mart(stage(spark, [(None, "a")]), mart(spark, []), table, AS_OF, check=True)
    keys = SourceTable("s", "t", (SourceColumn("id", "INTEGER", key=True), SourceColumn("val", "VARCHAR(5)", key=True)))
    with pytest.raises(CheckError, match="not unique"):
        load_mart(stage(spark, [(1, "a"), (1, "a")]), mart(spark, []), keys, AS_OF, check=True)


def test_archive_keeps_repeats(spark):
    load = stage(spark, [(1, "a"), (1, "a")])
    assert append_archive(load, load).count() == 4


def test_checks(spark):
    table = SourceTable("s", "t", (
        SourceColumn("id", "INTEGER", key=True), SourceColumn("val", "VARCHAR(5)", nullable=False),
        SourceColumn("batch_id", "INTEGER"),
    ))
    good = stage(spark, [(1, "a"), (2, "b")])
    check_not_null(good, table)
    check_unique(good, ["id"])
    bad = stage(spark, [(1, None), (1, "b"), (None, "c")]).withColumn("batch_id", F.lit(None).cast("int"))
    with pytest.raises(CheckError, match="id: 1, val: 1"):
        check_not_null(bad, table)
    with pytest.raises(CheckError, match="'id': 1"):
        check_unique(bad, ["id"])
    assert rows(null_counts(bad, ["batch_id", "val"])) == [("batch_id", 3), ("val", 1)]
    assert rows(duplicate_keys(bad, ["id"])) == [(1, 2)]


def test_a_case_blind_merge_grows_with_the_tables(spark):
    from queries.mart import QUERIES

    small, large = (QUERIES["load_mart_case_blind_customers"](spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01"))
    assert large > 5 * small
