"""The shape of the plans: what is shuffled, broadcast, pushed down and read."""

import re

import pytest

from millrace.operators.apply import apply_delete_insert, apply_insert, apply_upsert
from millrace.operators.history import apply_history
from millrace.operators.mart import merge_mart
from millrace.operators.windows import first_by
from millrace.plans.matching import broadcast_limit
from millrace.plans.spec import ColumnSpec, MappingSpec
from millrace.sources.tables import load_parquet, write_table
from queries import apply, history, keys, mart, transform

SF = "/root/testdata/sf0.001"
SPEC = MappingSpec(1, "T", "UPSERT", (ColumnSpec("ID", "BIGINT", pk=True), ColumnSpec("VAL", "VARCHAR(20)")))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def stored(spark, tmp_path):
    target, load = str(tmp_path / "target"), str(tmp_path / "load")
    spark.range(2000).selectExpr("id AS ID", "cast(id AS string) AS VAL", "cast(id % 3 AS int) AS R_ID").write.parquet(target)
    spark.range(1000, 3000).selectExpr("id AS ID", "cast(id % 7 AS string) AS VAL", "1 AS R_ID").write.parquet(load)
    return spark.read.parquet(load), spark.read.parquet(target)


QUERIES = {
    name: query
    for group in (apply, history, mart, keys, transform)
    for name, query in group.QUERIES.items()
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_everything_or_sorts_in_one_task(spark, plan, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line:  # only totals, already combined
            assert "Aggregate" in lines[at + 1], line
    assert not re.search(r"Window .*\], \[\]", text)


def test_a_small_load_leaves_the_target_in_place(plan, stored):
    load, target = stored
    text = plan(apply_upsert(load, target, SPEC).target)
    assert "BroadcastHashJoin" in text
    assert not re.search(r"Exchange hashpartitioning.*\n.*Project.*\n.*Filter.*\n.*FileScan parquet \[ID#\d+L,VAL#\d+,R_ID", text)


def test_the_threshold_of_the_session_decides(spark, plan, stored, no_broadcast):
    load, target = stored
    assert broadcast_limit(spark) == -1
    text = plan(apply_upsert(load, target, SPEC).target)
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 1
    for setting, size in (("10m", 10 << 20), ("10485760b", 10485760), ("1GB", 1 << 30), ("77", 77)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
        assert broadcast_limit(spark) == size


def test_an_upsert_shuffles_each_table_once(plan, stored):
    load, target = stored
    text = plan(apply_upsert(load, target, SPEC, small_load=False).outcome)
    assert text.count("Exchange") == 2


def test_a_bucketed_target_is_not_shuffled(spark, plan, stored, no_broadcast, tmp_path):
    load, target = stored
    write_table(target, "bucketed_model", bucket_by=(4, ["ID"]), path=str(tmp_path / "bucketed"))
    try:
        text = plan(apply_upsert(load, spark.table("bucketed_model"), SPEC, small_load=False).outcome)
        assert text.count("Exchange") == 1 and "Bucketed: true" in text
        merged = merge_mart(load, spark.table("bucketed_model"), ["ID"], small_load=False)
        assert plan(merged).count("Exchange") == 1
        assert apply_upsert(load, spark.table("bucketed_model"), SPEC, small_load=False).target.count() == 3000
    finally:
        spark.sql("DROP TABLE bucketed_model")


def test_an_insert_reads_only_compared_columns(plan, stored, no_broadcast):
    load, target = stored
    flagged = plan(apply_insert(load, target, SPEC).outcome)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", flagged)
    assert any(re.fullmatch(r"ID#\d+L,VAL#\d+", s) for s in scans)


def test_delete_insert_moves_nothing_and_pushes_the_record_id(plan, stored):
    load, target = stored
    text = plan(apply_delete_insert(load, target, 1).target, "formatted")
    assert "Exchange" not in text and "R_ID" in re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)


def test_closed_versions_are_read_apart_from_open_ones(spark, plan, tmp_path, no_broadcast):
    path = str(tmp_path / "versions")
    history.version_model(spark, SF).write.parquet(path)
    model = spark.read.parquet(path)
    result = apply_history(history.version_load(spark, SF), model, history.ORDER_VERSIONS, small_load=False)
    text = plan(result.outcome, "formatted")
    assert "EqualTo(ORD_END_DT,9999-12-31)" in text
    assert plan(result.outcome).count("Exchange hashpartitioning") == 2


def test_first_rows_are_cut_before_the_shuffle(plan, stored):
    _, target = stored
    text = plan(first_by(target, ["R_ID"], ["ID"]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_parquet_reads_are_pruned_and_pushed(spark, plan, stored, tmp_path):
    _, target = stored
    path = str(tmp_path / "again")
    target.write.partitionBy("R_ID").parquet(path)
    text = plan(load_parquet(spark, path, ["ID"], [("R_ID", [1]), ("VAL", ["1", "4"])]), "formatted")
    assert "ReadSchema: struct<ID:bigint,VAL:string>" in text
    assert re.search(r"PartitionFilters: \[.*R_ID", text) and re.search(r"PushedFilters: \[.*VAL", text)


def test_checks_count_before_they_shuffle(plan, spark):
    text = plan(apply.QUERIES["check_unique"](spark, SF))
    assert text.count("HashAggregate") == 2
