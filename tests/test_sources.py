import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.apply import apply_delete_insert, apply_insert, apply_upsert
from millrace.operators.history import apply_history
from millrace.operators.mart import apply_mart
from millrace.plans.spec import ColumnSpec, MappingSpec, SpecError
from millrace.sources.dictionary import SourceColumn, SourceTable, derive_type, tables_from_dictionary
from millrace.sources.landed import read_landed, stage, text_schema
from millrace.sources.publish import (
    NO_VALUE, Layout, last_commit, publish, publish_load, read_duplicates, read_model, reached, truncate_load,
)
from millrace.sources.tables import (
    append_to, archive_to, load_parquet, read_archive, read_spec, save_parquet, write_table,
)
from millrace.streaming.arrivals import archive_arrivals, arrivals

TABLE = SourceTable("s", "t", (
    SourceColumn("id", "INTEGER", key=True), SourceColumn("Name", "VARCHAR(3)"), SourceColumn("at", "TIMESTAMP(0)"),
))
AS_OF = dt.datetime(2024, 6, 1, 7, 0, 0, 500)


@pytest.mark.parametrize("given, expected", [
    (("VARCHAR2", 10, None, None), "VARCHAR(20)"),
    (("NUMBER", 22, 12, 2), "DECIMAL(12,2)"),
    (("NUMBER", 22, 5, 0), "INTEGER"),
    (("NUMBER", 22, 18, 0), "BIGINT"),
    (("NUMBER", 22, 20, 0), "DECIMAL(20,0)"),
    (("NUMBER", 22, None, 0), "INTEGER"),
    (("CHAR", 4, None, None), "CHAR(4)"),
    (("RAW", 16, None, None), "VARCHAR(32)"),
    (("DATE", None, None, None), "DATE"),
    (("TIMESTAMP(6)", 11, None, 6), "TIMESTAMP(6)"),
])
def test_derived_types(given, expected):
    assert derive_type(*given, {"raw(16)": "varchar(32)"}) == expected


def test_dictionary(spark):
    lines = [
        ("A", "T", "id", "SRC", "NUMBER", "22", "", "0", "Y", "N", "N", "Y"),
        ("A", "T", "name", "SRC", "VARCHAR2", "5", "", "", "N", "N", "Y", "Y"),
        ("B", "T", "other", "SRC2", "DATE", "", "", "", "N", "Y", "N", "N"),
    ]
    columns = ["SCHEMA_NAME", "TABLE_NAME", "COLUMN_NAME", "Source System", "DATA_TYPE", "DATA_LENGTH", "DATA_PRECISION",
               "DATA_SCALE", "PRIMARY_KEY_FLAG", "NULLABILITY_FLAG", "UNICODE_FLAG", "TERADATA_PARTITION"]
    table = spark.createDataFrame(lines, ", ".join(f"`{c}` string" for c in columns))
    found = tables_from_dictionary(table)
    assert [c.name for c in found["A", "T"].columns] == ["id", "name"]
    assert (found["A", "T"].keys, found["A", "T"].required, found["A", "T"].partitions) == (["id"], ["id", "name"], ["id"])
    assert list(tables_from_dictionary(table, source_system="SRC2")) == [("B", "T")]
    with pytest.raises(SpecError):
        tables_from_dictionary(table.drop("DATA_TYPE"))


def test_landed_files_by_name_are_staged(spark, tmp_path):
    (tmp_path / "orders_1.csv").write_text("1,abcdef,2024-01-01 10:00:00.9\n2,,\n")
    (tmp_path / "orders_2.csv").write_text("3,x,2024-01-02 00:00:00\n")
    (tmp_path / "other.csv").write_text("9,y,2024-01-02 00:00:00\n")
    landed = read_landed(spark, str(tmp_path), "csv", "orders", text_schema(TABLE))
    staged = stage(landed, TABLE, 5, AS_OF)
    assert staged.columns == ["id", "Name", "at", "batch_id", "filename", "dump_dttm"]
    now = AS_OF.replace(microsecond=0)
    assert rows(staged) == [
        (1, "abc", dt.datetime(2024, 1, 1, 10), 5, "orders_1.csv", now), (2, None, None, 5, "orders_1.csv", now),
        (3, "x", dt.datetime(2024, 1, 2), 5, "orders_2.csv", now),
    ]
    with pytest.raises(ValueError, match="need a schema"):
        read_landed(spark, str(tmp_path), "csv")


def test_arrivals_are_archived_once(spark, tmp_path):
    landing, archive, progress = (str(tmp_path / n) for n in ("in", "archive", "progress"))
    (tmp_path / "in").mkdir()
    for batch, names in ((1, ["a_1"]), (2, ["a_2", "b_1"]), (3, [])):
        for name in names:
            (tmp_path / "in" / f"{name}.csv").write_text(f"{batch},{name},2024-01-01 00:00:00\n")
        archive_arrivals(arrivals(spark, landing, "csv", "a_", text_schema(TABLE)), TABLE, archive, progress, batch, AS_OF)
    assert rows(read_archive(spark, archive), "id", "filename", "batch_id") == [(1, "a_1.csv", 1), (2, "a_2.csv", 2)]
    taken = read_archive(spark, archive)
    taken = spark.createDataFrame(taken.collect(), taken.schema)
    archive_to(taken.withColumn("batch_id", F.lit(9)), archive)
    archive_to(taken, archive, "again")
    archive_to(taken.filter("batch_id = 1"), archive, "again")
    assert rows(read_archive(spark, archive), "id", "batch_id") == [(1, 1), (1, 1), (1, 9), (2, 2), (2, 9)]


def test_parquet_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, None, "p"), (2, "b", "q"), (3, "c", "p")], "n int, t string, part string")
    save_parquet(df, path, partition_by=["part"])
    save_parquet(df.limit(0), path, partition_by=["part"])
    assert rows(spark.read.parquet(path), "n", "t", "part") == [(1, "", "p"), (2, "b", "q"), (3, "c", "p")]
    assert rows(load_parquet(spark, path, ["n"], [("part", ["p"]), ("t", ["c", "b"])])) == [(3,)]
    append_to(df.filter("n = 2"), path, ["part"])
    assert spark.read.parquet(path).count() == 4
    other = str(tmp_path / "u")
    save_parquet(df, other, text_columns=["n"])
    assert rows(spark.read.parquet(other), "n", "t")[0] == ("1", None)


def test_partition_columns_keep_their_type_and_empty_texts(spark, tmp_path):
    path = str(tmp_path / "t")
    values = [(1, "01"), (2, ""), (3, None), (4, "\x01x"), (5, "a/b=c%")]
    df = spark.createDataFrame(values, "n int, part string")
    save_parquet(df, path, partition_by=["part"])
    assert rows(load_parquet(spark, path)) == [(1, "01"), (2, ""), (3, ""), (4, "\x01x"), (5, "a/b=c%")]
    assert rows(load_parquet(spark, path, ["n"], [("part", ["", "01"])])) == [(1,), (2,), (3,)]
    save_parquet(df.limit(0), path, partition_by=["part"], mode="overwrite")
    assert load_parquet(spark, path).count() == 0
    plain = str(tmp_path / "p")
    df.filter("n = 1").write.partitionBy("part").parquet(plain)
    assert rows(load_parquet(spark, plain)) == [(1, "01")]


def test_file_names_may_have_any_characters(spark, tmp_path):
    (tmp_path / "a[1]{x}.csv").write_text("1\n")
    (tmp_path / "a1x.csv").write_text("2\n")
    assert rows(read_landed(spark, str(tmp_path), "csv", "[1]{x}", "n int"), "n") == [(1,)]


def test_a_staged_row_may_be_required_to_be_whole(spark):
    landed = spark.createDataFrame([("1", "a", None), (None, "b", None)], "id string, Name string, at string")
    assert stage(landed, TABLE, 5, AS_OF).count() == 2
    with pytest.raises(Exception, match="missing values in id"):
        stage(landed, TABLE, 5, AS_OF, check=True).collect()


def test_a_bucket_is_one_file(spark, tmp_path):
    df = spark.range(1000).repartition(7).selectExpr("id AS k")
    write_table(df, "one_file", bucket_by=(4, ["k"]), path=str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.parquet"))) == 4
    spark.sql("DROP TABLE one_file")


def test_a_load_replaces_only_the_folders_it_reaches(spark, tmp_path):
    root = str(tmp_path)
    layout = Layout(buckets=8, keys=("ID",))
    truncate_load(load_of(spark, [(i, "a") for i in range(100)] + [(None, "n")]), root, "T", layout=layout)
    first = last_commit(spark, root, "T")
    load = load_of(spark, [(7, "b"), (200, "c")])
    folders = reached(spark, first, load)
    assert 1 <= len(folders) <= 2 < len(first.model) == 9
    commit = publish_load(spark, root, "T", load, lambda model: apply_upsert(load, model, SPEC))
    assert set(first.model) - set(folders) < set(commit.model) and not set(folders) & set(commit.model)
    expected = [(None, "n")] + [(i, "b" if i == 7 else "a") for i in range(100)] + [(200, "c")]
    assert rows(read_model(spark, root, "T"), "ID", "VAL") == sorted(expected, key=lambda r: [(v is not None, str(v)) for v in r])
    added = load_of(spark, [(7, "x"), (300, "d")])
    publish_load(spark, root, "T", added, lambda model: apply_insert(added, model, SPEC))
    assert read_model(spark, root, "T").count() == 103
    assert reached(spark, last_commit(spark, root, "T"), load_of(spark, [])) == ()


def test_published_partitions_are_pruned(spark, plan, tmp_path):
    root = str(tmp_path)
    rows_ = spark.createDataFrame([(1, "A"), (2, "B"), (3, "")], "id int, flag string")
    mart = truncate_load(rows_, root, "M", layout=Layout(keys=("flag", "id"), partition_by=("flag",)))
    assert rows(mart) == [(1, "A"), (2, "B"), (3, "")]
    text = plan(mart.filter("flag = 'A'"))
    assert "PartitionFilters: [" in text and "flag" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_specs_are_read_with_a_schema(spark, tmp_path):
    (tmp_path / "spec.csv").write_text('Key,Value\na,1\nb,\n"c\nd","2, 3"\n')
    assert rows(read_spec(spark, str(tmp_path), "Key string, Value string")) == [("a", "1"), ("b", ""), ("c\nd", "2, 3")]


def test_written_tables_are_bucketed_and_partitioned(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS k", "id % 3 AS p")
    write_table(df, "written", bucket_by=(4, ["k"]), partition_by=["p"], path=str(tmp_path / "w"))
    found = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED written").collect()}
    assert found["Num Buckets"] == "4" and spark.table("written").count() == 100
    write_table(df, "spread", partition_by=["p"], path=str(tmp_path / "s"))
    assert spark.table("spread").filter("p = 1").count() == 33
    spark.sql("DROP TABLE written")
    spark.sql("DROP TABLE spread")


SPEC = MappingSpec(1, "T", "UPSERT", (ColumnSpec("ID", "INTEGER", pk=True), ColumnSpec("VAL", "VARCHAR(10)")))


def load_of(spark, values, record=1):
    return spark.createDataFrame([(i, v, record) for i, v in values], "ID int, VAL string, R_ID int")


def test_publishing_shows_model_and_duplicates_together(spark, tmp_path):
    root = str(tmp_path)
    assert last_commit(spark, root, "T").number == 0
    with pytest.raises(FileNotFoundError):
        read_model(spark, root, "T")
    model = truncate_load(load_of(spark, [(1, "a"), (2, "b")]), root, "T")
    before = last_commit(spark, root, "T")
    publish(spark, root, "T", apply_upsert(load_of(spark, [(1, "a"), (2, "c"), (3, "d")]), model, SPEC))
    assert rows(read_model(spark, root, "T"), "ID", "VAL") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(read_duplicates(spark, root, "T"), "ID", "VAL") == [(1, "a")]
    assert rows(read_model(spark, root, "T", before), "ID", "VAL") == [(1, "a"), (2, "b")]

    added = apply_insert(load_of(spark, [(3, "d"), (4, "e")]), read_model(spark, root, "T"), SPEC)
    commit = publish(spark, root, "T", added)
    assert len(commit.model) == 2
    assert read_model(spark, root, "T").count() == 4
    assert rows(read_duplicates(spark, root, "T"), "ID") == [(1,), (3,)]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    model = truncate_load(load_of(spark, [(1, "a")]), root, "T")
    bad = load_of(spark, [(2, "b")]).withColumn("VAL", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        publish(spark, root, "T", apply_insert(bad, model, SPEC, check_keys=False, small_load=False))
    assert last_commit(spark, root, "T").number == 1
    publish(spark, root, "T", apply_insert(load_of(spark, [(3, "c")]), model, SPEC))
    assert rows(read_model(spark, root, "T"), "ID") == [(1,), (3,)]


def test_folders_of_a_replaced_record_id_are_dropped(spark, tmp_path):
    root = str(tmp_path)
    first = load_of(spark, [(1, "a")], 1).union(load_of(spark, [(2, "b")], 2)).union(load_of(spark, [(3, "n")], None))
    model = truncate_load(first, root, "T", layout=Layout(partition_by=("R_ID",)))
    commit = publish(spark, root, "T", apply_delete_insert(load_of(spark, [(9, "z")], 2), model, 2))
    assert commit.model == ("VERSION=1/DEST=model/R_ID=1", f"VERSION=1/DEST=model/R_ID={NO_VALUE}", "VERSION=2/DEST=model/R_ID=2")
    assert rows(read_model(spark, root, "T"), "ID") == [(1,), (3,), (9,)]
    publish(spark, root, "T", apply_delete_insert(load_of(spark, []), read_model(spark, root, "T"), 2))
    assert rows(read_model(spark, root, "T"), "ID") == [(1,), (3,)]


def test_a_load_may_empty_its_table(spark, tmp_path):
    root = str(tmp_path)
    truncate_load(load_of(spark, [(1, "a")]), root, "T")
    empty = truncate_load(load_of(spark, []), root, "T")
    assert empty.count() == 0 and empty.columns == ["ID", "VAL", "R_ID"]
    assert read_duplicates(spark, root, "T").count() == 0


def test_closed_versions_are_not_written_again(spark, tmp_path):
    root, high = str(tmp_path), dt.date(9999, 12, 31)
    spec = MappingSpec(7, "H", "HISTORY", (
        ColumnSpec("K", "INTEGER", pk=True, role="HKEY"), ColumnSpec("A", "VARCHAR(5)", role="HCOL"),
        ColumnSpec("S", "DATE", role="S", source_table="JOB"), ColumnSpec("E", "DATE", role="E", source_table="JOB"),
    ))

    def versions(*values):
        return spark.createDataFrame(list(values), "K int, A string, S date, E date")

    first, second, third = (dt.date(2024, m, 1) for m in (1, 2, 3))
    truncate_load(versions((1, "a", first, second), (1, "b", second, high), (2, "a", first, high)), root, "H")
    for at, value in ((third, "c"), (dt.date(2024, 4, 1), "d"), (dt.date(2024, 5, 1), "e")):
        publish(spark, root, "H", apply_history(versions((1, value, at, high)), read_model(spark, root, "H"), spec))
    assert rows(read_model(spark, root, "H")) == rows(versions(
        (1, "a", first, second), (1, "b", second, dt.date(2024, 2, 29)), (1, "c", third, dt.date(2024, 3, 31)),
        (1, "d", dt.date(2024, 4, 1), dt.date(2024, 4, 30)), (1, "e", dt.date(2024, 5, 1), high), (2, "a", first, high),
    ))
    commit = last_commit(spark, root, "H")
    assert commit.model == (
        "VERSION=2/DEST=final", "VERSION=3/DEST=final", "VERSION=4/DEST=final", "VERSION=4/DEST=model"
    )
    written = spark.read.parquet(f"{root}/H/data").groupBy("VERSION").count().collect()
    assert dict(map(tuple, written)) == {1: 3, 2: 4, 3: 3, 4: 3}


def test_a_merge_replaces_the_partitions_it_reaches(spark, tmp_path):
    root, at = str(tmp_path), dt.datetime(2024, 6, 1)
    table = SourceTable("s", "t", (
        SourceColumn("d", "DATE", key=True, partition=True), SourceColumn("id", "INTEGER", key=True),
        SourceColumn("val", "VARCHAR(5)"),
    ))
    mart_columns = "d date, id int, val string, batch_id int, insrt_dttm timestamp_ntz, updt_dttm timestamp_ntz, dump_dttm timestamp_ntz"
    days = [dt.date(2024, 1, n) for n in (1, 2, 3)]

    def stage_of(*values):
        return spark.createDataFrame(
            [(d, i, v, 2, at) for d, i, v in values], "d date, id int, val string, batch_id int, dump_dttm timestamp_ntz"
        )

    first = [(d, i, "old", 1, at, None, at) for d in days for i in (1, 2)] + [(None, 1, "old", 1, at, None, at)]
    layout = Layout(keys=("d", "id"), partition_by=("d",))
    truncate_load(spark.createDataFrame(first, mart_columns), root, "M", layout=layout)
    for load in (stage_of((days[1], 1, "new"), (days[1], 9, "add")), stage_of((days[2], 2, "new"), (None, 1, "null"))):
        commit = publish_load(spark, root, "M", load, lambda mart, load=load: apply_mart(load, mart, table, at))
    assert rows(read_model(spark, root, "M"), "d", "id", "val") == rows(spark.createDataFrame([
        (None, 1, "null"), (None, 1, "old"), (days[0], 1, "old"), (days[0], 2, "old"), (days[1], 1, "new"),
        (days[1], 2, "old"), (days[1], 9, "add"), (days[2], 1, "old"), (days[2], 2, "new"),
    ], "d date, id int, val string"))
    assert commit.model == (
        "VERSION=1/DEST=model/d=2024-01-01", "VERSION=2/DEST=model/d=2024-01-02",
        "VERSION=3/DEST=model/d=2024-01-03", f"VERSION=3/DEST=model/d={NO_VALUE}",
    )
    written = dict(map(tuple, spark.read.parquet(f"{root}/M/data").groupBy("VERSION").count().collect()))
    assert written == {1: 7, 2: 3, 3: 4}
    keys_only = SourceTable("s", "t", table.columns[:2])
    added = apply_mart(stage_of((days[0], 7, "x"), (days[0], 1, "x")), read_model(spark, root, "M"), keys_only, at)
    publish(spark, root, "M", added)
    assert read_model(spark, root, "M").count() == 10
