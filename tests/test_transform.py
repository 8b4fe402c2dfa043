import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.apply import ApplyResult
from millrace.operators.clean import fill_missing, filter_in, rename_reserved, trim_text, truncate_floats
from millrace.operators.transform import const, run_transforms, transform
from millrace.operators.windows import qualify
from millrace.plans.run import run_load, run_mapping
from millrace.plans.spec import (
    SPEC_COLUMNS, ColumnSpec, Join, Lookup, MappingSpec, SpecError, _split_filter, specs_from_table,
    surrogates_from_table,
)

AS_OF = dt.datetime(2024, 6, 1, 9, 8, 7, 654321)


@pytest.fixture
def tables(spark):
    return {
        "s": spark.createDataFrame([(1, "x", "10", 5), (2, "y", "20", 5), (3, "x", "30", 6)], "id int, c string, n string, g int"),
        "d": spark.createDataFrame([(5, "five")], "g int, name string"),
        "D_SGK": spark.createDataFrame([(100, "x", 1), (200, "x", 2)], "K long, NAT string, SGK_ID int"),
    }


@pytest.fixture
def log(spark):
    return spark.createDataFrame([(4, "SRC"), (9, "SRC"), (70, "OTHER")], "B_ID long, B_SOURCE string")


def mapping(*columns, load_type="UPSERT", **more):
    return MappingSpec(3, "E", load_type, tuple(columns), source="SRC", from_table="s", **more)


def column(name, type_text, table="s", source="id", rule="1:1", **more):
    return ColumnSpec(name, type_text, source_table=table, source_column=source, rule=rule, **more)


def test_rules_in_their_order(tables, log):
    spec = mapping(
        column("ID", "BIGINT"), column("N", "DECIMAL(5,1)", source="n"),
        column("NOTHING", "VARCHAR(5)", "hcv", "hcv", "null"),
        column("FIXED", "VARCHAR(9)", "HCV", "HCV", "Set to 'it''s on'"),
        column("COUNTED", "SMALLINT", "HCV", "HCV", "HARDCODE TO 12"),
        column("THE_END_CD", "VARCHAR(9)", "HCV", "HCV", "SET TO e"),
        column("A_STRT_DT", "DATE", "JOB", "JOB", "anything"),
        column("ROLE_START", "TIMESTAMP(0)", "JOB", "JOB", "1:1", role="S", expr="timestamp_ntz'2000-01-01 00:00:00'"),
        column("AT", "TIMESTAMP", "ETL", "INSRT_DTTM"),
        column("FREE", "INTEGER", "s", "c", "twice the id", expr="s.id * 2"),
        column("R_ID", "INTEGER", "ETL", "R_ID", "tool"),
    )
    first = sorted(transform(spec, tables, log, AS_OF).collect())[0]
    assert first.asDict() == {
        "ID": 1, "N": 10, "NOTHING": None, "FIXED": "ITS ON", "COUNTED": 12, "THE_END_CD": "E",
        "A_STRT_DT": AS_OF.date(), "ROLE_START": dt.datetime(2000, 1, 1), "AT": AS_OF, "FREE": 2,
        "R_ID": 3, "B_ID": 9, "INSRT_DTTM": AS_OF, "UPDT_DTTM": AS_OF,
    }


def test_history_roles_count_only_in_history_loads(tables, log):
    start = column("BEGINS", "TIMESTAMP(0)", "JOB", "JOB", "job", role="S")
    end = column("ENDS", "TIMESTAMP(3)", "JOB", "JOB", "job", role="E")
    for load_type in ("HISTORY", "HISTORY_LEGACY", "DELETE INSERT - HISTORY HANDLED"):
        row = transform(mapping(column("ID", "BIGINT"), start, end, load_type=load_type), tables, log, AS_OF).first()
        assert (row.BEGINS, row.ENDS) == (AS_OF.replace(microsecond=0), dt.datetime(9999, 12, 31, 23, 59, 59, 999000))
    for broken in (start, end):
        with pytest.raises(SpecError, match="record 3: column"):
            transform(mapping(broken), tables, log, AS_OF)


def test_constant_end_columns_need_upsert(tables, log):
    end = column("X_END_CD", "VARCHAR(5)", "HCV", "HCV", "SET TO E")
    assert transform(mapping(end), tables, log, AS_OF).first().X_END_CD == "E"
    with pytest.raises(SpecError):
        transform(mapping(end, load_type="INSERT"), tables, log, AS_OF)


def test_bare_and_quoted_constants(spark):
    row = spark.range(1).select(
        const("1.9", "INTEGER").alias("cut"), const("-0.5", "FLOAT").alias("f"), const("2.345", "DECIMAL(5,2)").alias("d"),
        const("2020-02-03", "DATE").alias("day"),
    ).first()
    assert (row.cut, row.f, str(row.d), row.day) == (1, -0.5, "2.35", dt.date(2020, 2, 3))


def test_filters_groups_joins_and_lookups(tables, log):
    ids = column("ID", "BIGINT")
    assert rows(transform(mapping(ids, where="s.c = 'x'"), tables, log, AS_OF), "ID") == [(1,), (3,)]
    latest = "row_number() OVER (PARTITION BY s.c ORDER BY s.id DESC) = 1"
    assert rows(transform(mapping(ids, qualify=latest), tables, log, AS_OF), "ID") == [(2,), (3,)]
    grouped = mapping(
        column("G", "INTEGER", source="g"), column("NAME", "VARCHAR(9)", "d", "name"),
        where="c = 'x' OR id = 2", group_by=("g",), joins=(Join("d", "s.g = d.g"),),
    )
    assert rows(transform(grouped, tables, log, AS_OF), "G", "NAME") == [(5, "five"), (6, None)]
    inner = mapping(ids, joins=(Join("d", "s.g = other.g", alias="other", how="inner"),))
    assert rows(transform(inner, tables, log, AS_OF), "ID") == [(1,), (2,)]
    looked_up = mapping(
        ids, column("K", "BIGINT", "SGK2", "K"), lookups=(Lookup("s.c", "D_SGK", "NAT", 2, "SGK2"),),
    )
    assert rows(transform(looked_up, tables, log, AS_OF), "ID", "K") == [(1, 200), (2, None), (3, 200)]


def test_combined_run_applies_no_filters(tables, log):
    one, two = mapping(column("ID", "BIGINT"), where="s.c = 'x'"), mapping(column("ID", "BIGINT"))
    found = run_transforms([one, MappingSpec(4, "F", "INSERT", two.columns, from_table="s")], tables, log, AS_OF)
    assert {name: df.count() for name, df in found.items()} == {"E_R3": 3, "F_R4": 3}
    assert run_transforms([one], tables, log, AS_OF, apply_filters=True)["E_R3"].count() == 2


def test_batch_id_of_an_unknown_source_is_zero(spark, tables, log):
    spec = MappingSpec(3, "E", "UPSERT", (column("ID", "BIGINT"),), source="NONE", from_table="s")
    assert transform(spec, tables, log, AS_OF).first().B_ID == 0
    assert transform(spec, tables, log.limit(0), AS_OF).first().B_ID == 0


def spec_rows(record, entity, load_type, lines, source="SRC", stage="STG", filter_rule="", special="N"):
    return [
        (record, entity, name, kind, pk, role, load_type, source, stage, table, col, rule, "s", None, filter_rule, special)
        for name, kind, pk, role, table, col, rule in lines
    ]


SPEC_SCHEMA = ", ".join(f"`{c}` {'int' if c == 'Record_ID' else 'string'}" for c in SPEC_COLUMNS)


@pytest.fixture
def spec_table(spark):
    ids = ("ID", "BIGINT", "PK", "HKEY", "s", "id", "1:1")
    ends = ("E_DT", "DATE", "", "E", "JOB", "JOB", "open")
    return spark.createDataFrame(
        spec_rows(1, "E", "upsert", [ids], filter_rule="WHERE s.c = 'x'")
        + spec_rows(2, "H", "HISTORY", [ids, ("S_DT", "DATE", "", "s", "JOB", "JOB", "start"), ends])
        + spec_rows(3, "L", "HISTORY", [ids, ("S_DT", "DATE", "", "S", "s", "d", "1:1"), ends], stage="OTHER")
        + spec_rows(4, "E", "INSERT", [ids], source="Legacy_X")
        + spec_rows(5, "E", "INSERT", [ids], filter_rule="c = 'x' group by id, g", special="Y")
        + spec_rows(6, "E", "INSERT", [ids], filter_rule="qualify row_number() over (order by s.id) = 1")
        + spec_rows(9, "N_SGK", "INSERT", [
            ("N_ID", "BIGINT", "PK", "", "s", "c", "SGK"), ("SRC_KEY", "VARCHAR(9)", "", "", "s", "c", "Natural key"),
            ("FILL", "VARCHAR(9)", "", "", "", "", ""), ("SGK_ID", "SMALLINT", "", "", "", "", "7"),
            ("B_ID", "BIGINT", "", "", "", "", "NULL"),
        ], filter_rule="c <> 'q'"),
        SPEC_SCHEMA,
    )


def test_specs_from_a_table(spec_table):
    found = {s.record_id: s for s in specs_from_table(spec_table, exclude_sources=("LEGACY_X",))}
    assert sorted(found) == [1, 2, 3, 5, 6]
    assert (found[1].load_type, found[1].where, found[1].primary_key) == ("UPSERT", "s.c = 'x'", ["ID"])
    assert (found[2].load_type, found[2].start, found[2].end) == ("HISTORY", "S_DT", "E_DT")
    assert found[3].load_type == "HISTORY_LEGACY"
    assert (found[5].where, found[5].group_by, found[5].special) == ("c = 'x'", ("id", "g"), True)
    assert found[6].qualify == "row_number() over (order by s.id) = 1"
    assert [s.record_id for s in specs_from_table(spec_table, stage_schema="other")] == [3]
    assert [s.record_id for s in specs_from_table(spec_table, record_ids=[2, 6])] == [2, 6]
    assert 4 in [s.record_id for s in specs_from_table(spec_table)]
    assert all(s.case_blind for s in specs_from_table(spec_table, case_blind=True))


def test_filter_rules():
    assert _split_filter("WHERE a = 1 QUALIFY row_number() OVER (ORDER BY b) = 1") == (
        "a = 1", (), "row_number() OVER (ORDER BY b) = 1"
    )
    assert _split_filter("a = 'x qualify y' and b = 1 qualify count(*) filter (where c > 1) over () = 1") == (
        "a = 'x qualify y' and b = 1", (), "count(*) filter (where c > 1) over () = 1"
    )
    assert _split_filter("a = 1 GROUP BY b, c") == ("a = 1", ("b", "c"), None)
    assert _split_filter("") == (None, (), None)


def test_surrogate_specs_from_a_table(spec_table):
    (found,) = surrogates_from_table(spec_table)
    assert (found.key, found.natural_key, found.natural_type) == ("N_ID", "SRC_KEY", "VARCHAR(9)")
    assert (found.sgk_id, found.source_column, found.null_columns, found.where) == (7, "c", ("FILL",), "c <> 'q'")


def test_broken_specs_name_the_record(spec_table):
    with pytest.raises(SpecError, match="lacks the columns \\['Rule'\\]"):
        specs_from_table(spec_table.drop("Rule"))
    with pytest.raises(SpecError, match="record 8: unknown load type"):
        MappingSpec(8, "E", "MERGE", ())
    without_start = MappingSpec(8, "E", "HISTORY", (ColumnSpec("ID", "INTEGER", role="HKEY"),))
    with pytest.raises(SpecError, match="record 8: needs exactly one start date"):
        without_start.resolved()
    with pytest.raises(SpecError, match="record 8: no primary key"):
        without_start.primary_key


def test_run_load_dispatches_and_refuses(spark):
    ids = ColumnSpec("ID", "INTEGER", pk=True, role="HKEY")
    model = spark.createDataFrame([(1, 1)], "ID int, R_ID int")
    load = spark.createDataFrame([(2, 1)], "ID int, R_ID int")
    for load_type, expected in (("INSERT", [(1,), (2,)]), ("UPSERT", [(1,), (2,)]), ("DELETE_INSERT", [(2,)]),
                                ("DELETE INSERT - HISTORY HANDLED", [(2,)])):
        result = run_load(MappingSpec(1, "E", load_type, (ids,)), load, model)
        assert isinstance(result, ApplyResult) and rows(result.target, "ID") == expected
    special = MappingSpec(1, "E", "INSERT", (ids,), special=True)
    with pytest.raises(SpecError, match="special"):
        run_load(special, load, model)
    assert run_load(special, load, model, allow_special=True).target.count() == 2
    with pytest.raises(SpecError, match="excluded"):
        run_load(MappingSpec(1, "E", "INSERT", (ids,), source_systems=("Legacy_X",)), load, model, exclude_sources=("LEGACY_X",))
    with pytest.raises(SpecError, match="surrogate"):
        run_load(MappingSpec(1, "E_SGK", "INSERT", (ids,)), load, model)


def test_run_mapping_reads_stage_tables_once(tables, log, tmp_path):
    tables["s"].write.parquet(str(tmp_path / "s"))
    spec = mapping(column("ID", "BIGINT", pk=True), column("C", "VARCHAR(5)", source="c"))
    stored = tables | {"s": tables["s"].sparkSession.read.parquet(str(tmp_path / "s"))}
    model = transform(spec, tables, log, "2024-01-01").limit(0)
    result = run_mapping(spec, stored, model, log, "2024-01-01")
    read = result.outcome.inputFiles()
    assert read and not [f for f in read if str(tmp_path) in f] and result.target.count() == 3


def test_run_mapping_from_stage_to_history(tables, log):
    spec = mapping(
        column("ID", "BIGINT", pk=True, role="HKEY"), column("C", "VARCHAR(5)", source="c", role="HCOL"),
        column("S_DT", "DATE", "JOB", "JOB", "start", role="S"), column("E_DT", "DATE", "JOB", "JOB", "end", role="E"),
        load_type="HISTORY",
    )
    first = run_mapping(spec, tables, transform(spec, tables, log, "2024-01-01").limit(0), log, "2024-01-01").target
    assert first.count() == 3
    changed = tables | {"s": tables["s"].withColumn("c", F.lit("x"))}
    second = run_mapping(spec, changed, first, log, "2024-02-01").target
    assert rows(second, "ID", "C", "E_DT") == [
        (1, "x", dt.date(9999, 12, 31)), (2, "x", dt.date(9999, 12, 31)), (2, "y", dt.date(2024, 1, 31)),
        (3, "x", dt.date(9999, 12, 31)),
    ]


def test_qualify_with_several_windows(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, v int")
    kept = qualify(df, "row_number() over (partition by k order by v) = 1 and count(*) over (partition by k) > 1")
    assert rows(kept) == [(1, 1)]


def test_cleaning(spark):
    df = spark.createDataFrame([("  a b\t\r\n", 1.9, 1), (None, float("nan"), None), ("　", -1.9, 2)], "t string, f double, n int")
    assert rows(trim_text(df), "t") == [(None,), ("",), ("a b",)]
    assert rows(fill_missing(df), "t", "f") == rows(spark.createDataFrame([("  a b\t\r\n", 1.9), ("", None), ("　", -1.9)], "t string, f double"))
    assert rows(fill_missing(df, 0), "f", "n") == [(-1.9, 2), (0.0, 0), (1.9, 1)]
    assert rows(truncate_floats(df), "f") == [(None,), (-1,), (1,)]
    assert truncate_floats(df).schema["f"].dataType.simpleString() == "bigint"


def test_filters_in_lists(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(3000)], "n int, c string")
    assert filter_in(df, [("n", [1, 2, 3]), ("c", ["b"])]).count() == 2
    assert filter_in(df, [("n", list(range(2000)))]).count() == 2000
    assert filter_in(df.selectExpr("cast(n AS double) AS n"), [("n", list(range(2000)))]).count() == 2000
    assert filter_in(df, [("n", spark.createDataFrame([(7,), (7,), (None,)], "x int"))]).count() == 1
    assert filter_in(df, []).count() == 3000


def test_reserved_words(spark):
    words = spark.createDataFrame(
        [("T", "SELECT"), ("T", "DATE"), ("T", "DATE"), ("U", "NAME")], "`Reserved words source` string, `Reserved words` string"
    )
    df = spark.createDataFrame([("DATE", "NAME"), ("date", "SELECT"), (None, "x")], "a string, b string")
    assert rows(rename_reserved(df, words, "T", ["a", "b"])) == [(None, "x"), ("DATE_", "NAME"), ("date", "SELECT_")]
