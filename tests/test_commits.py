"""Commits of published tables: several loads at once, changes instead of rewrites, packing and cleaning."""

import datetime as dt
import threading
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.functions.predicates import canonical
from millrace.operators.apply import apply_delete_insert, apply_insert, apply_upsert
from millrace.operators.checks import CheckError
from millrace.operators.history import apply_history
from millrace.operators.mart import apply_mart
from millrace.plans.spec import ColumnSpec, MappingSpec, SurrogateSpec
from millrace.plans.surrogates import publish_surrogates
from millrace.sources import commits
from millrace.sources.commits import CommitConflict, commit_at, reserve
from millrace.sources.dictionary import SourceColumn, SourceTable
from millrace.sources.publish import (
    Layout, Rules, clean_up, compact, last_commit, publish, publish_load, read_between, read_duplicates, read_model, reached,
    truncate_load,
)
from millrace.sources.store import create_once, files_below, names_in, read_text
from millrace.streaming.arrivals import arrivals, publish_arrivals

SPEC = MappingSpec(1, "T", "UPSERT", (ColumnSpec("ID", "INTEGER", pk=True), ColumnSpec("VAL", "VARCHAR(10)")))
CHANGES = Layout(buckets=4, keys=("ID",), changes=True)
LAYOUTS = [None, Layout(buckets=4, keys=("ID",)), CHANGES]


def load_of(spark, values, record=1):
    return spark.createDataFrame([(i, v, record) for i, v in values], "ID int, VAL string, R_ID int")


def upsert(load):
    return lambda model: apply_upsert(load, model, SPEC)


def test_a_file_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append((create_once(spark, path, f"é{i}"), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [i for won, i in made if won]
    assert len(winners) == 1 and read_text(spark, path) == f"é{winners[0]}"
    assert names_in(spark, f"{tmp_path}/a") == ["b.json"] and names_in(spark, f"{tmp_path}/none") == []


@pytest.mark.parametrize("layout", LAYOUTS)
def test_of_two_loads_from_one_commit_the_second_is_refused(spark, tmp_path, layout):
    root = str(tmp_path)
    truncate_load(load_of(spark, [(i, "a") for i in range(20)]), root, "T", layout=layout)
    base = last_commit(spark, root, "T")
    model = read_model(spark, root, "T", base)
    first, second = load_of(spark, [(1, "b"), (30, "n")]), load_of(spark, [(1, "c"), (31, "n")])
    results = [apply_upsert(load, model, SPEC) for load in (first, second)]
    publish(spark, root, "T", results[0], base=base)
    with pytest.raises(CommitConflict):
        publish(spark, root, "T", results[1], base=base)
    assert rows(read_model(spark, root, "T").filter("ID in (1, 30, 31)"), "ID", "VAL") == [(1, "b"), (30, "n")]
    assert last_commit(spark, root, "T").number == 2
    publish_load(spark, root, "T", second, upsert(second))  # made anew from what the first left
    assert rows(read_model(spark, root, "T").filter("ID in (1, 30, 31)"), "ID", "VAL") == [(1, "c"), (30, "n"), (31, "n")]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_loads_at_the_same_time_lose_no_row(spark, tmp_path, layout):
    root = str(tmp_path)
    truncate_load(load_of(spark, [(i, "a") for i in range(10)]), root, "T", layout=layout)
    loads = [load_of(spark, [(0, f"v{n}"), (100 + n, "new"), (5, "a")]) for n in range(3)]
    failed = []

    def run(load):
        try:
            publish_load(spark, root, "T", load, upsert(load), attempts=10)
        except Exception as error:  # shown by the assertion below
            failed.append(error)

    threads = [threading.Thread(target=run, args=(load,)) for load in loads]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    found = dict(rows(read_model(spark, root, "T"), "ID", "VAL"))
    assert len(found) == 13 and read_model(spark, root, "T").count() == 13
    assert found[0] in ("v0", "v1", "v2") and {100, 101, 102} <= set(found)
    assert read_duplicates(spark, root, "T").count() == 3
    assert last_commit(spark, root, "T").number == 4


def test_loads_of_other_keys_and_slices_are_added_after_each_other(spark, tmp_path):
    root = str(tmp_path)
    for table, layout in (("B", Layout(buckets=64, keys=("ID",))), ("C", replace(CHANGES, buckets=8))):
        truncate_load(load_of(spark, [(i, "a") for i in range(200)]), root, table, layout=layout)
        base = last_commit(spark, root, table)
        load = load_of(spark, [(7, "z")])
        # another load of another key commits between the making of a result and its publishing
        other = load_of(spark, [(8, "y")])
        made = []

        def apply(model, load=load, other=other, made=made, table=table):
            if not made:
                made.append(publish_load(spark, root, table, other, upsert(other)))
            return apply_upsert(load, model, SPEC)

        commit = publish_load(spark, root, table, load, apply, attempts=1)
        assert commit.number == base.number + 2
        assert rows(read_model(spark, root, table).filter("VAL <> 'a'"), "ID", "VAL") == [(7, "z"), (8, "y")]
    truncate_load(load_of(spark, [(1, "a")], 1).union(load_of(spark, [(2, "a")], 2)), root, "S", layout=Layout(partition_by=("R_ID",)))
    base = last_commit(spark, root, "S")
    model = read_model(spark, root, "S", base)
    for record in (1, 2):
        load = load_of(spark, [(10 * record, "n")], record)
        publish(spark, root, "S", apply_delete_insert(load, model, record), base=base)
    assert rows(read_model(spark, root, "S"), "ID", "VAL") == [(10, "n"), (20, "n")]


def test_a_load_from_changes_writes_only_what_it_changes(spark, tmp_path):
    root = str(tmp_path)
    values = [(i, "a") for i in range(5000)] + [(None, "n")] * 3
    for table, layout in (("F", Layout(buckets=4, keys=("ID",))), ("C", CHANGES)):
        truncate_load(load_of(spark, values), root, table, layout=layout)
    for load in ([(5, "b"), (6, "a"), (9000, "c"), (None, "q")], [(5, "d"), (9000, "c"), (9001, "e")], [(5, "d")]):
        frame = load_of(spark, load)
        for table in ("F", "C"):
            publish_load(spark, root, table, frame, upsert(frame))
    assert rows(read_model(spark, root, "F")) == rows(read_model(spark, root, "C"))
    assert rows(read_duplicates(spark, root, "F")) == rows(read_duplicates(spark, root, "C"))
    commit = last_commit(spark, root, "C")
    added = [f for f in (*commit.model, *commit.masked) if not f.startswith("VERSION=1/")]
    assert spark.read.parquet(*(f"{root}/C/data/{f}" for f in added)).count() == 2 + 2 + 2  # two updates, their masks, two new rows
    frame = load_of(spark, [(5, "x"), (9002, "new")])
    publish_load(spark, root, "C", frame, lambda model: apply_insert(frame, model, SPEC))
    assert rows(read_model(spark, root, "C").filter("ID in (5, 9002)"), "ID", "VAL") == [(5, "d"), (9002, "new")]


def test_a_shuffled_load_moves_and_sorts_nothing_of_the_table(spark, plan, tmp_path):
    root = str(tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        truncate_load(load_of(spark, [(i, "a") for i in range(1000)]), root, "T", layout=CHANGES)
        load = load_of(spark, [(i, "b") for i in range(0, 3000, 2)])
        publish_load(spark, root, "T", load, upsert(load))
        text = plan(apply_upsert(load, read_model(spark, root, "T"), SPEC).changes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange") == 1 and "Sort" not in text and "Bucketed: true" in text
    assert "Exchange" not in text[text.index("Bucketed: true"):]  # below the join's other side, the load's


def test_histories_and_marts_take_changes(spark, tmp_path):
    root, high = str(tmp_path), dt.date(9999, 12, 31)
    spec = MappingSpec(7, "H", "HISTORY", (
        ColumnSpec("K", "INTEGER", pk=True, role="HKEY"), ColumnSpec("A", "VARCHAR(5)", role="HCOL"),
        ColumnSpec("S", "DATE", role="S", source_table="JOB"), ColumnSpec("E", "DATE", role="E", source_table="JOB"),
    ))

    def versions(*values):
        return spark.createDataFrame(list(values), "K int, A string, S date, E date")

    days = [dt.date(2024, m, 1) for m in range(1, 6)]
    model = versions((1, "a", days[0], high), (2, "a", days[0], high), (2, "z", days[0], days[0]), (None, "n", days[0], high))
    truncate_load(model, root, "H", layout=Layout(buckets=3, keys=("K",), changes=True, masked_by=("E",)))
    truncate_load(model, root, "P")
    # twice on one day, so that two closed versions of a key end alike; an equal row; a new one
    for load in (versions((1, "b", days[1], high)), versions((1, "c", days[1], high)), versions((1, "d", days[1], high), (2, "a", days[2], high), (3, "n", days[2], high))):
        for table in ("H", "P"):
            publish_load(spark, root, table, load, lambda m, load=load: apply_history(load, m, spec))
    assert rows(read_model(spark, root, "H")) == rows(read_model(spark, root, "P"))
    assert rows(read_duplicates(spark, root, "H")) == rows(read_duplicates(spark, root, "P"))
    assert read_model(spark, root, "H").filter("K = 1").count() == 4
    packed = compact(spark, root, "H")
    assert len(packed.model) == 1 and not packed.masked and rows(read_model(spark, root, "H")) == rows(read_model(spark, root, "P"))

    at = dt.datetime(2024, 6, 1)
    table = SourceTable("s", "t", (SourceColumn("id", "INTEGER", key=True), SourceColumn("val", "VARCHAR(5)")))
    mart_columns = "id int, val string, batch_id int, insrt_dttm timestamp_ntz, updt_dttm timestamp_ntz, dump_dttm timestamp_ntz"
    first = spark.createDataFrame([(i, "o", 1, at, None, at) for i in (1, 2, 3, None)], mart_columns)
    truncate_load(first, root, "M", layout=Layout(buckets=2, keys=("id",), changes=True))
    truncate_load(first, root, "N")
    for load in ([(1, "x"), (9, "y"), (None, "z")], [(1, "w"), (2, "o")]):
        stage = spark.createDataFrame([(i, v, 2, at) for i, v in load], "id int, val string, batch_id int, dump_dttm timestamp_ntz")
        for name in ("M", "N"):
            publish_load(spark, root, name, stage, lambda mart, stage=stage: apply_mart(stage, mart, table, at))
    assert rows(read_model(spark, root, "M")) == rows(read_model(spark, root, "N"))


@pytest.mark.parametrize("layout", [None, Layout(buckets=2, keys=("ID",)), Layout(buckets=2, keys=("ID",), changes=True), Layout(partition_by=("VAL",))])
def test_many_inserts_are_packed_and_old_folders_deleted(spark, tmp_path, monkeypatch, layout):
    monkeypatch.setattr(commits, "WHOLE_EVERY", 3)
    root = str(tmp_path)
    truncate_load(load_of(spark, [(0, "x"), (-1, "")]), root, "T", layout=layout)
    for i in range(1, 6):
        load = load_of(spark, [(i, "xy"[i % 2]), (0, "x")])
        publish_load(spark, root, "T", load, lambda model, load=load: apply_insert(load, model, SPEC))
    before, many = last_commit(spark, root, "T"), rows(read_model(spark, root, "T"))
    doubles = rows(read_duplicates(spark, root, "T"))
    assert len(before.model) >= 6 and len(many) == 7
    packed = compact(spark, root, "T")
    assert len(packed.model) <= 4 and rows(read_model(spark, root, "T")) == many
    assert rows(read_duplicates(spark, root, "T")) == doubles and len(packed.duplicates) <= 2
    assert compact(spark, root, "T") == packed  # nothing is left to do
    assert rows(read_model(spark, root, "T", commit_at(spark, root, "T", 6))) == many
    assert clean_up(spark, root, "T") == []  # everything is younger than a week
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=30)
    gone = clean_up(spark, root, "T", now=later)
    assert set(before.model) - set(packed.model) <= set(gone)
    left = {parent for parent, _, _ in files_below(spark, f"{root}/T/data")}
    assert left == set(packed.model) | set(packed.duplicates)
    assert rows(read_model(spark, root, "T")) == many and last_commit(spark, root, "T").number == packed.number
    load = load_of(spark, [(50, "x")])
    publish_load(spark, root, "T", load, lambda model: apply_insert(load, model, SPEC))
    assert read_model(spark, root, "T").count() == 8


@pytest.mark.parametrize("layout", LAYOUTS)
def test_packing_and_loading_at_the_same_time(spark, tmp_path, layout, monkeypatch):
    root = str(tmp_path)
    truncate_load(load_of(spark, [(i, "a") for i in range(8)]), root, "T", layout=layout)
    for i in (20, 21):
        load = load_of(spark, [(i, "a")])
        publish_load(spark, root, "T", load, lambda model, load=load: apply_insert(load, model, SPEC))
    load, made = load_of(spark, [(1, "b"), (20, "c"), (40, "n")]), []

    def apply(model):
        if not made:
            made.append(compact(spark, root, "T"))  # moves the rows this load was made from
        return apply_upsert(load, model, SPEC)

    publish_load(spark, root, "T", load, apply)
    expected = sorted([(i, "b" if i == 1 else "a") for i in range(8)] + [(20, "c"), (21, "a"), (40, "n")])
    assert sorted(rows(read_model(spark, root, "T"), "ID", "VAL")) == expected
    # and the other way round: a load commits while rows are being packed
    for i in (60, 61):
        more = load_of(spark, [(i, "a")])
        publish_load(spark, root, "T", more, lambda model, more=more: apply_insert(more, model, SPEC))
    late = load_of(spark, [(1, "z"), (60, "y")])
    from millrace.sources import publish as module
    write, once = module._write, []

    def slow(*args):
        found = write(*args)
        if not once:
            once.append(1)
            publish_load(spark, root, "T", late, upsert(late))
        return found

    monkeypatch.setattr(module, "_write", slow)
    compact(spark, root, "T")
    found = dict(rows(read_model(spark, root, "T"), "ID", "VAL"))
    assert (found[1], found[60], found[61], len(found)) == ("z", "y", "a", 13) and read_model(spark, root, "T").count() == 13


def test_placing_agrees_with_the_collation_for_every_character(spark):
    each = spark.range(1, 0x110000).filter("id < 55296 OR id > 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    text = F.concat(F.lit("a"), F.col("c"))
    found = each.select(F.collate(text, "UTF8_LCASE").alias("same"), canonical(text).alias("place"))
    assert found.filter(F.col("same") != F.collate(F.col("place"), "UTF8_LCASE")).count() == 0
    assert found.groupBy("same").agg(F.countDistinct("place").alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("layout", [Layout(buckets=64, keys=("name",)), Layout(keys=("name",), partition_by=("name",)), Layout(buckets=8, keys=("name",), changes=True)])
def test_case_blind_keys_meet_wherever_they_are_placed(spark, tmp_path, layout):
    root, at = str(tmp_path), dt.datetime(2024, 6, 1)
    table = SourceTable("s", "t", (
        SourceColumn("name", "VARCHAR(20) NOT CASESPECIFIC", key=True), SourceColumn("val", "INTEGER"),
    ))
    names = ["ΑΣ", "ΟΔΟΣ", "Σ", "İX", "STRASSE", "É"]
    others = ["ας", "οδοσ", "ς", "i̇x", "strasse", "é"]
    mart_columns = "name string, val int, batch_id int, insrt_dttm timestamp_ntz, updt_dttm timestamp_ntz, dump_dttm timestamp_ntz"
    truncate_load(spark.createDataFrame([(n, 1, 1, at, None, at) for n in names], mart_columns), root, "M", layout=layout)
    stage = spark.createDataFrame([(n, 2, 2, at) for n in others], "name string, val int, batch_id int, dump_dttm timestamp_ntz")
    publish_load(spark, root, "M", stage, lambda mart: apply_mart(stage, mart, table, at))
    assert rows(read_model(spark, root, "M"), "name", "val") == sorted((n, 2) for n in names)


SGK = SurrogateSpec(
    record_id=1, entity="S_SGK", key="KEY", natural_key="NAT", natural_type="VARCHAR(10)", sgk_id=1, source="SRC",
    source_table="stage", source_column="nat",
)


def surrogate_tables(spark, root, values):
    schema = "KEY long, NAT string, SGK_ID short, R_ID int, B_ID long, INSRT_DTTM timestamp_ntz, UPDT_DTTM timestamp_ntz"
    at = dt.datetime(2024, 1, 1)
    truncate_load(spark.createDataFrame([(n, v, 1, 1, 1, at, at) for n, v in values], schema), root, "S")
    return spark.createDataFrame([(5, "SRC")], "B_ID long, B_SOURCE string")


def test_loads_at_the_same_time_give_different_surrogates(spark, tmp_path):
    root = str(tmp_path)
    log = surrogate_tables(spark, root, [(7, "known")])
    stages = [[f"{c}{i}" for i in range(20)] + ["shared", "known"] for c in "ab"]
    threads = [
        threading.Thread(target=publish_surrogates, args=(
            spark, root, "S", {"stage": spark.createDataFrame([(v,) for v in stage], "nat string")}, SGK, log,
            dt.datetime(2024, 6, 1), True,
        )) for stage in stages
    ]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = read_model(spark, root, "S").collect()
    keys = {r["NAT"]: r["KEY"] for r in found}
    assert len(found) == len(keys) == len(set(keys.values())) == 42  # "shared" once
    for c in "ab":
        mine = sorted((k for k in keys if k.startswith(c)), reverse=True)
        numbers = [keys[k] for k in mine]
        assert numbers == list(range(numbers[0], numbers[0] + 20)) and numbers[0] > 7


def test_reserved_numbers_are_never_given_twice(spark, tmp_path):
    root = str(tmp_path)
    surrogate_tables(spark, root, [(7, "known")])
    assert [reserve(spark, root, "S", 3, 7), reserve(spark, root, "S", 2, 7), reserve(spark, root, "S", 1, 50)] == [7, 10, 50]
    assert read_model(spark, root, "S").count() == 1


def test_a_batch_of_a_stream_is_taken_in_once(spark, tmp_path):
    root = f"{tmp_path}/tables"
    truncate_load(load_of(spark, [(1, "a")]), root, "T", layout=CHANGES)
    schema = "ID int, VAL string"
    for n, text in enumerate(("1,b\n2,c\n", "2,d\n3,e\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.csv").write_text(text)
        stream = arrivals(spark, f"{tmp_path}/in", "csv", ".csv", schema)
        publish_arrivals(
            stream, root, "T", f"{tmp_path}/progress", lambda rows_: rows_.select("ID", "VAL", F.lit(1).alias("R_ID")),
            lambda load, model: apply_upsert(load, model, SPEC),
        )
    assert rows(read_model(spark, root, "T"), "ID", "VAL") == [(1, "b"), (2, "d"), (3, "e")]
    last = last_commit(spark, root, "T")
    (source, epoch), = last.loads.items()
    again = load_of(spark, [(2, "d"), (3, "e")])
    assert publish_load(spark, root, "T", again, upsert(again), epoch=(source, epoch)).number == last.number
    assert read_duplicates(spark, root, "T").count() == 0


@pytest.mark.parametrize("layout", LAYOUTS)
def test_a_load_that_breaks_the_rules_of_its_table_is_not_committed(spark, tmp_path, layout):
    root = str(tmp_path)
    rules = Rules(required=("ID", "VAL"), unique=("ID",))
    truncate_load(load_of(spark, [(i, "a") for i in range(5)]), root, "T", layout=layout, rules=rules)
    for bad, said in (([(9, None)], "missing VAL: 1"), ([(9, "x"), (9, "y")], "repeated key: 1"), ([(None, "x")], "missing ID: 1")):
        load = load_of(spark, bad)
        result = apply_insert(load, read_model(spark, root, "T"), SPEC, check_keys=False, small_load=False)
        if None in bad[0][:1]:  # rows without a key never come this far in an insert
            result = replace(result, outcome=load.withColumn("DEST", F.lit("model")))
        with pytest.raises(CheckError, match=said):
            publish(spark, root, "T", result)
    assert last_commit(spark, root, "T").number == 1 and read_model(spark, root, "T").count() == 5
    good = load_of(spark, [(1, "b"), (7, "c")])
    commit = publish_load(spark, root, "T", good, upsert(good))
    assert commit.rules == rules and read_model(spark, root, "T").count() == 6
    with pytest.raises(CheckError, match="repeated key: 2"):
        truncate_load(load_of(spark, [(1, "a")] * 3), root, "T", layout=layout, rules=rules)


def test_loads_and_reads_pass_over_folders_out_of_range(spark, tmp_path):
    root, day = str(tmp_path), dt.date(2024, 1, 1)
    spec = MappingSpec(1, "T", "UPSERT", (
        ColumnSpec("D", "DATE", pk=True), ColumnSpec("N", "INTEGER", pk=True), ColumnSpec("VAL", "VARCHAR(10)"),
    ))

    def month(m, values):
        made = [(dt.date(2024, m, d), n, v) for d, n, v in values]
        return spark.createDataFrame(made, "D date, N int, VAL string")

    layout = Layout(keys=("D", "N"), ranges=("D", "N"))
    truncate_load(month(1, [(1, 1, "a"), (31, 9, "a")]), root, "T", layout=layout)
    for m in (2, 3, 4):
        load = month(m, [(1, 10 * m, "a"), (28, 10 * m + 9, "a")])
        publish_load(spark, root, "T", load, lambda model, load=load: apply_insert(load, model, spec))
    before = last_commit(spark, root, "T")
    assert len(before.model) == 4 and before.folders[before.model[0]].ranges == {"D": ["2024-01-01", "2024-01-31"], "N": ["1", "9"]}
    load = month(3, [(1, 30, "b"), (2, 31, "new")])
    assert reached(spark, before, load) == (before.model[2],)
    commit = publish_load(spark, root, "T", load, lambda model: apply_upsert(load, model, spec))
    assert set(before.model) - set(commit.model) == {before.model[2]}
    assert rows(read_model(spark, root, "T").filter("VAL <> 'a'"), "N", "VAL") == [(30, "b"), (31, "new")]
    march = read_between(spark, root, "T", "D", dt.date(2024, 3, 1), dt.date(2024, 3, 31))
    assert rows(march, "N") == [(30,), (31,), (39,)] and {f.split("VERSION=")[1][0] for f in march.inputFiles()} == {"5"}
    assert rows(read_between(spark, root, "T", "N", high=9), "N") == [(1,), (9,)]
    assert rows(read_between(spark, root, "T", "N", 100), "N") == [] and read_between(spark, root, "T", "D").count() == 9
    assert day in [r[0] for r in read_between(spark, root, "T", "D", high=day).select("D").collect()]
    # a load of other months is added after one that came between, a load of the same month is made anew
    base = last_commit(spark, root, "T")
    late, made = month(2, [(1, 20, "late")]), []

    def apply(model):
        if not made:
            other = month(4, [(1, 40, "other")])
            made.append(publish_load(spark, root, "T", other, lambda m: apply_upsert(other, m, spec)))
        return apply_upsert(late, model, spec)

    assert publish_load(spark, root, "T", late, apply, attempts=1).number == base.number + 2
    assert read_model(spark, root, "T").filter("VAL IN ('late', 'other')").count() == 2


@pytest.mark.parametrize("apply", [apply_upsert, apply_insert])
def test_a_load_may_give_its_table_another_layout(spark, tmp_path, apply):
    root = str(tmp_path)
    model = truncate_load(load_of(spark, [(i, "a") for i in range(9)]), root, "T")
    for n, layout in enumerate((CHANGES, Layout(buckets=2, keys=("ID",)), Layout(partition_by=("VAL",)), CHANGES)):
        load = load_of(spark, [(100 + n, "b"), (1, "a")])
        commit = publish(spark, root, "T", apply(load, model, SPEC), layout)
        model = read_model(spark, root, "T")
        assert commit.layout == layout and {f.split("/")[0] for f in commit.model} == {f"VERSION={n + 2}"}
        assert model.count() == 10 + n and model.filter("ID >= 100").count() == n + 1
    assert read_duplicates(spark, root, "T").count() == 4


def test_numbers_may_be_reserved_before_anything_is_published(spark, tmp_path):
    root = str(tmp_path)
    assert reserve(spark, root, "T", 5, 0) == 0
    with pytest.raises(FileNotFoundError):
        read_model(spark, root, "T")
    truncate_load(load_of(spark, [(1, "a")]), root, "T", layout=CHANGES)
    last = last_commit(spark, root, "T")
    assert (last.number, last.highest, last.layout) == (2, 5, CHANGES) and read_model(spark, root, "T").count() == 1
