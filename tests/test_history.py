import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.history import apply_history, apply_history_auto, apply_history_legacy
from millrace.operators.windows import first_by, next_start, previous
from millrace.plans.matching import RepeatedKey
from millrace.plans.spec import ColumnSpec, MappingSpec, SpecError

HIGH = dt.date(9999, 12, 31)
SCHEMA = "K int, A string, B int, S date, E date, R_ID int, B_ID long, INSRT_DTTM timestamp_ntz, UPDT_DTTM timestamp_ntz"


def spec(*history_columns, types="DATE"):
    kinds = {"A": "VARCHAR(5)", "B": "INTEGER"}
    return MappingSpec(7, "H", "HISTORY", (
        ColumnSpec("K", "INTEGER", pk=True, role="HKEY"),
        *(ColumnSpec(c, kinds[c], role="HCOL") for c in history_columns),
        ColumnSpec("S", types, role="S", source_table="JOB"),
        ColumnSpec("E", types, role="E", source_table="JOB"),
    ))


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def table(spark, values, batch=1, at=dt.datetime(2024, 1, 1)):
    """Rows given as key, a, b, start, end[, batch]."""
    lines = []
    for v in values:
        k, a, b, s, e, *own = v
        lines.append((k, a, b, s, e, 7, own[0] if own else batch, at, at))
    return spark.createDataFrame(lines, SCHEMA)


@pytest.mark.parametrize("small", [True, False])
def test_close_and_insert(spark, small):
    target = table(spark, [
        (1, "a", 1, day(0), HIGH), (2, "a", 1, day(0), HIGH), (3, "a", 1, day(0), day(9)), (3, "b", 1, day(10), HIGH),
        (9, "a", 1, day(0), HIGH), (None, "n", 1, day(0), HIGH),
    ])
    load = table(spark, [
        (1, "a", 2, day(100), HIGH), (2, "z", 1, day(100), HIGH), (3, "a", 1, day(100), HIGH),
        (4, "n", 1, day(100), HIGH), (None, "q", 1, day(100), HIGH), (5, "q", 1, None, HIGH),
    ], batch=2, at=dt.datetime(2024, 6, 1))
    result = apply_history(load, target, spec("A"), small_load=small)
    assert rows(result.flagged, "K", "FLAG") == [(None, None), (1, "D"), (2, "U"), (3, "U"), (4, "I"), (5, None)]
    assert rows(result.duplicates, "K", "A", "B") == [(1, "a", 2)]
    assert rows(result.target, "K", "A", "S", "E", "B_ID") == [
        (None, "n", day(0), HIGH, 1),
        (1, "a", day(0), HIGH, 1),
        (2, "a", day(0), day(99), 2), (2, "z", day(100), HIGH, 2),
        (3, "a", day(0), day(9), 1), (3, "a", day(100), HIGH, 2), (3, "b", day(10), day(99), 2),
        (4, "n", day(100), HIGH, 2),
        (9, "a", day(0), HIGH, 1),
    ]
    closed = result.target.filter(F.col("K").eqNullSafe(2) & (F.col("E") != HIGH)).first()
    assert (closed.INSRT_DTTM, closed.UPDT_DTTM) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1))


def test_change_on_the_first_day_ends_before_it_starts(spark):
    target = table(spark, [(1, "a", 1, day(5), HIGH)])
    load = table(spark, [(1, "b", 1, day(5), HIGH)], batch=2)
    assert rows(apply_history(load, target, spec("A")).target, "A", "S", "E") == [
        ("a", day(5), day(4)), ("b", day(5), HIGH),
    ]


@pytest.mark.parametrize("types, gap", [
    ("TIMESTAMP(0)", dt.timedelta(seconds=1)), ("TIMESTAMP(3)", dt.timedelta(milliseconds=1)),
    ("TIMESTAMP", dt.timedelta(microseconds=1)),
])
def test_versions_in_time(spark, types, gap):
    from millrace.functions.types import high_value, parse_type

    columns = "K int, A string, S timestamp_ntz, B_ID long"
    end = high_value(parse_type(types)).alias("E")
    at = dt.datetime(2024, 6, 1, 12)
    target = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), 1)], columns).select("*", end)
    load = spark.createDataFrame([(1, "b", at, 2)], columns).select("*", end)
    found = apply_history(load, target, spec("A", types=types)).target
    assert found.filter("A = 'a'").first().E == at - gap


@pytest.mark.parametrize("small", [True, False])
def test_several_rows_of_a_key_in_one_load(spark, small):
    target = table(spark, [(1, "a", 1, day(0), HIGH), (2, "a", 1, day(0), HIGH)])
    load = table(spark, [
        (1, "a", 1, day(10), HIGH), (1, "b", 1, day(20), HIGH), (2, "a", 1, day(10), HIGH), (2, "a", 1, day(20), HIGH),
        (3, "n", 1, day(10), HIGH),
    ], batch=2)
    result = apply_history(load, target, spec("A"), small_load=small)
    assert rows(result.target, "K", "A", "S", "E") == [
        (1, "a", day(0), day(19)), (1, "b", day(20), HIGH), (2, "a", day(0), HIGH), (3, "n", day(10), HIGH),
    ]
    assert rows(result.duplicates, "K", "S") == [(1, day(10)), (2, day(10)), (2, day(20))]


@pytest.mark.parametrize("values", [
    [(1, "b", 1, day(10), HIGH), (1, "c", 1, day(20), HIGH)],
    [(5, "b", 1, day(10), HIGH), (5, "c", 1, day(20), HIGH)],
    [(1, "b", 1, day(10), HIGH), (1, "c", 1, day(10), HIGH)],
])
def test_two_new_versions_of_a_key_are_refused(spark, values):
    target = table(spark, [(1, "a", 1, day(0), HIGH)])
    with pytest.raises(RepeatedKey, match="record 7"):
        apply_history(table(spark, values), target, spec("A"))


@pytest.mark.parametrize("small", [True, False])
def test_rows_meet_the_version_of_their_own_end(spark, small):
    target = table(spark, [
        (1, "a", 1, day(0), day(9)), (1, "b", 1, day(10), HIGH), (2, "a", 1, day(0), day(9)), (3, "a", 1, day(0), None),
    ])
    load = table(spark, [
        (1, "x", 1, day(5), day(9)), (1, "b", 1, day(20), HIGH), (2, "a", 1, day(30), day(9)), (2, "q", 1, day(40), day(50)),
        (3, "a", 1, day(60), None), (4, "n", 1, day(70), None),
    ], batch=2)
    result = apply_history(load, target, spec("A"), small_load=small)
    assert rows(result.flagged, "K", "A", "FLAG") == [
        (1, "b", "D"), (1, "x", "U"), (2, "a", "D"), (2, "q", "I"), (3, "a", "I"), (4, "n", "I"),
    ]
    assert rows(result.target, "K", "A", "S", "E", "B_ID") == rows(table(spark, [
        (1, "a", 1, day(0), day(4), 2), (1, "b", 1, day(10), HIGH, 1), (1, "x", 1, day(5), day(9), 2),
        (2, "a", 1, day(0), day(9), 1), (2, "q", 1, day(40), day(50), 2), (3, "a", 1, day(0), None, 1),
        (3, "a", 1, day(60), None, 2), (4, "n", 1, day(70), None, 2),
    ]), "K", "A", "S", "E", "B_ID")
    assert rows(result.duplicates, "K", "S") == [(1, day(20)), (2, day(30))]


@pytest.mark.parametrize("seed", range(4))
def test_segments_give_what_a_plain_window_gives_with_missing_starts(spark, seed):
    rng = random.Random(seed)
    values = [(k, rng.choice("ab"), rng.randint(0, 2), start, HIGH) for k in range(3)
              for start in rng.sample([None, *(day(i) for i in range(9))], rng.randint(1, 9))]
    df = table(spark, values)
    for cut in (1, 2):
        assert rows(previous(df, ["A", "B"], ["K"], "S", hot_rows=cut)) == rows(previous(df, ["A", "B"], ["K"], "S"))
        high = F.lit(HIGH)
        assert rows(next_start(df, ["K"], "S", "N", high, hot_rows=cut)) == rows(next_start(df, ["K"], "S", "N", high))
    repeated = table(spark, values + rng.choices(values, k=6))
    model = table(spark, [(k, "z", 0, day(i), HIGH, 0) for k in range(3) for i in (0, 4)])
    plain = apply_history_legacy(repeated, model, spec("A", "B"))
    assert rows(apply_history_legacy(repeated, model, spec("A", "B"), hot_rows=1).target) == rows(plain.target)


def test_history_needs_its_roles(spark):
    target = table(spark, [(1, "a", 1, day(0), HIGH)])
    with pytest.raises(SpecError, match="record 7.*history column"):
        apply_history(target, target, spec()).flagged.collect()


def test_one_open_version_and_no_overlap_when_starts_grow(spark):
    rng = random.Random(5)
    model = table(spark, [(k, "a", 0, day(0), HIGH) for k in range(8)])
    for step in range(1, 4):
        load = table(spark, [
            (k, rng.choice("abc"), 0, day(step * 10), HIGH) for k in rng.sample(range(12), 8)
        ], batch=step + 1)
        model = apply_history(load, model, spec("A")).target
    by_key = defaultdict(list)
    for k, s, e in rows(model, "K", "S", "E"):
        by_key[k].append((s, e))
    for versions in by_key.values():
        assert sum(e == HIGH for _, e in versions) == 1
        ordered = sorted(versions)
        assert all(e == s - dt.timedelta(days=1) for (_, e), (s, _) in zip(ordered, ordered[1:]))


def test_rebuild_rules(spark):
    load = table(spark, [
        (1, "a", 0, day(0), HIGH), (1, "a", 0, day(31), HIGH), (1, "b", 0, day(60), HIGH), (1, None, 0, day(91), HIGH),
        (2, None, 0, day(0), HIGH), (2, "x", 0, day(31), HIGH), (3, "q", 0, day(0), HIGH),
    ])
    for hot_rows in (1_000_000, 1):
        found = apply_history_legacy(load, table(spark, []), spec("A"), hot_rows=hot_rows).target
        assert rows(found, "K", "A", "S", "E") == [
            (1, "a", day(0), day(60)), (1, "b", day(60), HIGH),
            (2, None, day(0), day(31)), (2, "x", day(31), HIGH), (3, "q", day(0), HIGH),
        ]


def test_rebuild_filter_over_several_columns(spark):
    """A row stays when all previous values are NULL or one differs; NULL on either side is no difference."""
    load = table(spark, [
        (1, "a", None, day(0), HIGH), (1, "a", 5, day(1), HIGH), (1, None, 6, day(2), HIGH), (1, None, None, day(3), HIGH),
        (1, "b", 7, day(4), HIGH),
    ])
    found = apply_history_legacy(load, table(spark, []), spec("A", "B")).target
    assert rows(found, "S") == [(day(0),), (day(2),), (day(4),)]


def test_rebuild_merges_rows_of_one_spot(spark):
    target = table(spark, [
        (1, "old", 0, day(0), HIGH, 5), (1, "kept", 0, day(50), HIGH, 5), (2, "tie", 0, day(0), HIGH, 3),
        (4, "far", 0, day(0), day(1), 1), (None, "n", 0, day(0), HIGH, 1),
    ])
    load = table(spark, [
        (1, "low", 0, day(0), HIGH, 1), (1, "high", 0, day(0), HIGH, 9), (2, "in", 0, day(0), HIGH, 3),
        (3, "nob", 0, day(0), HIGH, None), (3, "one", 0, day(0), HIGH, 1), (None, "n", 0, day(0), HIGH, 2),
    ])
    found = apply_history_legacy(load, target, spec("A")).target
    assert rows(found, "K", "A", "S", "E") == [
        (None, "n", day(0), HIGH), (None, "n", day(0), HIGH),
        (1, "kept", day(50), HIGH), (1, "low", day(0), HIGH),
        (2, "tie", day(0), HIGH), (3, "nob", day(0), HIGH), (4, "far", day(0), day(1)),
    ]


def rebuilt(load, target, columns):
    """Row by row, as the rules read."""
    spots = {(r["K"], r["S"]) for r in load if r["K"] is not None}
    untouched = [r for r in target if (r["K"], r["S"]) not in spots]
    merged = [(r, 1) for r in load] + [(r, 0) for r in target if (r["K"], r["S"]) in spots]
    best = {}
    for r, incoming in sorted(merged, key=lambda m: (m[0]["B_ID"], m[1])):
        best.setdefault((r["K"], r["S"]), r)
    by_key = defaultdict(list)
    for (k, _), r in sorted(best.items(), key=lambda i: (str(i[0][0]), i[0][1])):
        by_key[k].append(r)
    result = list(untouched)
    for versions in by_key.values():
        kept = []
        for i, r in enumerate(versions):
            before = [versions[i - 1][c] if i else None for c in columns]
            now = [r[c] for c in columns]
            differs = any(p is not None and n is not None and p != n for p, n in zip(before, now))
            if all(p is None for p in before) or differs:
                kept.append(r)
        for r, after in zip(kept, [*kept[1:], None]):
            result.append(r | {"E": after["S"] if after else HIGH})
    return sorted(((r["K"], r["A"], r["B"], r["S"], r["E"], r["B_ID"]) for r in result), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_rebuild_agrees_with_row_by_row_rules(spark, seed):
    rng = random.Random(seed)

    def some(n, batch):
        return [
            (rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([1, 2, None]),
             day(rng.randrange(30)), HIGH, batch + i)
            for i in range(n)
        ]

    load, target = table(spark, some(60, 100)), table(spark, some(30, 0 if seed else 200))
    expected = rebuilt([r.asDict() for r in load.collect()], [r.asDict() for r in target.collect()], ["A", "B"])
    for hot_rows in (1_000_000, 3):
        found = apply_history_legacy(load, target, spec("A", "B"), hot_rows=hot_rows).target
        assert sorted(rows(found, "K", "A", "B", "S", "E", "B_ID"), key=str) == expected


def test_first_run_rebuilds_later_runs_close(spark):
    first = table(spark, [(1, "a", 0, day(0), HIGH), (1, "b", 0, day(9), HIGH)])
    model = apply_history_auto(first, table(spark, []), spec("A"), initial=True).target
    assert rows(model, "A", "S", "E") == [("a", day(0), day(9)), ("b", day(9), HIGH)]
    later = apply_history_auto(table(spark, [(1, "c", 0, day(20), HIGH)]), model, spec("A"), initial=False).target
    assert rows(later, "A", "S", "E") == [("a", day(0), day(9)), ("b", day(9), day(19)), ("c", day(20), HIGH)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 1, 4, 50])
def test_neighbours_of_long_keys(spark, hot_rows):
    rng = random.Random(hot_rows)
    values = [(1, i, rng.choice("ab")) for i in rng.sample(range(500), 200)]
    values += [(k, i, rng.choice(["a", None])) for k in (2, 3, None) for i in range(k or 5)]
    df = spark.createDataFrame(values, "k int, n int, v string").withColumn("s", F.date_add(F.lit(day(0)), F.col("n")))
    by_key = defaultdict(list)
    for k, n, v in sorted(values, key=lambda r: r[1]):
        by_key[k].append((n, v))
    before = {(k, n): p for k, r in by_key.items() for (n, _), (_, p) in zip(r[1:], r)}
    after = {(k, n): day(m) for k, r in by_key.items() for (n, _), (m, _) in zip(r, r[1:])}
    found = previous(df, ["v"], ["k"], "s", hot_rows=hot_rows)
    assert {(r.k, r.n): r.PRE_v for r in found.collect()} == {(k, n): before.get((k, n)) for k, n, _ in values}
    found = next_start(df, ["k"], "s", "e", F.lit(HIGH), hot_rows=hot_rows)
    assert {(r.k, r.n): r.e for r in found.collect()} == {(k, n): after.get((k, n), HIGH) for k, n, _ in values}


def test_first_by(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 5)], "k int, v int")
    assert rows(first_by(df, ["k"], ["v"])) == [(1, 1), (2, 5)]
    assert rows(first_by(df, ["k"], [F.col("v").desc()], n=2)) == [(1, 2), (1, 3), (2, 5)]


def test_letter_case_of_names_does_not_matter(spark):
    target = table(spark, [(1, "a", 1, day(0), HIGH)])
    lower = target.toDF(*(c.lower() for c in target.columns))
    load = table(spark, [(1, "b", 1, day(10), HIGH)], batch=2)
    expected = [("a", day(0), day(9), 2), ("b", day(10), HIGH, 2)]
    assert rows(apply_history(load, lower, spec("A")).target, "a", "s", "e", "b_id") == expected
    several = load.union(table(spark, [(1, "a", 1, day(5), HIGH)], batch=2))
    assert rows(apply_history(several, lower, spec("A")).target, "a", "s", "e", "b_id") == expected
    assert rows(apply_history_legacy(load, lower, spec("A")).target, "a", "s", "e") == [("a", day(0), HIGH), ("b", day(10), HIGH)]
