import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import key_equal, sentinel_equal
from millrace.functions.types import cast_to, end_before, high_value, load_time, parse_type


@pytest.mark.parametrize("text, spark_type, digits, length", [
    ("smallint", T.ShortType(), None, None),
    ("INTEGER", T.IntegerType(), None, None),
    ("bigint", T.LongType(), None, None),
    ("FLOAT", T.DoubleType(), None, None),
    ("DECIMAL(12,2)", T.DecimalType(12, 2), None, None),
    ("decimal( 9 )", T.DecimalType(9, 0), None, None),
    ("VARCHAR(20)", T.StringType(), None, 20),
    ("CHAR(3)", T.StringType(), None, 3),
    ("DATE", T.DateType(), None, None),
    ("TIMESTAMP", T.TimestampNTZType(), 6, None),
    ("TIMESTAMP(0)", T.TimestampNTZType(), 0, None),
    ("TIMESTAMP(3)", T.TimestampNTZType(), 3, None),
])
def test_parse_type(text, spark_type, digits, length):
    found = parse_type(text)
    assert (found.spark, found.digits, found.length) == (spark_type, digits, length)


def test_parse_type_refuses(spark):
    with pytest.raises(ValueError):
        parse_type("DECIMAL(1,2,3)")
    with pytest.raises(ValueError):
        parse_type("TIMESTAMP(9)")
    assert parse_type("BOOLEAN").kind == "other"


@pytest.mark.parametrize("text, high, before", [
    ("DATE", dt.date(9999, 12, 31), dt.date(2024, 2, 29)),
    ("TIMESTAMP(0)", dt.datetime(9999, 12, 31, 23, 59, 59), dt.datetime(2024, 2, 29, 23, 59, 59)),
    ("TIMESTAMP(1)", dt.datetime(9999, 12, 31, 23, 59, 59, 900000), dt.datetime(2024, 2, 29, 23, 59, 59, 900000)),
    ("TIMESTAMP(3)", dt.datetime(9999, 12, 31, 23, 59, 59, 999000), dt.datetime(2024, 2, 29, 23, 59, 59, 999000)),
    ("TIMESTAMP", dt.datetime(9999, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 2, 29, 23, 59, 59, 999999)),
])
def test_high_date_and_unit_before(spark, text, high, before):
    ctype = parse_type(text)
    start = F.lit("2024-03-01").cast(ctype.spark)
    row = spark.range(1).select(high_value(ctype).alias("high"), end_before(start, ctype).alias("before")).first()
    assert (row.high, row.before) == (high, before)


def test_end_dates_need_a_date_type():
    with pytest.raises(ValueError):
        high_value(parse_type("INTEGER"))


def test_casts_cut_text_and_fractions(spark):
    value = F.lit("1969-07-20 20:17:40.987654").cast("timestamp_ntz")
    row = spark.range(1).select(
        cast_to(F.lit("abcdef"), parse_type("VARCHAR(3)")).alias("text"),
        cast_to(value, parse_type("TIMESTAMP(0)")).alias("whole"),
        cast_to(value, parse_type("TIMESTAMP(2)")).alias("hundredths"),
        cast_to(F.lit(-1.9), parse_type("INTEGER")).alias("number"),
        load_time("2024-06-01 10:11:12.345678", "TIMESTAMP(3)").alias("now"),
        load_time("2024-06-01 10:11:12.345678", "DATE").alias("today"),
    ).first()
    assert row.text == "abc"
    assert row.whole == dt.datetime(1969, 7, 20, 20, 17, 40)
    assert row.hundredths == dt.datetime(1969, 7, 20, 20, 17, 40, 980000)
    assert row.number == -1
    assert row.now == dt.datetime(2024, 6, 1, 10, 11, 12, 345000)
    assert row.today == dt.date(2024, 6, 1)


@pytest.mark.parametrize("text, left, right, equal", [
    ("VARCHAR(5)", None, "-", True),
    ("VARCHAR(5)", None, None, True),
    ("VARCHAR(5)", "a", None, False),
    ("INTEGER", None, "-1", True),
    ("DECIMAL(5,2)", None, "-1", True),
    ("DECIMAL(5,2)", "0", None, False),
    ("DATE", None, "1001-01-01", True),
    ("TIMESTAMP", "1001-01-01 00:00:00", None, True),
    ("TIMESTAMP(3)", "2020-01-01 00:00:00", None, False),
    ("BOOLEAN", None, None, True),
    ("BOOLEAN", "true", None, False),
])
def test_sentinel_equality(spark, text, left, right, equal):
    ctype = parse_type(text)
    a, b = (F.lit(v).cast(ctype.spark) for v in (left, right))
    row = spark.range(1).select(sentinel_equal(a, b, ctype).alias("x"), sentinel_equal(b, a, ctype).alias("y")).first()
    assert (row.x, row.y) == (equal, equal)


def test_key_equality_is_plain(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string").alias("a")
    b = spark.createDataFrame([(1, "X"), (None, "Y")], "k int, v string").alias("b")
    assert a.join(b, key_equal("a", "b", ["k"])).count() == 1
    types = {"v": parse_type("VARCHAR(5)")}
    assert a.join(b, key_equal("a", "b", ["v"], types)).count() == 0
    assert a.join(b, key_equal("a", "b", ["v"], types, case_blind=True)).count() == 2
