"""Declared column types and the values tied to them."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentinels standing in for NULL when two columns are compared,
# and the open end of a version.
NUMBER_SENTINEL = -1
TEXT_SENTINEL = "-"
DATE_SENTINEL = "1001-01-01"
TIMESTAMP_SENTINEL = "1001-01-01 00:00:00"
HIGH_DATE = "9999-12-31"
HIGH_TIME = "23:59:59"
DEFAULT_TIMESTAMP_DIGITS = 6

# Constants of these types are written bare in a rule, all others as text.
BARE_CONSTANT_TYPES = ("INTEGER", "BIGINT", "SMALLINT", "FLOAT")

_WHOLE_NUMBERS = {
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.DoubleType(),
}
NOT_CASESPECIFIC = " NOT CASESPECIFIC"
_CHARACTER_SET = re.compile(r" CHARACTER SET \w+$")
_DECLARED = re.compile(r"([A-Z][A-Z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?")


@dataclass(frozen=True)
class ColumnType:
    """A declared type: its text, the Spark type and what the text says beyond it."""

    text: str
    kind: str
    spark: T.DataType
    digits: int | None = None
    length: int | None = None
    blind: bool = False


def parse_type(text: str) -> ColumnType:
    """Read a declared type such as ``DECIMAL(12,2)``; a bare TIMESTAMP has six digits.

    Text declared NOT CASESPECIFIC compares ignoring case; a character set says nothing here.
    """
    declared = " ".join(text.upper().split())
    if declared.endswith(NOT_CASESPECIFIC):
        return replace(parse_type(declared.removesuffix(NOT_CASESPECIFIC)), blind=True)
    declared = _CHARACTER_SET.sub("", declared)
    match = _DECLARED.fullmatch(declared)
    if match is None:
        raise ValueError(f"cannot read the type {text!r}")
    base, first, second = match.groups()
    if base in _WHOLE_NUMBERS:
        return ColumnType(declared, "number", _WHOLE_NUMBERS[base])
    if base in ("DECIMAL", "NUMERIC"):
        precision, scale = int(first or 5), int(second or 0)
        return ColumnType(declared, "number", T.DecimalType(precision, scale))
    if base in ("CHAR", "VARCHAR"):
        return ColumnType(declared, "text", T.StringType(), length=int(first) if first else None)
    if base == "DATE":
        return ColumnType(declared, "date", T.DateType())
    if base == "TIMESTAMP":
        digits = DEFAULT_TIMESTAMP_DIGITS if first is None else int(first)
        if digits > 6:
            raise ValueError(f"a timestamp has at most six fraction digits: {text!r}")
        return ColumnType(f"TIMESTAMP({digits})", "timestamp", T.TimestampNTZType(), digits=digits)
    return ColumnType(declared, "other", T.DataType.fromDDL(declared))


def floor_timestamp(value: Column, digits: int) -> Column:
    """Drop the fraction digits of a timestamp beyond ``digits``."""
    if digits >= 6:
        return value
    unit = F.lit(f"{10.0**-digits:.{max(digits, 1)}f}").cast("decimal(8,6)")
    excess = F.date_part(F.lit("SECOND"), value) % unit
    return value - F.make_dt_interval(secs=excess.cast("decimal(18,6)"))


def cast_to(value: Column, ctype: ColumnType) -> Column:
    """CAST to a declared type: text is cut to its length, timestamps to their digits."""
    cast = value.cast(ctype.spark)
    if ctype.kind == "text" and ctype.length is not None:
        return F.substring(cast, 1, ctype.length)
    if ctype.kind == "timestamp":
        return floor_timestamp(cast, ctype.digits)
    return cast


def moment(as_of: dt.datetime | str | None = None) -> dt.datetime:
    """The load time, taken from the caller; the clock is read only when none is given."""
    if as_of is None:
        return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def load_time(as_of: dt.datetime | str | None, ctype: ColumnType | str = "TIMESTAMP(6)") -> Column:
    """Current date or timestamp of a load, at the precision of the type."""
    ctype = parse_type(ctype) if isinstance(ctype, str) else ctype
    return cast_to(F.lit(moment(as_of).isoformat(sep=" ")).cast("timestamp_ntz"), ctype)


def high_text(ctype: ColumnType) -> str:
    """The open end of a version: the last day, or its last moment with as many 9s as digits."""
    if ctype.kind == "date":
        return HIGH_DATE
    if ctype.kind != "timestamp":
        raise ValueError(f"an end date must be DATE or TIMESTAMP, not {ctype.text}")
    return f"{HIGH_DATE} {HIGH_TIME}" + ("." + "9" * ctype.digits if ctype.digits else "")


def high_value(ctype: ColumnType) -> Column:
    return F.lit(high_text(ctype)).cast(ctype.spark)


def end_before(start: Column, ctype: ColumnType) -> Column:
    """The last value of the type before ``start``: a day, or one unit of its last digit."""
    if ctype.kind == "date":
        return F.date_sub(start.cast("date"), 1)
    if ctype.kind != "timestamp":
        raise ValueError(f"an end date must be DATE or TIMESTAMP, not {ctype.text}")
    microseconds = 10 ** (6 - ctype.digits)
    return start.cast(ctype.spark) - F.expr(f"INTERVAL '{microseconds}' MICROSECOND")


def sentinel(ctype: ColumnType) -> Column | None:
    """The value a NULL of this type is compared as; None where the type has no such value."""
    if ctype.kind == "number":
        return F.lit(NUMBER_SENTINEL).cast(ctype.spark)
    if ctype.kind == "text":
        return F.lit(TEXT_SENTINEL)
    if ctype.kind == "date":
        return F.lit(DATE_SENTINEL).cast(ctype.spark)
    if ctype.kind == "timestamp":
        return F.lit(TIMESTAMP_SENTINEL).cast(ctype.spark)
    return None
