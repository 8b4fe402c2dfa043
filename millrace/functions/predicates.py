"""Comparisons the load operators are built from."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.types import ColumnType, sentinel

CASE_BLIND = "UTF8_LCASE"


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def any_null(columns: Iterable[Column]) -> Column:
    return any_of(c.isNull() for c in columns)


def folded(value: Column, ctype: ColumnType | None, case_blind: bool) -> Column:
    """Text compares ignoring case when asked to or declared so; everything else as it is."""
    if case_blind and ctype is None:
        raise ValueError("comparing without regard to case needs the type of every key")
    if ctype is not None and ctype.kind == "text" and (case_blind or ctype.blind):
        return F.collate(value, CASE_BLIND)
    return value


def canonical(value: Column) -> Column:
    """A text in the one form that all texts share which the case-blind collation holds equal.

    The collation takes each character's lower case by itself, and both forms of the small sigma as one; ``lower``
    looks at a sigma's place in the word, which the replacement undoes.
    """
    return F.translate(F.lower(value), "ς", "σ")


def sentinel_equal(left: Column, right: Column, ctype: ColumnType, case_blind: bool = False) -> Column:
    """Equality where NULL counts as the type's sentinel, so NULL equals the sentinel itself.

    Types without a sentinel compare null-safe.
    """
    stand_in = sentinel(ctype)
    if stand_in is None:
        return left.eqNullSafe(right)
    return folded(F.coalesce(left, stand_in), ctype, case_blind) == folded(
        F.coalesce(right, stand_in), ctype, case_blind
    )


def key_equal(
    left: str,
    right: str,
    keys: Iterable[str],
    types: dict[str, ColumnType] | None = None,
    case_blind: bool = False,
) -> Column:
    """Plain equality of key columns of two aliased tables; a NULL key matches nothing."""
    types = types or {}
    return all_of(
        folded(F.col(f"{left}.`{k}`"), types.get(k), case_blind)
        == folded(F.col(f"{right}.`{k}`"), types.get(k), case_blind)
        for k in keys
    )
