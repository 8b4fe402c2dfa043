"""Matching load rows with target rows on their keys, once, in the form that moves least data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import all_of, any_null, folded, key_equal
from millrace.functions.types import ColumnType

HASHED_LOAD = 64 << 20  # bytes of a load's share in a partition that may be held in memory
BROADCAST_SETTING = "spark.sql.autoBroadcastJoinThreshold"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}

_VARIABLE = (T.StringType, T.BinaryType)


class RepeatedKey(ValueError):
    """Several load rows for one target row."""


@dataclass(frozen=True)
class LoadFacts:
    """What is known of a load before it is matched: its size, a key it repeats, and how many of its
    rows meet a condition the caller asked for."""

    bytes: int = 0
    repeated: str | None = None
    limit: int = 0
    counted: int = 0
    is_small: bool | None = None

    @property
    def small(self) -> bool:
        """Whether the load may be broadcast: by its size, unless a caller has said so."""
        return self.bytes <= self.limit if self.is_small is None else self.is_small


def broadcast_limit(spark: SparkSession) -> int:
    """What may be sent whole to every executor: Spark's own threshold, negative for nothing."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(BROADCAST_SETTING).strip().lower()).groups()
    return int(number) * _UNITS[unit]


def row_bytes(df: DataFrame) -> Column:
    """Bytes a row takes in memory: a few words per column, plus texts, lists and structs as JSON text."""
    width = F.lit(16 + 16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _VARIABLE):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
    return width


def null_key(keys: Sequence[str]) -> Column:
    return any_null(F.col(f"`{k}`") for k in keys)


def _asked(condition: Column | None) -> Column:
    return F.lit(False) if condition is None else condition


def examine(
    load: DataFrame, keys: Sequence[str], types: dict[str, ColumnType] | None = None, case_blind: bool = False,
    counted: Column | None = None,
) -> LoadFacts:
    """Measure a load, look for repeated keys and count rows that meet a condition, in one pass over it.

    Rows are counted and summed per key before they are shuffled, so a key repeated very
    often costs no more than one repeated once; one row comes to the driver. Keys with a
    NULL match nothing and may repeat.
    """
    types = types or {}
    names = [f"key_{i}" for i in range(len(keys))]
    folded_keys = [folded(F.col(f"`{k}`"), types.get(k), case_blind).alias(n) for k, n in zip(keys, names)]
    groups = (
        load.select(*folded_keys, row_bytes(load).alias("bytes"), _asked(counted).alias("counted"))
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if("counted").alias("counted"))
    )
    shown = F.concat_ws(", ", *(F.col(n).cast("string") for n in names))
    row = groups.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.max(F.when((F.col("n") > 1) & ~null_key(names), shown)).alias("repeated"),
        F.coalesce(F.sum("counted"), F.lit(0)).alias("counted"),
    ).first()
    return LoadFacts(int(row["bytes"]), row["repeated"], broadcast_limit(load.sparkSession), row["counted"])


def size_of(load: DataFrame, counted: Column | None = None) -> LoadFacts:
    """Measure a load whose keys are known to be unique, and count rows that meet a condition."""
    total = F.coalesce(F.sum(row_bytes(load)), F.lit(0)).alias("bytes")
    row = load.agg(total, F.count_if(_asked(counted)).alias("counted")).first()
    return LoadFacts(int(row["bytes"]), limit=broadcast_limit(load.sparkSession), counted=row["counted"])


def need_unique(facts: LoadFacts, what: str) -> None:
    if facts.repeated is not None:
        raise RepeatedKey(f"{what}: several rows for the key {facts.repeated}")


def rows_of_interest(
    target: DataFrame,
    load: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    small: bool,
    types: dict[str, ColumnType] | None = None,
    case_blind: bool = False,
) -> DataFrame:
    """Key and compare columns of the target; cut down to the load's keys when the load is small.

    The cut is a semi join against the broadcast keys, so the target is scanned in place
    and only rows that can match go on to the join proper.
    """
    wanted = target.filter(~null_key(keys)).select(*dict.fromkeys([*keys, *columns]))
    if not small:
        return wanted
    known = load.filter(~null_key(keys)).select(*keys)
    return (
        wanted.alias("old")
        .join(F.broadcast(known.alias("new")), key_equal("old", "new", keys, types, case_blind), "left_semi")
        .select("old.*")
    )


HAS_OLD, HAS_NEW, WHICH = "__has_old", "__has_new", "__which"


@dataclass(frozen=True)
class Pairs:
    """Rows of two tables side by side, plain columns under their own prefixes."""

    rows: DataFrame

    @staticmethod
    def old(name: str) -> Column:
        return F.col(f"`__old_{name}`")

    @staticmethod
    def new(name: str) -> Column:
        return F.col(f"`__new_{name}`")

    @property
    def has_old(self) -> Column:
        return F.col(HAS_OLD).isNotNull()

    @property
    def has_new(self) -> Column:
        return F.col(HAS_NEW).isNotNull()

    def emitted(
        self, old_row: dict[str, Column], new_row: dict[str, Column], with_new: Column, **shared: Column
    ) -> DataFrame:
        """Each pair as up to two rows: what becomes of the old one, and the new one where ``with_new``.

        ``shared`` are columns both rows are built from, computed once per pair.
        """
        one, other = F.array(F.lit(0)), F.array(F.lit(1))
        which = (
            F.when(self.has_old & with_new, F.array(F.lit(0), F.lit(1))).when(self.has_old, one).when(with_new, other)
        )
        rows = self.rows.withColumns(shared).withColumn(WHICH, F.explode(which))
        return rows.select(
            *(F.when(F.col(WHICH) == 0, old).otherwise(new_row[c]).alias(c) for c, old in old_row.items())
        )


def _prefixed(df: DataFrame, prefix: str, marker: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns), F.lit(True).alias(marker))


def paired(
    target: DataFrame,
    load: DataFrame,
    keys: Sequence[str],
    small: bool,
    types: dict[str, ColumnType] | None = None,
    case_blind: bool = False,
) -> Pairs:
    """Every row of both tables once, matched by key.

    A small load is broadcast: the target is not shuffled, and the load's unmatched rows
    are found against the few target rows it can touch. Otherwise one full outer join
    shuffles each table once. Rows with a NULL key match nothing and skip the join, so
    they never pile up in one task.
    """
    types = types or {}

    def same_key(left: str, right: str) -> Column:
        return all_of(
            folded(F.col(f"`{left}{k}`"), types.get(k), case_blind)
            == folded(F.col(f"`{right}{k}`"), types.get(k), case_blind)
            for k in keys
        )

    old, new = _prefixed(target, "__old_", HAS_OLD), _prefixed(load, "__new_", HAS_NEW)
    no_old, no_new = null_key([f"__old_{k}" for k in keys]), null_key([f"__new_{k}" for k in keys])
    keyed_old, keyed_new = old.filter(~no_old), new.filter(~no_new)
    if small:
        pairs = keyed_old.join(F.broadcast(keyed_new), same_key("__old_", "__new_"), "left")
        known = _prefixed(load.select(*keys), "__key_", "__known").filter(~null_key([f"__key_{k}" for k in keys]))
        touched = keyed_old.select(*(F.col(f"`__old_{k}`") for k in keys)).join(
            F.broadcast(known), same_key("__old_", "__key_"), "left_semi"
        )
        unmatched = keyed_new.join(touched, same_key("__new_", "__old_"), "left_anti")
        pairs = pairs.unionByName(unmatched, allowMissingColumns=True)
    else:
        pairs = keyed_old.join(keyed_new, same_key("__old_", "__new_"), "full_outer")
    return Pairs(
        pairs.unionByName(old.filter(no_old), allowMissingColumns=True).unionByName(
            new.filter(no_new), allowMissingColumns=True
        )
    )


def met(
    target: DataFrame,
    load: DataFrame,
    keys: Sequence[str],
    facts: LoadFacts,
    types: dict[str, ColumnType] | None = None,
    case_blind: bool = False,
) -> Pairs:
    """Every load row with the target rows of its key; target rows that meet none are left out.

    A small load cuts the target down where it lies. Any other is dealt to the target's partitions, which
    stay as they are if the target is bucketed by the keys, and held in memory there if its share is
    small, so that neither side is sorted. Load rows with a NULL key meet nothing and skip the join.
    """
    types = types or {}

    def same_key(left: str, right: str) -> Column:
        return all_of(
            folded(F.col(f"`{left}{k}`"), types.get(k), case_blind)
            == folded(F.col(f"`{right}{k}`"), types.get(k), case_blind)
            for k in keys
        )

    old, new = _prefixed(target, "__old_", HAS_OLD), _prefixed(load, "__new_", HAS_NEW)
    keyed_old, no_new = old.filter(~null_key([f"__old_{k}" for k in keys])), null_key([f"__new_{k}" for k in keys])
    keyed_new = new.filter(~no_new)
    if facts.small:
        known = _prefixed(load.select(*keys), "__key_", "__known").filter(~null_key([f"__key_{k}" for k in keys]))
        keyed_old = keyed_old.join(F.broadcast(known), same_key("__old_", "__key_"), "left_semi")
    elif facts.bytes <= HASHED_LOAD * int(load.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        keyed_new = keyed_new.hint("shuffle_hash")
    pairs = keyed_new.join(keyed_old, same_key("__new_", "__old_"), "left")
    return Pairs(pairs.unionByName(new.filter(no_new), allowMissingColumns=True))


def changes_of(pairs: Pairs, rows: Sequence[tuple[Column, dict[str, Column]]], schema: T.StructType) -> DataFrame:
    """For each pair the rows whose condition holds, as one scan of the pairs.

    A row names its columns' values; columns it leaves out are NULL. ``schema`` says which columns there are.
    """
    wanted = F.array_compact(F.array(*(F.when(condition, F.lit(i)) for i, (condition, _) in enumerate(rows))))
    exploded = pairs.rows.withColumn(WHICH, F.explode(wanted))

    def value(f: T.StructField) -> Column:
        chosen = F.lit(None).cast(f.dataType)
        for i, (_, values) in enumerate(rows):
            if f.name in values:
                chosen = F.when(F.col(WHICH) == i, values[f.name].cast(f.dataType)).otherwise(chosen)
        return chosen.alias(f.name)

    return exploded.select(*(value(f) for f in schema.fields))
