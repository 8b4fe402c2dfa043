"""Source dictionary: the columns of the stage tables, their types and keys."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.types import ColumnType, parse_type
from millrace.plans.spec import check_spec_columns

# Audit columns of stage, archive and mart tables.
STAGE_BATCH, FILE_NAME, DUMPED_AT = "batch_id", "filename", "dump_dttm"
MART_INSERTED, MART_UPDATED = "insrt_dttm", "updt_dttm"
STAGE_AUDIT = (STAGE_BATCH, FILE_NAME, DUMPED_AT)
MART_AUDIT = (STAGE_BATCH, FILE_NAME, MART_INSERTED, MART_UPDATED, DUMPED_AT)

DICTIONARY_COLUMNS = (
    "SCHEMA_NAME", "TABLE_NAME", "COLUMN_NAME", "Source System", "DATA_TYPE", "DATA_LENGTH",
    "DATA_PRECISION", "DATA_SCALE", "PRIMARY_KEY_FLAG", "NULLABILITY_FLAG", "UNICODE_FLAG",
    "TERADATA_PARTITION",
)
CASE_BLIND_SOURCE = "VARCHAR2"  # fixed value: text of this source type is declared NOT CASESPECIFIC


@dataclass(frozen=True)
class SourceColumn:
    name: str
    type: str
    key: bool = False
    nullable: bool = True
    partition: bool = False
    case_blind: bool = False

    @property
    def ctype(self) -> ColumnType:
        found = parse_type(self.type)
        return replace(found, blind=True) if self.case_blind else found


@dataclass(frozen=True)
class SourceTable:
    schema: str
    name: str
    columns: tuple[SourceColumn, ...]

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.key]

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.key or not c.nullable]

    @property
    def partitions(self) -> list[str]:
        return [c.name for c in self.columns if c.key and c.partition]

    @property
    def types(self) -> dict[str, ColumnType]:
        return {c.name: c.ctype for c in self.columns}


def derive_type(
    data_type: str,
    length: int | None,
    precision: int | None,
    scale: int | None,
    type_map: Mapping[str, str] | None = None,
) -> str:
    """The declared type of a stage column, from its source type.

    A length alone makes ``TYPE(length)``, replaced by its entry in the type map; length and
    precision make ``TYPE(precision,scale)`` with NUMBER read as DECIMAL. NUMBER without a
    fraction becomes the smallest whole type its precision fits (INTEGER when none is given),
    VARCHAR2 a VARCHAR of twice the length.
    """
    source = data_type.strip().upper()
    declared = source
    if length is not None and "TIMESTAMP" not in source:
        if precision is None:
            declared = f"{source}({length})"
            known = {k.strip().upper(): v.strip().upper() for k, v in (type_map or {}).items()}
            declared = known.get(declared, declared)
        else:
            declared = f"{source}({precision},{scale or 0})".replace("NUMBER", "DECIMAL")
    if source == "NUMBER" and scale == 0:
        if precision is None or precision <= 9:
            declared = "INTEGER"
        else:
            declared = "BIGINT" if precision <= 18 else f"DECIMAL({precision},0)"
    if "VARCHAR2" in declared:
        declared = f"VARCHAR({(length or 0) * 2})" if length else "VARCHAR"
    return declared


def _number(value: object) -> int | None:
    return None if value is None or str(value).strip() == "" else int(float(str(value)))


def _yes(value: object) -> bool:
    return str(value or "").strip().upper() == "Y"


def tables_from_dictionary(
    dictionary: DataFrame, type_map: Mapping[str, str] | None = None, source_system: str | None = None
) -> dict[tuple[str, str], SourceTable]:
    """Source tables by schema and name; one dictionary row per column (metadata, not data)."""
    check_spec_columns(dictionary.columns, DICTIONARY_COLUMNS)
    found = defaultdict(list)
    if source_system is not None:
        dictionary = dictionary.filter(F.col("Source System") == source_system)
    for row in dictionary.collect():
        found[row["SCHEMA_NAME"], row["TABLE_NAME"]].append(
            SourceColumn(
                name=row["COLUMN_NAME"],
                type=derive_type(
                    row["DATA_TYPE"], _number(row["DATA_LENGTH"]), _number(row["DATA_PRECISION"]),
                    _number(row["DATA_SCALE"]), type_map,
                ),
                key=_yes(row["PRIMARY_KEY_FLAG"]),
                nullable=str(row["NULLABILITY_FLAG"] or "").strip().upper() != "N",
                partition=_yes(row["TERADATA_PARTITION"]),
                case_blind=str(row["DATA_TYPE"] or "").strip().upper() == CASE_BLIND_SOURCE,
            )
        )
    return {at: SourceTable(*at, tuple(columns)) for at, columns in found.items()}
