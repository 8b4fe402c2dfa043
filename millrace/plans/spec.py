"""Mapping specs: which columns a load fills, from where, and what role each one plays."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from millrace.functions.types import ColumnType, parse_type

# Technical columns of every load-ready and model table.
RECORD_ID = "R_ID"
BATCH_ID = "B_ID"
INSERTED_AT = "INSRT_DTTM"
UPDATED_AT = "UPDT_DTTM"
TECHNICAL_COLUMNS = (RECORD_ID, BATCH_ID, INSERTED_AT, UPDATED_AT)
FLAG = "FLAG"
SURROGATE_SET = "SGK_ID"

# Load types, column roles and rule words of a mapping table.
INSERT = "INSERT"
UPSERT = "UPSERT"
HISTORY = "HISTORY"
HISTORY_LEGACY = "HISTORY_LEGACY"
DELETE_INSERT = "DELETE_INSERT"
HISTORY_DELETE_INSERT = "DELETE INSERT - HISTORY HANDLED"
LOAD_TYPES = (INSERT, UPSERT, HISTORY, HISTORY_LEGACY, DELETE_INSERT, HISTORY_DELETE_INSERT)
START, END, HISTORY_KEY, HISTORY_COLUMN = "S", "E", "HKEY", "HCOL"
SURROGATE_SUFFIX = "_SGK"

SPEC_COLUMNS = (
    "Record_ID", "Entity", "Column", "Datatype", "PK", "Historization_Column", "Load Type",
    "Source_System", "Stg_Schema", "Source_Table", "Source_Column", "Rule", "From_Rule",
    "Join_Rule", "Filter_Rule", "SPECIAL_HANDLING_FLAG",
)


class SpecError(ValueError):
    """A spec that cannot be run; the message names the record id."""


@dataclass(frozen=True)
class Join:
    """A declared join: table, its alias, the condition and how (left unless said otherwise)."""

    table: str
    on: str
    alias: str | None = None
    how: str = "left"


@dataclass(frozen=True)
class Lookup:
    """Look ``source`` up against the natural key of a surrogate table, within one SGK_ID.

    ``source`` is a SQL expression over the mapping's from and join tables.
    """

    source: str
    table: str
    natural_key: str
    sgk_id: int
    alias: str
    case_blind: bool = False


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    pk: bool = False
    role: str = ""
    source_table: str = ""
    source_column: str = ""
    rule: str = ""
    expr: str | None = None

    @property
    def ctype(self) -> ColumnType:
        return parse_type(self.type)


@dataclass(frozen=True)
class MappingSpec:
    """One mapping: the target columns of one record id and the load that applies them."""

    record_id: int
    entity: str
    load_type: str
    columns: tuple[ColumnSpec, ...]
    source: str = ""
    from_table: str = ""
    joins: tuple[Join, ...] = ()
    lookups: tuple[Lookup, ...] = ()
    where: str | None = None
    group_by: tuple[str, ...] = ()
    qualify: str | None = None
    special: bool = False
    case_blind: bool = False
    source_systems: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.load_type not in LOAD_TYPES:
            raise SpecError(f"record {self.record_id}: unknown load type {self.load_type!r}")

    @property
    def mapped(self) -> tuple[ColumnSpec, ...]:
        return tuple(c for c in self.columns if c.name.upper() not in TECHNICAL_COLUMNS)

    @property
    def types(self) -> dict[str, ColumnType]:
        return {c.name: c.ctype for c in self.columns}

    @property
    def primary_key(self) -> list[str]:
        keys = [c.name for c in self.mapped if c.pk]
        if not keys:
            raise SpecError(f"record {self.record_id}: no primary key column")
        return keys

    def _with_role(self, role: str) -> list[str]:
        return [c.name for c in self.mapped if c.role.upper() == role]

    def _one_with_role(self, role: str, meaning: str) -> str:
        found = self._with_role(role)
        if len(found) != 1:
            raise SpecError(f"record {self.record_id}: needs exactly one {meaning} column, has {found}")
        return found[0]

    @property
    def history_keys(self) -> list[str]:
        keys = self._with_role(HISTORY_KEY)
        if not keys:
            raise SpecError(f"record {self.record_id}: no history key column")
        return keys

    @property
    def history_columns(self) -> list[str]:
        columns = self._with_role(HISTORY_COLUMN)
        if not columns:
            raise SpecError(f"record {self.record_id}: no history column to compare")
        return columns

    @property
    def start(self) -> str:
        return self._one_with_role(START, "start date")

    @property
    def end(self) -> str:
        return self._one_with_role(END, "end date")

    @property
    def start_from_job(self) -> bool:
        start = self.start
        return any(c.name == start and c.source_table.upper() == "JOB" for c in self.columns)

    @property
    def job_start(self) -> str | None:
        """The first start column filled by the job; loads neither compare nor overwrite it."""
        for c in self.mapped:
            if c.source_table.upper() == "JOB" and "_STRT_" in c.name.upper():
                return c.name
        return None

    @property
    def compare_columns(self) -> list[str]:
        """Columns that decide whether an incoming row changed: no key, no job start date."""
        skip = {*self.primary_key, self.job_start}
        return [c.name for c in self.mapped if c.name not in skip]

    def spelled(self, names: dict[str, str]) -> MappingSpec:
        """The same spec with column names spelled as given by their upper case."""
        columns = tuple(replace(c, name=names.get(c.name.upper(), c.name)) for c in self.columns)
        return replace(self, columns=columns)

    def resolved(self) -> MappingSpec:
        """HISTORY whose start date does not come from the job is a history rebuild."""
        if self.load_type == HISTORY and not self.start_from_job:
            return replace(self, load_type=HISTORY_LEGACY)
        return self


@dataclass(frozen=True)
class SurrogateSpec:
    """A surrogate key table: its key, the natural key it stands for and where that comes from."""

    record_id: int
    entity: str
    key: str
    natural_key: str
    natural_type: str
    sgk_id: int
    source: str
    source_table: str
    source_column: str
    null_columns: tuple[str, ...] = ()
    joins: tuple[Join, ...] = ()
    where: str | None = None
    case_blind: bool = False


def check_spec_columns(columns: Iterable[str], required: Iterable[str] = SPEC_COLUMNS) -> None:
    missing = sorted(set(required) - set(columns))
    if missing:
        raise SpecError(f"the mapping table lacks the columns {missing}")


def _text(value: object) -> str:
    return "" if value is None else str(value).strip()


_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`")
_BRACKETED = re.compile(r"\([^()]*\)")
_PART = re.compile(r"^\s*WHERE\b|\bGROUP\s+BY\b|\bQUALIFY\b", re.IGNORECASE)


def _split_filter(rule: str) -> tuple[str | None, tuple[str, ...], str | None]:
    """The condition, grouping columns and window condition of a filter rule: ``[WHERE] condition``,
    ``GROUP BY columns`` and ``QUALIFY condition``, each at most once; words in quotes or brackets are part of a condition."""
    plain = _QUOTED.sub(lambda quoted: "_" * len(quoted[0]), rule)
    while _BRACKETED.search(plain):
        plain = _BRACKETED.sub(lambda inner: "_" * len(inner[0]), plain)
    parts, name, begin = {}, "WHERE", 0
    for found in _PART.finditer(plain):
        parts[name] = parts.get(name, "") + rule[begin:found.start()]
        name, begin = " ".join(found[0].upper().split()), found.end()
    parts[name] = parts.get(name, "") + rule[begin:]
    columns = tuple(c.strip() for c in parts.get("GROUP BY", "").split(",") if c.strip())
    return parts["WHERE"].strip() or None, columns, parts.get("QUALIFY", "").strip() or None


def specs_from_table(
    table: DataFrame,
    joins: dict[int, tuple[Join, ...]] | None = None,
    lookups: dict[int, tuple[Lookup, ...]] | None = None,
    exclude_sources: Iterable[str] = (),
    stage_schema: str | None = None,
    record_ids: Iterable[int] | None = None,
    case_blind: bool = False,
) -> list[MappingSpec]:
    """Specs of a mapping table, one row per target column (a few per table: metadata, not data).

    Record ids with a row from an excluded source system are left out whole, as are
    surrogate tables; joins and lookups are given by record id. An optional column
    ``Expression`` carries the SQL of rules that need one. Text compares ignoring case
    where its data type says NOT CASESPECIFIC, or everywhere with ``case_blind``.
    """
    check_spec_columns(table.columns)
    rows = defaultdict(list)
    for row in table.collect():
        rows[int(row["Record_ID"])].append(row.asDict())
    wanted = None if record_ids is None else set(record_ids)
    excluded = {s.upper() for s in exclude_sources}
    specs = []
    for record_id, lines in sorted(rows.items()):
        first = lines[0]
        if wanted is not None and record_id not in wanted:
            continue
        if stage_schema is not None and _text(first["Stg_Schema"]).upper() != stage_schema.upper():
            continue
        if any(_text(line["Source_System"]).upper() in excluded for line in lines):
            continue
        if _text(first["Entity"]).upper().endswith(SURROGATE_SUFFIX):
            continue
        where, group_by, qualify = _split_filter(_text(first["Filter_Rule"]))
        specs.append(
            MappingSpec(
                record_id=record_id,
                entity=_text(first["Entity"]),
                load_type=_text(first["Load Type"]).upper(),
                columns=tuple(
                    ColumnSpec(
                        name=_text(line["Column"]),
                        type=_text(line["Datatype"]),
                        pk=_text(line["PK"]).upper() == "PK",
                        role=_text(line["Historization_Column"]).upper(),
                        source_table=_text(line["Source_Table"]),
                        source_column=_text(line["Source_Column"]),
                        rule=_text(line["Rule"]),
                        expr=_text(line.get("Expression")) or None,
                    )
                    for line in lines
                ),
                source=_text(first["Stg_Schema"]),
                from_table=_text(first["From_Rule"]),
                joins=(joins or {}).get(record_id, ()),
                lookups=(lookups or {}).get(record_id, ()),
                where=where,
                group_by=group_by,
                qualify=qualify,
                special=_text(first["SPECIAL_HANDLING_FLAG"]).upper() == "Y",
                case_blind=case_blind,
                source_systems=tuple(sorted({_text(line["Source_System"]) for line in lines})),
            ).resolved()
        )
    return specs


def surrogates_from_table(
    table: DataFrame, joins: dict[int, tuple[Join, ...]] | None = None, case_blind: bool = False
) -> list[SurrogateSpec]:
    """Surrogate specs of a mapping table: rules SGK, NATURAL KEY, NULL or blank, and SGK_ID."""
    check_spec_columns(table.columns)
    rows = defaultdict(list)
    for row in table.collect():
        if _text(row["Entity"]).upper().endswith(SURROGATE_SUFFIX):
            rows[int(row["Record_ID"])].append(row)
    specs = []
    for record_id, lines in sorted(rows.items()):
        by_rule = {_text(line["Rule"]).upper(): line for line in lines}
        ids = [line for line in lines if _text(line["Column"]).upper() == SURROGATE_SET]
        if "SGK" not in by_rule or "NATURAL KEY" not in by_rule or not ids:
            raise SpecError(f"record {record_id}: needs the rules SGK and NATURAL KEY and a column SGK_ID")
        key, natural = by_rule["SGK"], by_rule["NATURAL KEY"]
        where, _, _ = _split_filter(_text(key["Filter_Rule"]))
        specs.append(
            SurrogateSpec(
                record_id=record_id,
                entity=_text(key["Entity"]),
                key=_text(key["Column"]),
                natural_key=_text(natural["Column"]),
                natural_type=_text(natural["Datatype"]),
                sgk_id=int(_text(ids[0]["Rule"])),
                source=_text(key["Stg_Schema"]),
                source_table=_text(key["Source_Table"]),
                source_column=_text(key["Source_Column"]),
                null_columns=tuple(
                    _text(line["Column"])
                    for line in lines
                    if _text(line["Rule"]).upper() in ("", "NULL")
                    and _text(line["Column"]).upper() not in (*TECHNICAL_COLUMNS, SURROGATE_SET)
                ),
                joins=(joins or {}).get(record_id, ()),
                where=where,
                case_blind=case_blind,
            )
        )
    return specs
