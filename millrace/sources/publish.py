"""Publishing a load: new model rows and duplicates become visible together.

Each load writes its rows as a version of their own and then adds a commit, naming the
folders that make up the table from now on. Readers follow the last commit, so they see all
of a load or none, and a load may read the folders it replaces.

A commit is refused if another load changed, since the commit this one was made from, what
this one read; :func:`publish_load` then makes the load anew. So loads of a table may run at the same time.

A table may have a layout, given when it is first published. With folders per bucket and partition,
:func:`publish_load` reads and replaces only the folders a load can reach. A delete-insert of a
table partitioned by record id drops the folders of that id. An insert adds folders. A
close-and-insert history leaves closed versions, which are stored apart, where they are.
With ``changes`` nothing is replaced: a load adds what it changes, and reading leaves out rows that a
later version masks. Without a layout, upserts, merges and rebuilds write the table anew.

:func:`compact` packs what many loads have added; :func:`clean_up` deletes what nothing refers to.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from decimal import Decimal
from urllib.parse import unquote as url_decoded

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import all_of, any_null, canonical
from millrace.operators.apply import DEST, DUPLICATES, MASKED, MODEL, ApplyResult
from millrace.operators.checks import CheckError
from millrace.sources.commits import (
    BUCKET, NO_VALUE, VERSION, Change, Commit, CommitConflict, Folder, Layout, Rules, changed, changes_since, claim_version,
    commit_at, committed_at, data_of, forget_commits, last_commit, try_commit, values_of,
)
from millrace.sources.store import delete, files_below
from millrace.sources.tables import named, unnamed

__all__ = [
    "NO_VALUE", "Commit", "CommitConflict", "Layout", "Rules", "clean_up", "compact", "last_commit", "publish", "publish_load",
    "read_between", "read_duplicates", "read_model", "reached", "truncate_load",
]

FINAL = "final"
SMALL_FOLDER = 64 << 20
HASHED_MASKS = 64 << 20  # bytes of masks a bucket may have to be held in memory while rows pass by
_KINDS = {MODEL: "model", FINAL: "model", DUPLICATES: "duplicates", MASKED: "masked"}
_registering = threading.Lock()


def _texts(schema: T.StructType, layout: Layout) -> list[str]:
    texts = {f.name.upper() for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return [c for c in layout.partition_by if c.upper() in texts]


def _observed(rows: DataFrame, rules: Rules) -> tuple[DataFrame, Observation | None]:
    """Rows that count, while they are written, how many model rows break a rule.

    Rows of a key stand together where they are dealt by key anyway; no pass over them is made for it.
    """
    model = F.col(DEST).isin(MODEL, FINAL)
    broken = {f"missing {c}": F.count_if(model & F.col(f"`{c}`").isNull()) for c in rules.required}
    if rules.unique:
        keys = [F.col(f"`{k}`") for k in rules.unique]
        whole = ~any_null(keys) & model
        nth = F.row_number().over(Window.partitionBy(*keys, model).orderBy(F.lit(1)))
        # rows without a key are no window: they would all be one
        counted = rows.filter(whole).withColumn("__nth", nth)
        rows = counted.unionByName(rows.filter(~F.coalesce(whole, F.lit(False))).withColumn("__nth", F.lit(1)))
        broken["repeated key"] = F.count_if(model & (F.col("__nth") > 1))
    if not broken:
        return rows, None
    seen = Observation()
    names = {f"n{i}": name for i, name in enumerate(broken)}
    seen.names = names
    return rows.observe(seen, *(c.alias(n) for n, c in zip(names, broken.values()))).drop("__nth"), seen


def _write(
    spark: SparkSession, root: str, table: str, rows: DataFrame, layout: Layout, least: int, order: int,
    rules: Rules = Rules(),
) -> dict:
    """Write rows tagged DEST as a version of their own; its folders by what they hold."""
    number = claim_version(spark, root, table, least)
    folder = f"{data_of(root, table)}/{VERSION}={number}"
    rows, seen = _observed(rows, rules)
    if layout.changes:
        keys = [F.col(f"`{k}`") for k in layout.keys]
        plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        # a NULL leaves a hash as it is: rows with a key go to their bucket's task, the others spread out
        spread = F.when(any_null(keys), F.xxhash64(*plain))
        name = f"millrace_{uuid.uuid4().hex}"
        rows.repartition(layout.buckets, *keys, spread).write.format("parquet").option("path", folder).partitionBy(
            DEST, *layout.names
        ).bucketBy(layout.buckets, *layout.keys).sortBy(*layout.keys).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay where they were written
    else:
        if layout.names:
            rows = rows.hint("rebalance", DEST, *layout.names)
        rows.write.mode("overwrite").partitionBy(DEST, *layout.names).parquet(folder)
    if seen is not None and any(seen.get.values()):
        delete(spark, folder)
        found = ", ".join(f"{seen.names[n]}: {count} rows" for n, count in seen.get.items() if count)
        raise CheckError(f"{table}: the load breaks the table's rules: {found}")
    return _listed(spark, root, table, number, order, layout)


def _ranges(spark: SparkSession, root: str, table: str, number: int, layout: Layout) -> dict[str, dict[str, list[str | None]]]:
    """The least and greatest values of the layout's ranges for each folder of a version, as text."""
    if not layout.ranges:
        return {}
    rows = spark.read.option("mergeSchema", "false").parquet(f"{data_of(root, table)}/{VERSION}={number}")
    at = F.regexp_extract(F.col("_metadata.file_path"), f".*/{VERSION}={number}/(.*)/[^/]*$", 1)
    ends = [end(F.col(f"`{c}`")).cast("string").alias(f"{n}_{i}") for i, c in enumerate(layout.ranges) for n, end in (("l", F.min), ("g", F.max))]
    found = rows.groupBy(at.alias("at")).agg(*ends).collect()
    return {
        url_decoded(row["at"]): {c: [row[f"l_{i}"], row[f"g_{i}"]] for i, c in enumerate(layout.ranges)} for row in found
    }


def _listed(
    spark: SparkSession, root: str, table: str, number: int, order: int, layout: Layout
) -> dict[str, dict[str, Folder]]:
    ranges = _ranges(spark, root, table, number, layout)
    totals: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for parent, size, _ in files_below(spark, f"{data_of(root, table)}/{VERSION}={number}"):
        at = totals[parent]
        at[0], at[1] = at[0] + size, at[1] + 1
    found: dict[str, dict[str, Folder]] = {}
    for parent, (size, files) in sorted(totals.items()):
        folder = f"{VERSION}={number}/{parent}" if parent else f"{VERSION}={number}"
        found.setdefault(_KINDS[values_of(folder)[DEST]], {})[folder] = Folder(order, size, files, ranges.get(parent, {}))
    return found


@dataclass(frozen=True)
class _Plan:
    """What a load writes and takes out, and how it depends on what it was made from."""

    rows: DataFrame
    schema: T.StructType
    final: str | None
    layout: Layout
    drops: Callable[[Commit], list[str]]
    reads: frozenset[str] | None  # folders it was made from; None for none, as it does not look at the table


def _plan(base: Commit, result: ApplyResult, layout: Layout | None, read: Iterable[str] | None, blind: bool) -> _Plan:
    whole = read is None
    folders = frozenset(base.model if whole else read)
    layout = (layout or Layout()) if base.schema is None or (whole and layout is not None) else base.layout
    final, rows = result.final if whole else base.final, result.outcome
    if not whole and (result.replaces is not None or (result.kept is not None and base.final != result.final)):
        raise ValueError("this load must be made from the whole table")

    def none(_: Commit) -> list[str]:
        return []

    def these(_: Commit) -> list[str]:
        return sorted(folders) if not whole else [*base.model, *base.masked]

    drops: Callable[[Commit], list[str]] = these
    reads: frozenset[str] | None = folders
    if blind:
        drops, reads = (lambda last: [*last.model, *last.masked]), None
    elif layout.changes and layout == base.layout and (result.changes is not None or result.appends):
        rows, final, drops = result.changes if result.changes is not None else rows, None, none
    elif result.appends and layout == base.layout:
        final, drops = base.final, none
    elif result.appends:  # a new layout: the rows there are are written anew
        rows = result.target.withColumn(DEST, F.lit(MODEL)).unionByName(
            result.duplicates.withColumn(DEST, F.lit(DUPLICATES)), allowMissingColumns=True
        )
    elif result.replaces is not None:
        column, values = result.replaces
        final = base.final
        if layout == base.layout and column.upper() in (c.upper() for c in base.layout.partition_by):
            reads = None
            drops = lambda last: [f for f in (*last.model, *last.masked) if _has(f, column, values)]
        else:
            rows = result.target.withColumn(DEST, F.lit(MODEL))
    elif result.kept is not None and base.final == final and layout == base.layout and not layout.changes:
        drops = lambda _: sorted(f for f in folders if values_of(f)[DEST] != FINAL)
    elif result.kept is not None:
        rows = rows.unionByName(result.kept.withColumn(DEST, F.lit(MODEL)), allowMissingColumns=True)
    if layout.changes:
        final = None
    schema = T.StructType([f for f in rows.schema.fields if f.name != DEST])
    if layout.changes:  # of a masked row only what tells it apart is written
        told = {c.upper() for c in (DEST, *layout.keys, *layout.masked_by, *layout.partition_by)}
        rows = rows.withColumns({
            f.name: F.when(F.col(DEST) != MASKED, F.col(f"`{f.name}`")) for f in schema.fields if f.name.upper() not in told
        })
    if final is not None:
        is_final = (F.col(DEST) == MODEL) & F.expr(final)
        rows = rows.withColumn(DEST, F.when(is_final, FINAL).otherwise(F.col(DEST)))
    if BUCKET in layout.names:
        rows = rows.withColumn(BUCKET, layout.bucket(schema))
    rows = rows.withColumns({c: named(F.col(f"`{c}`")) for c in _texts(schema, layout)})
    return _Plan(rows, schema, final, layout, drops, reads)


def _check(
    spark: SparkSession, root: str, table: str, plan: _Plan, base: Commit, last: Commit,
    touches: Callable[[list[str]], bool] | None,
) -> None:
    """Refuse a load if commits since its own have changed what it read."""
    if plan.reads is None:
        return
    drops = set(plan.drops(last))
    new: list[str] = []
    for change in changes_since(spark, root, table, base.number, last.number):
        gone = [f for f in change.dropped if f in (plan.reads if change.content else drops)]
        if gone:
            raise CommitConflict(f"{table}: another load replaced {gone[0]} meanwhile")
        if change.content:
            new += [f for kind in ("model", "masked") for f in change.added.get(kind, {})]
    # folders that came and went meanwhile were replaced by others of the same place
    new = [f for f in new if f in last.folders]
    if new and (touches is None or touches(new)):
        raise CommitConflict(f"{table}: another load added {new[0]} meanwhile")


def publish(
    spark: SparkSession, root: str, table: str, result: ApplyResult, layout: Layout | None = None,
    read: Iterable[str] | None = None, base: Commit | None = None,
    touches: Callable[[list[str]], bool] | None = None, epoch: tuple[str, int] | None = None, blind: bool = False,
    rules: Rules | None = None,
) -> Commit:
    """Write what a load makes, model rows and duplicates in one pass, and commit it.

    ``base`` is the commit the load was made from, the last one unless given. If others have committed
    since, the load is added after them as long as they left alone what it was made from; else
    it raises :class:`CommitConflict` and nothing of it is seen. ``read`` names the model folders it was made
    from, if not all, and ``touches`` tells of folders added meanwhile whether they may hold a key of the load;
    without it all may. ``blind`` loads look at nothing and replace everything.

    ``layout`` and ``rules`` count when the table is first published or written anew. Model rows that break a rule are
    found while they are written, and the load is refused. ``epoch``, a stream's name and
    the number of its batch, is kept with the commit.
    """
    base = base or last_commit(spark, root, table)
    plan = _plan(base, result, layout, read, blind)
    rules = rules if rules is not None and (base.schema is None or plan.layout is layout or blind) else base.rules
    added = _write(spark, root, table, plan.rows, plan.layout, base.number + 1, base.number + 1, rules)
    version = next((f.split("/")[0] for listed in added.values() for f in listed), None)
    last = base
    try:
        while True:
            _check(spark, root, table, plan, base, last, touches)
            order = last.number + 1
            listed = {kind: {f: replace(a, order=order) for f, a in folders.items()} for kind, folders in added.items()}
            drops = [f for f in plan.drops(last) if f in last.folders]
            set_ = replace(
                last, schema=plan.schema, final=plan.final, layout=plan.layout, rules=rules,
                loads=last.loads | ({epoch[0]: epoch[1]} if epoch else {}),
            )
            commit = try_commit(spark, root, table, set_, Change(listed, tuple(drops)))
            if commit is not None:
                return commit
            last = last_commit(spark, root, table)
    except CommitConflict:
        if version:
            delete(spark, f"{data_of(root, table)}/{version}")
        raise


def _has(folder: str, column: str, values: tuple[str, ...]) -> bool:
    return any(name.upper() == column.upper() and value in values for name, value in values_of(folder).items())


def reached(spark: SparkSession, commit: Commit, load: DataFrame) -> tuple[str, ...]:
    """The model folders that may hold a row of a key in the load.

    The load's buckets and partitions are matched with the table's folders; what comes to the
    driver are names of folders, which the commit lists anyway. Texts compare as they are placed.
    """
    layout = commit.layout
    commit = replace(commit, model=_in_range(commit, load))
    if not layout.reach or not commit.model:
        return commit.model
    kinds = {f.name.upper(): f.dataType for f in commit.schema.fields}

    def is_text(name: str) -> bool:
        return name != BUCKET and isinstance(kinds[name.upper()], T.StringType)

    def place(name: str) -> Column:
        if name == BUCKET:
            return layout.bucket(commit.schema).cast("string")
        value = F.col(f"`{name}`").cast(kinds[name.upper()])
        return canonical(named(value)) if is_text(name) else value.cast("string")

    def slot(folder: str) -> tuple:
        found = {k.upper(): v for k, v in values_of(folder).items()}
        return tuple(found[n.upper()] for n in layout.reach)

    at = [f"at_{i}" for i in range(len(layout.reach))]
    wanted = load.select(*(place(n).alias(a) for n, a in zip(layout.reach, at))).distinct()
    known = spark.createDataFrame(sorted({slot(f) for f in commit.model}, key=str), ", ".join(f"{a} string" for a in at))
    same = all_of(
        (canonical(F.col(f"k.{a}")) if is_text(n) else F.col(f"k.{a}")).eqNullSafe(F.col(f"w.{a}"))
        for n, a in zip(layout.reach, at)
    )
    hit = {tuple(row) for row in known.alias("k").join(wanted.alias("w"), same, "left_semi").collect()}
    return tuple(folder for folder in commit.model if slot(folder) in hit)


def _in_range(commit: Commit, load: DataFrame) -> tuple[str, ...]:
    """The model folders whose ranges meet those of the load's keys."""
    columns = [c for c in commit.layout.ranges if c.upper() in {k.upper() for k in commit.layout.keys}]
    if not columns or not commit.model:
        return commit.model
    kinds = {f.name.upper(): f.dataType for f in commit.schema.fields}
    typed = [F.col(f"`{c}`").cast(kinds[c.upper()]) for c in columns]
    row = load.agg(*(end(c).cast("string") for c in typed for end in (F.min, F.max))).first()
    spans = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    return tuple(f for f in commit.model if _meets(commit, f, spans))


def _meets(commit: Commit, folder: str, spans: dict[str, tuple[str | None, str | None]]) -> bool:
    """Whether a folder may hold a row with values in all spans; a span's open end is None if the other is not."""
    kinds = {f.name.upper(): f.dataType for f in commit.schema.fields}
    known = commit.folders[folder].ranges if folder in commit.folders else {}
    for c, (low, high) in spans.items():
        if c not in known:
            continue
        least, greatest = known[c]
        if least is None or (low is None and high is None):
            return False  # no value here, or none asked for
        value = Decimal if isinstance(kinds[c.upper()], T.NumericType) else str
        if (low is not None and value(greatest) < value(low)) or (high is not None and value(least) > value(high)):
            return False
    return True


def _holds_key_of(spark: SparkSession, root: str, table: str, commit: Commit, load: DataFrame) -> Callable[[list[str]], bool]:
    """Whether folders added since a commit may hold a key of the load: by their rows where changes are
    added, by their place else."""
    layout = commit.layout

    def ask(folders: list[str]) -> bool:
        now = last_commit(spark, root, table)
        if now.layout != layout:
            return True
        known = replace(now, model=tuple(folders))
        if not layout.changes:
            return bool(reached(spark, known, load))
        kinds = {f.name.upper(): f.dataType for f in now.schema.fields}

        def keys(df: DataFrame) -> list[Column]:
            typed = (F.col(f"`{k}`").cast(kinds[k.upper()]) for k in layout.keys)
            return [
                (canonical(c) if isinstance(kinds[k.upper()], T.StringType) else c).alias(f"key_{i}")
                for i, (k, c) in enumerate(zip(layout.keys, typed))
            ]

        rows = read_folders(spark, root, table, known, folders)
        names = [f"key_{i}" for i in range(len(layout.keys))]
        return not load.select(*keys(load)).join(rows.select(*keys(rows)), names, "left_semi").isEmpty()

    return ask


def publish_load(
    spark: SparkSession, root: str, table: str, load: DataFrame, apply: Callable[[DataFrame], ApplyResult],
    attempts: int = 5, epoch: tuple[str, int] | None = None,
) -> Commit:
    """Apply a load to the model rows in the folders it reaches, and replace those folders, or add its changes.

    ``apply`` makes the result from these rows, matching by the key of the table's layout. A load
    that needs the whole table, such as a delete-insert or the first one to store final rows
    apart, gets it. If another load commits first what this one depends on, this one is made anew
    from that commit, ``attempts`` times in all. A batch of a stream (``epoch``: its name and number) that was
    taken in before is left out.
    """
    for attempt in range(attempts):
        commit = last_commit(spark, root, table)
        if epoch and commit.loads.get(epoch[0], -1) >= epoch[1]:
            return commit
        touches = _holds_key_of(spark, root, table, commit, load) if commit.layout.keys else None
        try:
            folders = reached(spark, commit, load) if not commit.layout.changes else commit.model
            if len(folders) < len(commit.model):
                result = apply(read_folders(spark, root, table, commit, folders))
                first_final = result.kept is not None and commit.final != result.final
                if result.replaces is None and not first_final:
                    return publish(spark, root, table, result, read=folders, base=commit, touches=touches, epoch=epoch)
            result = apply(read_model(spark, root, table, commit))
            return publish(spark, root, table, result, base=commit, touches=touches, epoch=epoch)
        except CommitConflict:
            if attempt == attempts - 1:
                raise
    raise ValueError("a load needs at least one attempt")


def _column(f: T.StructField, layout: Layout) -> Column:
    """A column as it was before its values became names of folders."""
    found = F.col(f"`{f.name}`")
    cut = {c.upper() for c in layout.partition_by}
    return unnamed(found).alias(f.name) if f.name.upper() in cut and isinstance(f.dataType, T.StringType) else found


def read_folders(
    spark: SparkSession, root: str, table: str, commit: Commit, folders: Iterable[str], places: bool = False
) -> DataFrame:
    """The rows of some folders of a commit as they lie there, with ``places`` as they were tagged for writing."""
    fields = commit.schema.fields
    at = [T.StructField(VERSION, T.LongType()), T.StructField(DEST, T.StringType()), T.StructField(BUCKET, T.IntegerType())]
    alike: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for folder in folders:  # duplicates may be from a time when the table had another layout
        alike[tuple(values_of(folder))].append(folder)
    found = None
    for names, each in alike.items():
        rows = spark.read.schema(T.StructType([*fields, *at])).option("basePath", data_of(root, table)).parquet(
            *(f"{data_of(root, table)}/{folder}" for folder in each)
        )
        if places:
            more = [BUCKET] if BUCKET in commit.layout.names else []
            rows = rows.select(*(F.col(f"`{f.name}`") for f in fields), DEST, *more)
        else:
            rows = rows.select(*(_column(f, replace(commit.layout, partition_by=names[2:])) for f in fields))
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], commit.schema) if found is None else found


def _registered(spark: SparkSession, root: str, table: str, commit: Commit) -> str:
    """The folders of a commit as a bucketed table of the session's catalog, which holds names only.

    So Spark knows the buckets, and leaves out partitions without listing their files. The rank of a version takes
    the place of its number.
    """
    layout, data = commit.layout, data_of(root, table)
    seed = f"{spark.sparkContext.applicationId}:{data}:{commit.number}"
    name = f"millrace_{hashlib.sha256(seed.encode()).hexdigest()[:32]}"
    kinds = {f.name.upper(): f.dataType.simpleString() for f in commit.schema.fields}
    cut = {c.upper() for c in layout.partition_by}
    columns = [f"`{f.name}` {kinds[f.name.upper()]}" for f in commit.schema.fields if f.name.upper() not in cut]
    parts = [f"`{VERSION}` bigint", f"`{DEST}` string", *(f"`{c}` {kinds[c.upper()]}" for c in layout.partition_by)]
    keys = ", ".join(f"`{k}`" for k in layout.keys)

    def literal(value: str | None) -> str:
        return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def partition(folder: str) -> str:
        found = values_of(folder)
        spec = [f"`{VERSION}` = {commit.folders[folder].order}", *(f"`{c}` = {literal(found[c])}" for c in (DEST, *layout.partition_by))]
        return f"PARTITION ({', '.join(spec)}) LOCATION {literal(f'{data}/{folder}')}"

    with _registering:
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({', '.join([*columns, *parts])}) USING parquet "
                f"PARTITIONED BY ({', '.join(f'`{c}`' for c in (VERSION, DEST, *layout.partition_by))}) "
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout.buckets} BUCKETS LOCATION {literal(data)}"
            )
            folders = [*commit.model, *commit.masked]
            for begin in range(0, len(folders), 500):
                spark.sql(f"ALTER TABLE {name} ADD {' '.join(map(partition, folders[begin : begin + 500]))}")
    return name


def _unmasked(spark: SparkSession, root: str, table: str, commit: Commit) -> DataFrame:
    """The rows of a table that takes changes: those no later version has masked.

    Rows stay in their buckets. Masks of small total size are broadcast by Spark's own rule, others meet their
    bucket's rows, held in memory if a bucket's share is small, sorted else.
    """
    layout, name = commit.layout, _registered(spark, root, table, commit)
    rows = spark.table(name).filter(F.col(DEST) == MODEL)
    if commit.masked:
        marks = spark.table(name).filter(F.col(DEST) == MASKED).select(
            *(F.col(f"`{k}`") for k in (*layout.keys, *layout.masked_by)), VERSION
        )
        if sum(commit.folders[f].bytes for f in commit.masked) <= HASHED_MASKS * layout.buckets:
            marks = marks.hint("shuffle_hash")
        same = all_of(F.col(f"r.`{k}`") == F.col(f"m.`{k}`") for k in layout.keys)
        for c in layout.masked_by:  # not as an equality, so that the buckets' keys are all the join asks for
            one, other = F.col(f"r.`{c}`"), F.col(f"m.`{c}`")
            same = same & (((one >= other) & (one <= other)) | (one.isNull() & other.isNull()))
        rows = rows.alias("r").join(marks.alias("m"), same & (F.col(f"m.{VERSION}") > F.col(f"r.{VERSION}")), "left_anti")
    return rows.select(*(_column(f, layout) for f in commit.schema.fields))


def _known(root: str, table: str, commit: Commit) -> Commit:
    if not commit.schema:
        raise FileNotFoundError(f"nothing is published for {table} under {root}")
    return commit


def read_model(spark: SparkSession, root: str, table: str, commit: Commit | None = None) -> DataFrame:
    """The model table as of a commit, the last one unless given.

    Only folders that belong to the table are read; a filter on a partition column leaves out
    the folders of other values.
    """
    commit = _known(root, table, commit or last_commit(spark, root, table))
    if commit.layout.changes and commit.model:
        return _unmasked(spark, root, table, commit)
    return read_folders(spark, root, table, commit, commit.model)


def read_between(
    spark: SparkSession, root: str, table: str, column: str, low: object = None, high: object = None, commit: Commit | None = None
) -> DataFrame:
    """Model rows whose value of a column lies between two, both included; None leaves an end open.

    Folders that the commit knows to hold none are not even listed.
    """
    commit = _known(root, table, commit or last_commit(spark, root, table))
    ends = [None if v is None else spark.range(1).select(F.lit(v).cast(commit.schema[column].dataType).cast("string")).first()[0] for v in (low, high)]
    model = tuple(f for f in commit.model if (low is None and high is None) or _meets(commit, f, {column: tuple(ends)}))
    rows = read_model(spark, root, table, commit if commit.layout.changes else replace(commit, model=model))
    at = F.col(f"`{column}`")
    rows = rows if low is None else rows.filter(at >= F.lit(low))
    return rows if high is None else rows.filter(at <= F.lit(high))


def read_duplicates(spark: SparkSession, root: str, table: str, commit: Commit | None = None) -> DataFrame:
    """All duplicate rows set aside so far."""
    commit = _known(root, table, commit or last_commit(spark, root, table))
    return read_folders(spark, root, table, commit, commit.duplicates)


def truncate_load(
    df: DataFrame, root: str, table: str, final: str | None = None, layout: Layout | None = None, rules: Rules | None = None
) -> DataFrame:
    """Empty a table and fill it anew: readers switch when the new rows are complete.

    ``final`` stores the rows that meet a condition apart, as history loads do; ``layout``
    gives the table its folders and ``rules`` what must hold for its rows from now on.
    """
    nothing = df.filter(F.lit(False))
    result = ApplyResult(df, nothing, df, df.withColumn(DEST, F.lit(MODEL)), appends=False, final=final)
    commit = publish(df.sparkSession, root, table, result, layout, blind=True, rules=rules)
    return read_model(df.sparkSession, root, table, commit)


def compact(
    spark: SparkSession, root: str, table: str, small: int = SMALL_FOLDER, least: int = 2, attempts: int = 5
) -> Commit:
    """Pack what loads have added; the rows stay the same.

    Folders below ``small`` bytes of which a bucket and partition has ``least`` or more become one. A table that
    takes changes is written as one version without masks once a bucket and partition has that many versions.
    The commit changes no content: loads made meanwhile are added before or after it, unless they
    replace a folder it has moved, which are made anew; if a load replaced one of its folders, it is made anew itself.
    """
    for _ in range(attempts):
        commit = _known(root, table, last_commit(spark, root, table))
        slots = defaultdict(list)
        for folder in (*commit.model, *commit.duplicates):
            other = tuple(values_of(folder))[2:] != commit.layout.names  # of a time with another layout
            if commit.layout.changes or (commit.folders[folder].bytes < small and not other):
                slots[folder.partition("/")[2]].append(folder)
        chosen = [f for folders in slots.values() if len(folders) >= least for f in folders]
        if not chosen:
            return commit
        if commit.layout.changes:
            chosen = [*commit.model, *commit.duplicates, *commit.masked]
            rows = read_model(spark, root, table, commit).withColumn(DEST, F.lit(MODEL)).unionByName(
                read_duplicates(spark, root, table, commit).withColumn(DEST, F.lit(DUPLICATES))
            )
            rows = rows.withColumns({c: named(F.col(f"`{c}`")) for c in _texts(commit.schema, commit.layout)})
        else:
            rows = read_folders(spark, root, table, commit, chosen, places=True)
        # it ranks as the commit it was made from: masks of later loads hold for its rows
        added = _write(spark, root, table, rows, commit.layout, commit.number + 1, commit.number)
        last, gone = commit, False
        while not gone:
            packed = try_commit(spark, root, table, last, Change(added, tuple(chosen), content=False))
            if packed is not None:
                return packed
            last = last_commit(spark, root, table)
            gone = not set(chosen) <= set(last.folders) or last.layout != commit.layout
        for version in {f.split("/")[0] for listed in added.values() for f in listed}:
            delete(spark, f"{data_of(root, table)}/{version}")
    raise CommitConflict(f"{table}: loads kept replacing what was to be packed")


def clean_up(
    spark: SparkSession, root: str, table: str, keep: dt.timedelta = dt.timedelta(days=7), now: dt.datetime | None = None
) -> list[str]:
    """Delete folders that no commit of the last ``keep`` refers to, and older commit files; the folders' names.

    The last commit always stays whole. Folders changed within ``keep`` stay too: a load may be writing
    them, so ``keep`` must be longer than any load and any reader takes.
    """
    before = (now or dt.datetime.now(dt.timezone.utc)) - keep
    times = committed_at(spark, root, table)
    if not times:
        return []
    first = max((n for n, at in times if at < before), default=times[0][0])
    last = times[-1][0]
    used: set[str] = set()
    state = commit_at(spark, root, table, first)
    used |= set(state.folders)
    for change in changes_since(spark, root, table, first, last):
        state = changed(state, change)
        used |= set(state.folders)
    data, newest = data_of(root, table), {}
    for parent, _, at in files_below(spark, data):
        newest[parent] = max(newest.get(parent, 0), at)
    gone = sorted(f for f, at in newest.items() if f not in used and at < before.timestamp() * 1000)
    for folder in gone:
        delete(spark, f"{data}/{folder}")
    if first > times[0][0]:
        forget_commits(spark, root, table, first)
    return gone
