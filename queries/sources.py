"""Landing, staging, writing and publishing: each query writes a table and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators.apply import apply_delete_insert, apply_insert, apply_upsert
from millrace.operators.history import apply_history, final_versions
from millrace.operators.mart import apply_mart
from millrace.plans.spec import RECORD_ID, ColumnSpec, MappingSpec
from millrace.sources.dictionary import SourceColumn, SourceTable, tables_from_dictionary
from millrace.sources.landed import read_landed, stage, text_schema
from millrace.sources.publish import (
    CommitConflict, Layout, Rules, clean_up, compact, last_commit, publish, publish_load, read_between, read_duplicates,
    read_model, truncate_load,
)
from millrace.sources.tables import archive_to, load_parquet, read_archive, read_spec, save_parquet, write_table
from millrace.streaming.arrivals import archive_arrivals, arrivals, publish_arrivals
from queries.apply import ALL, DELETE_INSERT_SQL, INSERT_SPEC, INSERT_SQL, UPSERT_MODEL_SQL, UPSERT_SPEC, UPSERT_SQL
from queries.apply import line_load, line_model, order_load, order_model
from queries.common import AS_OF, fresh_folder, moment, table
from queries.history import ORACLES as HISTORY_SQL
from queries.history import ORDER_VERSIONS, version_load, version_model
from queries.mart import LINES, line_mart, line_stage
from queries.mart import ORACLES as MART_SQL

ORDERS = SourceTable("SALES", "orders", (
    SourceColumn("o_orderkey", "BIGINT", key=True),
    SourceColumn("o_custkey", "BIGINT"),
    SourceColumn("o_orderstatus", "VARCHAR(2)"),
    SourceColumn("o_totalprice", "FLOAT"),
    SourceColumn("o_orderdate", "DATE"),
))


def landed(spark, sf_dir):
    """Orders as CSV and customers as JSON in one folder; only names with ``.csv`` are read."""
    folder = fresh_folder(spark)
    orders = table(spark, sf_dir, "orders").select([c.name for c in ORDERS.columns])
    orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.csv(folder)
    table(spark, sf_dir, "customer").write.mode("append").json(folder)
    return read_landed(spark, folder, "csv", ".csv", text_schema(ORDERS))


def _landed(spark, sf_dir):
    return landed(spark, sf_dir).withColumn("filename", F.col("filename").contains(".csv"))


def _staged(spark, sf_dir):
    return stage(landed(spark, sf_dir), ORDERS, 7, AS_OF).withColumn("filename", F.col("filename").contains(".csv"))


def _arrived(spark, sf_dir):
    """Orders land in two deliveries; each run archives what is new."""
    folder = fresh_folder(spark)
    orders = table(spark, sf_dir, "orders").select([c.name for c in ORDERS.columns])
    text = orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    for batch, status in ((1, "o_orderstatus = 'F'"), (2, "o_orderstatus <> 'F'")):
        text.filter(status).write.mode("append").csv(f"{folder}/in")
        stream = arrivals(spark, f"{folder}/in", "csv", ".csv", text_schema(ORDERS))
        archive_arrivals(stream, ORDERS, f"{folder}/archive", f"{folder}/progress", batch, AS_OF)
    return read_archive(spark, f"{folder}/archive").withColumn("filename", F.col("filename").contains(".csv")), folder


def _arrived_and_appended(spark, sf_dir):
    """Two deliveries taken up as they arrive, then all orders once more as a batch."""
    _, folder = _arrived(spark, sf_dir)
    archive_to(stage(table(spark, sf_dir, "orders"), ORDERS, 3, AS_OF), f"{folder}/archive")
    return read_archive(spark, f"{folder}/archive").withColumn("filename", F.col("filename").contains(".csv"))


def _written(spark, sf_dir):
    """Order lines bucketed by order and partitioned by return flag, in a catalog table of the session."""
    name, folder = f"lines_{uuid.uuid4().hex}", fresh_folder(spark)
    lines = table(spark, sf_dir, "lineitem")
    write_table(lines, name, bucket_by=(8, ["l_orderkey"]), partition_by=["l_returnflag"], path=folder)
    spark.sql(f"DROP TABLE {name}")  # the files stay where they were written
    return spark.read.schema(lines.schema).parquet(folder)


def _typed_partitions(spark, sf_dir):
    """Orders saved by a text that looks like a number, or is empty, and read back."""
    folder = fresh_folder(spark)
    coded = F.when(F.col("o_orderstatus") == "F", "01").when(F.col("o_orderstatus") == "P", "")
    save_parquet(table(spark, sf_dir, "orders").withColumn("code", coded.otherwise("1")), folder, partition_by=["code"])
    return load_parquet(spark, folder, ["o_orderkey", "code"], [("code", ["01", "", "1"])])


def _saved(spark, sf_dir):
    folder = fresh_folder(spark)
    gaps = table(spark, sf_dir, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    )
    save_parquet(gaps, folder, partition_by=["o_orderstatus"])
    return folder


def _loaded(spark, sf_dir):
    return load_parquet(
        spark, _saved(spark, sf_dir), ["o_orderkey", "o_orderpriority", "o_totalprice"],
        [("o_orderstatus", ["F", "P"]), ("o_orderpriority", ["1-URGENT", ""])],
    )


def _truncated(spark, sf_dir):
    """Two loads of one load-ready table; the second replaces the first."""
    folder = fresh_folder(spark)
    truncate_load(order_model(spark, sf_dir), folder, "ORDERS_R101")
    return truncate_load(order_load(spark, sf_dir), folder, "ORDERS_R101")


def _published_upsert(spark, sf_dir, read):
    """Model published in buckets of its key, upserted from its own published rows, and published again."""
    folder = fresh_folder(spark)
    truncate_load(order_model(spark, sf_dir), folder, "ORDERS", layout=Layout(buckets=8, keys=("ORD_ID",)))
    load = order_load(spark, sf_dir)
    publish_load(spark, folder, "ORDERS", load, lambda model: apply_upsert(load, model, UPSERT_SPEC))
    return read(spark, folder, "ORDERS")


def _published_changes(spark, sf_dir, read, packed=False):
    """The same upsert into a table that takes changes: only changed rows and masks of old ones are written."""
    folder = fresh_folder(spark)
    layout = Layout(buckets=8, keys=("ORD_ID",), changes=True)
    truncate_load(order_model(spark, sf_dir), folder, "ORDERS", layout=layout)
    load = order_load(spark, sf_dir)
    publish_load(spark, folder, "ORDERS", load, lambda model: apply_upsert(load, model, UPSERT_SPEC))
    if packed:
        compact(spark, folder, "ORDERS")
        clean_up(spark, folder, "ORDERS")
    return read(spark, folder, "ORDERS")


def _published_conflict(spark, sf_dir):
    """Two loads made from one commit, of orders below and above a date: the second, which would undo the
    first, is refused and made anew."""
    folder = fresh_folder(spark)
    truncate_load(order_model(spark, sf_dir), folder, "ORDERS")
    base, load = last_commit(spark, folder, "ORDERS"), order_load(spark, sf_dir)
    model = read_model(spark, folder, "ORDERS", base)
    parts = [load.filter(F.col("ORD_ID") % 2 == n) for n in (0, 1)]
    publish(spark, folder, "ORDERS", apply_upsert(parts[0], model, UPSERT_SPEC), base=base)
    try:
        publish(spark, folder, "ORDERS", apply_upsert(parts[1], model, UPSERT_SPEC), base=base)
    except CommitConflict:
        publish_load(spark, folder, "ORDERS", parts[1], lambda now: apply_upsert(parts[1], now, UPSERT_SPEC))
    return read_model(spark, folder, "ORDERS")


def _published_compacted(spark, sf_dir):
    """Inserts of new orders by weekday, packed into one folder per bucket; folders no commit needs are deleted."""
    folder, load = fresh_folder(spark), order_load(spark, sf_dir)
    truncate_load(order_model(spark, sf_dir), folder, "ORDERS", layout=Layout(buckets=4, keys=("ORD_ID",)))
    for day in range(4):
        part = load.filter(F.col("ORD_ID") % 4 == day)
        publish_load(spark, folder, "ORDERS", part, lambda model, part=part: apply_insert(part, model, INSERT_SPEC))
    compact(spark, folder, "ORDERS")
    clean_up(spark, folder, "ORDERS")
    return read_model(spark, folder, "ORDERS")


def _published_history_changes(spark, sf_dir):
    """Order versions closed and inserted as changes: closed rows take the place of masked open ones."""
    folder = fresh_folder(spark)
    layout = Layout(buckets=8, keys=("ORD_ID",), changes=True, masked_by=("ORD_END_DT",))
    truncate_load(version_model(spark, sf_dir), folder, "VERSIONS", layout=layout)
    load = version_load(spark, sf_dir)
    publish_load(spark, folder, "VERSIONS", load, lambda model: apply_history(load, model, ORDER_VERSIONS))
    return read_model(spark, folder, "VERSIONS")


GREEK = SourceTable("SALES", "names", (
    SourceColumn("name", "VARCHAR(40) NOT CASESPECIFIC", key=True), SourceColumn("balance", "FLOAT"),
))


def _published_mart_case_blind(spark, sf_dir):
    """Customers by a Greek name in capitals, merged in buckets with the same names in small letters."""
    folder = fresh_folder(spark)
    rest = {"batch_id": F.lit(1), "insrt_dttm": moment(AS_OF), "updt_dttm": F.lit(None).cast("timestamp_ntz"), "dump_dttm": moment(AS_OF)}
    names = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ΟΔΟΣ"), F.col("c_custkey"), F.lit("ΑΣ")).alias("name"), F.col("c_acctbal").alias("balance")
    )
    truncate_load(names.withColumns(rest), folder, "NAMES", layout=Layout(buckets=16, keys=("name",)))
    stage_ = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(
        F.concat(F.lit("οδος"), F.col("c_custkey"), F.lit("ασ")).alias("name"), (F.col("c_acctbal") + 1).alias("balance"),
        F.lit(2).alias("batch_id"), moment(AS_OF).alias("dump_dttm"),
    )
    publish_load(spark, folder, "NAMES", stage_, lambda mart: apply_mart(stage_, mart, GREEK, AS_OF))
    return read_model(spark, folder, "NAMES").select("name", "balance", "batch_id")


def _published_arrivals(spark, sf_dir):
    """Orders that land in two deliveries, each upserted as it arrives into a table that takes changes."""
    folder = fresh_folder(spark)
    orders = table(spark, sf_dir, "orders").select([c.name for c in ORDERS.columns])
    text = orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    typed = stage(text.limit(0), ORDERS, 0, AS_OF).select(*columns)
    truncate_load(typed, folder, "ORDERS", layout=Layout(buckets=8, keys=("o_orderkey",), changes=True))
    spec = MappingSpec(150, "ORDERS", "UPSERT", tuple(
        ColumnSpec(c.name, c.type, pk=c.key) for c in ORDERS.columns
    ))
    for delivery in (text.filter("o_orderkey % 3 < 2"), text.filter("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.lit("N"))):
        delivery.write.mode("append").csv(f"{folder}/in")
        publish_arrivals(
            arrivals(spark, f"{folder}/in", "csv", ".csv", text_schema(ORDERS)), folder, "ORDERS", f"{folder}/progress",
            lambda rows: stage(rows, ORDERS, 1, AS_OF).select(*columns), lambda load, model: apply_upsert(load, model, spec),
        )
    return read_model(spark, folder, "ORDERS")


def _published_ranges(spark, sf_dir):
    """Orders in two folders, of early and late keys, with the ranges of their keys; late ones upserted, a range read."""
    folder, load = fresh_folder(spark), order_load(spark, sf_dir)
    model = order_model(spark, sf_dir)
    middle = model.agg(F.max("ORD_ID")).first()[0] // 2
    layout = Layout(keys=("ORD_ID",), ranges=("ORD_ID",))
    truncate_load(model.filter(F.col("ORD_ID") <= middle), folder, "ORDERS", layout=layout, rules=Rules(("ORD_ID",), ("ORD_ID",)))
    for part in (model.filter(F.col("ORD_ID") > middle), load.filter(F.col("ORD_ID") > middle)):
        publish_load(spark, folder, "ORDERS", part, lambda known, part=part: apply_upsert(part, known, UPSERT_SPEC))
    return read_between(spark, folder, "ORDERS", "ORD_ID", low=middle + 1)


def _published_insert(spark, sf_dir):
    folder = fresh_folder(spark)
    model = truncate_load(order_model(spark, sf_dir), folder, "ORDERS")
    publish(spark, folder, "ORDERS", apply_insert(order_load(spark, sf_dir), model, INSERT_SPEC))
    return read_model(spark, folder, "ORDERS")


def _published_slice(spark, sf_dir):
    """Record id 3 of the line model replaced without reading or rewriting the others."""
    folder = fresh_folder(spark)
    model = truncate_load(line_model(spark, sf_dir), folder, "LINES", layout=Layout(partition_by=(RECORD_ID,)))
    publish(spark, folder, "LINES", apply_delete_insert(line_load(spark, sf_dir), model, 3))
    return read_model(spark, folder, "LINES").withColumn(RECORD_ID, F.col(RECORD_ID).cast("int"))


def _published_history(spark, sf_dir):
    """Order versions published, closed and inserted again; closed versions stay where they are."""
    folder = fresh_folder(spark)
    model = truncate_load(version_model(spark, sf_dir), folder, "VERSIONS", final=final_versions(ORDER_VERSIONS))
    publish(spark, folder, "VERSIONS", apply_history(version_load(spark, sf_dir), model, ORDER_VERSIONS))
    return read_model(spark, folder, "VERSIONS")


def _published_mart(spark, sf_dir):
    """Line counts published, then merged: only the partitions of flags A and R are written again."""
    folder = fresh_folder(spark)
    layout = Layout(keys=tuple(LINES.keys), partition_by=tuple(LINES.partitions))
    truncate_load(line_mart(spark, sf_dir), folder, "LINES", layout=layout)
    load = line_stage(spark, sf_dir)
    publish_load(spark, folder, "LINES", load, lambda mart: apply_mart(load, mart, LINES, AS_OF))
    return read_model(spark, folder, "LINES")


def _spec_table(spark, sf_dir):
    """Key/value pairs written as CSV and read back as a spec table."""
    folder = fresh_folder(spark)
    pairs = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("value")
    )
    pairs.coalesce(1).write.option("header", "true").csv(folder)
    return read_spec(spark, folder, "name string, value string")


def _dictionary(spark, sf_dir):
    """Orders staged by types derived from a source dictionary that describes the orders table."""
    columns = [
        ("o_orderkey", "NUMBER", "22", "18", "0", "Y", "N"),
        ("o_custkey", "NUMBER", "22", "", "0", "N", "N"),
        ("o_orderstatus", "VARCHAR2", "1", "", "", "N", "Y"),
        ("o_totalprice", "NUMBER", "22", "12", "2", "N", "Y"),
        ("o_orderdate", "DATE", "", "", "", "N", "Y"),
    ]
    schema = (
        "COLUMN_NAME string, DATA_TYPE string, DATA_LENGTH string, DATA_PRECISION string, DATA_SCALE string, "
        "PRIMARY_KEY_FLAG string, NULLABILITY_FLAG string"
    )
    described = spark.createDataFrame(columns, schema).withColumns({
        "SCHEMA_NAME": F.lit("SALES"), "TABLE_NAME": F.lit("ORDERS"), "Source System": F.lit("SHOP"),
        "UNICODE_FLAG": F.lit("N"), "TERADATA_PARTITION": F.lit("N"),
    })
    orders = tables_from_dictionary(described)["SALES", "ORDERS"]
    staged = stage(table(spark, sf_dir, "orders"), orders, 7, AS_OF)
    return staged.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


STAGED_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       CAST(7 AS INTEGER) AS batch_id, TRUE AS filename, TIMESTAMP '2024-06-01 00:00:00' AS dump_dttm FROM orders
"""

QUERIES = {
    "read_landed": _landed,
    "stage": _staged,
    "stage_by_dictionary": _dictionary,
    "archive_arrivals": lambda s, d: _arrived(s, d)[0],
    "archive_arrivals_and_batch": _arrived_and_appended,
    "write_table": _written,
    "save_parquet": lambda s, d: s.read.parquet(_saved(s, d)),
    "load_parquet": _loaded,
    "load_parquet_partition_text": _typed_partitions,
    "truncate_load": _truncated,
    "publish_upsert": lambda s, d: _published_upsert(s, d, read_model),
    "publish_duplicates": lambda s, d: _published_upsert(s, d, read_duplicates),
    "publish_changes": lambda s, d: _published_changes(s, d, read_model),
    "publish_changes_duplicates": lambda s, d: _published_changes(s, d, read_duplicates),
    "publish_changes_packed": lambda s, d: _published_changes(s, d, read_model, packed=True),
    "publish_conflict": _published_conflict,
    "publish_ranges": _published_ranges,
    "publish_compacted": _published_compacted,
    "publish_history_changes": _published_history_changes,
    "publish_mart_case_blind": _published_mart_case_blind,
    "publish_arrivals": _published_arrivals,
    "publish_insert": _published_insert,
    "publish_delete_insert": _published_slice,
    "publish_history": _published_history,
    "publish_mart": _published_mart,
    "read_spec": _spec_table,
}
ORACLES = {
    "read_landed": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
               CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
               TRUE AS filename FROM orders""",
    "stage": STAGED_SQL,
    "stage_by_dictionary": STAGED_SQL.replace("TRUE AS filename", "CAST(NULL AS VARCHAR) AS filename").replace(
        "o_custkey,", "CAST(o_custkey AS INTEGER) AS o_custkey,"
    ),
    "archive_arrivals": STAGED_SQL.replace(
        "CAST(7 AS INTEGER)", "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS INTEGER)"
    ),
    "load_parquet_partition_text": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '01' WHEN 'P' THEN '' ELSE '1' END AS code FROM orders""",
    "write_table": "SELECT * FROM lineitem",
    "save_parquet": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '' END AS o_orderpriority FROM orders""",
    "load_parquet": """
        SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '' END AS o_orderpriority,
               o_totalprice
        FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '5-LOW')""",
    "truncate_load": UPSERT_SQL + "SELECT * FROM load",
    "publish_upsert": UPSERT_MODEL_SQL,
    "publish_duplicates": UPSERT_SQL + f"SELECT {ALL} FROM flagged WHERE FLAG = 'D'",
    "publish_changes": UPSERT_MODEL_SQL,
    "publish_changes_duplicates": UPSERT_SQL + f"SELECT {ALL} FROM flagged WHERE FLAG = 'D'",
    "publish_changes_packed": UPSERT_MODEL_SQL,
    "publish_conflict": UPSERT_MODEL_SQL,
    "publish_ranges": f"SELECT * FROM ({UPSERT_MODEL_SQL}) WHERE ORD_ID > (SELECT MAX(ORD_ID) // 2 FROM ({UPSERT_SQL} SELECT * FROM model))",
    "publish_compacted": INSERT_SQL + f"SELECT * FROM model UNION ALL SELECT {ALL} FROM flagged WHERE FLAG = 'I'",
    "publish_history_changes": HISTORY_SQL["apply_history"],
    "publish_mart_case_blind": """
        SELECT concat('ΟΔΟΣ', c_custkey, 'ΑΣ') AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance,
               1 AS batch_id FROM customer""",
    "publish_arrivals": """
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
               CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""",
    "publish_insert": INSERT_SQL + f"SELECT * FROM model UNION ALL SELECT {ALL} FROM flagged WHERE FLAG = 'I'",
    "publish_delete_insert": DELETE_INSERT_SQL,
    "publish_history": HISTORY_SQL["apply_history"],
    "publish_mart": MART_SQL["load_mart_partitioned"],
    "read_spec": """
        SELECT n_name AS name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END AS value
        FROM nation""",
}
ORACLES["archive_arrivals_and_batch"] = (
    ORACLES["archive_arrivals"] + " UNION ALL "
    + STAGED_SQL.replace("CAST(7 AS INTEGER)", "CAST(3 AS INTEGER)").replace("TRUE AS filename", "NULL AS filename")
)
