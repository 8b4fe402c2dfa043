"""Transformations of orders, order lines and events into load-ready rows, rule by rule."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions.types import cast_to, parse_type
from millrace.operators.transform import batch_id, grouped, run_transforms, technical_columns, transform
from millrace.operators.windows import qualify
from millrace.plans.combined import ready_name, write_transforms
from millrace.plans.run import run_mapping
from millrace.plans.spec import SPEC_COLUMNS, ColumnSpec, Join, Lookup, MappingSpec, specs_from_table
from queries.apply import ALL, DELETE_INSERT_SQL, INSERT_SQL, UPSERT_SQL, line_model, order_model
from queries.common import AS_OF, table
from queries.history import REBUILD_SQL, VERSION_SQL, VERSION_TARGET_SQL, dated_model, version_model
from queries.keys import PAIR_KEYS, SGK_SQL, batch_log, lines, surrogates

SOURCE = "1-URGENT"
BATCH_SQL = f"(SELECT COALESCE(MAX(o_orderkey), 0) FROM orders WHERE o_orderpriority = '{SOURCE}')"
TECHNICAL_SQL = f""", CAST({{rid}} AS INTEGER) AS R_ID, {BATCH_SQL} AS B_ID,
    TIMESTAMP '2024-06-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2024-06-01 00:00:00' AS UPDT_DTTM
"""


def col(name, type_text, source_table, source_column, rule="1:1", **more):
    return ColumnSpec(name, type_text, source_table=source_table, source_column=source_column, rule=rule, **more)


def mapping(record_id, columns, from_table="orders", load_type="UPSERT", entity="ORDERS", **more):
    return MappingSpec(record_id, entity, load_type, tuple(columns), source=SOURCE, from_table=from_table, **more)


ORDER_ID = col("ORD_ID", "BIGINT", "orders", "o_orderkey", pk=True)
DIRECT = mapping(401, [
    ORDER_ID,
    col("ORD_KEY_TXT", "VARCHAR(3)", "orders", "o_orderkey"),
    col("ORD_AMT", "DECIMAL(12,1)", "orders", "o_totalprice"),
    col("ORD_DT", "DATE", "orders", "o_orderdate"),
    col("ORD_PRTY", "VARCHAR(5)", "orders", "o_orderpriority"),
    col("ORD_WHOLE", "INTEGER", "orders", "o_totalprice"),
])
CONSTANTS = mapping(402, [
    ORDER_ID,
    col("CLOSED_FLG", "VARCHAR(10)", "HCV", "HCV", "NULL"),
    col("SRC_CD", "VARCHAR(20)", "HCV", "HCV", "hardcode to 'web shop'"),
    col("CNT", "INTEGER", "HCV", "HCV", "SET TO 7"),
    col("RATE", "DECIMAL(5,2)", "HCV", "HCV", "HARDCODE TO '1.25'"),
    col("FACTOR", "FLOAT", "HCV", "HCV", "SET TO 0.5"),
    col("FROM_DT", "DATE", "HCV", "HCV", "SET TO '2001-02-03'"),
    col("ORD_END_CD", "VARCHAR(5)", "HCV", "HCV", "SET TO 'open'"),
])
DATES = mapping(403, [
    col("ORD_ID", "BIGINT", "orders", "o_orderkey", pk=True, role="HKEY"),
    col("ORD_STS", "VARCHAR(1)", "orders", "o_orderstatus", role="HCOL"),
    col("ORD_STRT_DT", "DATE", "JOB", "JOB", "JOB START", role="S"),
    col("ORD_END_DT", "DATE", "JOB", "JOB", "OPEN", role="E"),
    col("LOADED_AT", "TIMESTAMP(0)", "ETL", "INSRT_DTTM"),
], load_type="HISTORY")
EXPRESSIONS = mapping(404, [
    ORDER_ID,
    col("ORD_YEAR", "INTEGER", "orders", "o_orderdate", "the year of the order date", expr="year(orders.o_orderdate)"),
    col("ORD_BAND", "VARCHAR(6)", "orders", "o_totalprice", "small, medium or large",
        expr="CASE WHEN orders.o_totalprice < 100000 THEN 'small' WHEN orders.o_totalprice < 300000 "
             "THEN 'medium' ELSE 'large' END"),
])
FILTERED = mapping(405, [ORDER_ID, col("CUST_ID", "BIGINT", "orders", "o_custkey")],
                   where="orders.o_orderstatus = 'F' AND orders.o_totalprice > 100000")
LATEST = mapping(406, [
    col("USER_ID", "BIGINT", "events", "user_id", pk=True),
    col("EVENT_ID", "BIGINT", "events", "event_id"),
    col("EVENT_TYPE", "VARCHAR(20)", "events", "event_type"),
], from_table="events", entity="USER_EVENTS",
    qualify="row_number() OVER (PARTITION BY events.user_id ORDER BY events.ts DESC, events.event_id DESC) = 1")
GROUPED = mapping(407, [
    col("PART_ID", "BIGINT", "lineitem", "l_partkey", pk=True),
    col("SUPP_ID", "BIGINT", "lineitem", "l_suppkey", pk=True),
    col("PART_NAME", "VARCHAR(50)", "part", "p_name"),
], from_table="lineitem", entity="PART_SUPP", where="l_returnflag = 'R'", group_by=("l_partkey", "l_suppkey"),
    joins=(Join("part", "lineitem.l_partkey = part.p_partkey"),))
JOINED = mapping(408, [
    ORDER_ID,
    col("CUST_NAME", "VARCHAR(30)", "c", "c_name"),
    col("NATION", "VARCHAR(20)", "nation", "n_name"),
], joins=(
    Join("customer", "orders.o_custkey = c.c_custkey AND c.c_acctbal > 0", alias="c"),
    Join("nation", "c.c_nationkey = nation.n_nationkey"),
))
LOOKED_UP = mapping(409, [
    col("ORD_ID", "BIGINT", "lineitem", "l_orderkey", pk=True),
    col("LINE_NO", "INTEGER", "lineitem", "l_linenumber", pk=True),
    ColumnSpec("PAIR_ID", "BIGINT", source_table="SGK3", source_column="PAIR_ID", rule="1:1"),
], from_table="lineitem", entity="LINES", lookups=(
    Lookup("concat_ws('-', lineitem.l_partkey, lineitem.l_suppkey)", "PART_SUPP_SGK", "SRC_KEY", 1, "SGK3"),
))
LINE_PRICES = mapping(411, [
    col("ORD_ID", "BIGINT", "lineitem", "l_orderkey", pk=True),
    col("PRICE", "DECIMAL(12,2)", "lineitem", "l_extendedprice"),
], from_table="lineitem", entity="LINES", where="lineitem.l_returnflag = 'R'")
FLAGSHIP = mapping(101, [
    ORDER_ID,
    col("CUST_ID", "BIGINT", "orders", "o_custkey"),
    col("ORD_STS", "VARCHAR(10)", "orders", "o_orderstatus"),
    col("ORD_AMT", "FLOAT", "orders", "o_totalprice"),
    col("ORD_PRTY", "VARCHAR(20)", "orders", "o_orderpriority", "dash when not specified",
        expr="CASE WHEN orders.o_orderpriority = '4-NOT SPECIFIED' THEN '-' ELSE orders.o_orderpriority END"),
    col("ORD_STRT_DT", "DATE", "JOB", "JOB", "JOB START"),
])


def tables(spark: SparkSession, sf_dir: str):
    given = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "lineitem", "part", "events")}
    return given | {"PART_SUPP_SGK": surrogates(spark, sf_dir)}


def run(spec):
    return lambda s, d: transform(spec, tables(s, d), batch_log(s, d), AS_OF)


def _all_transforms(spark, sf_dir):
    """Rows per load-ready table of the combined run, which applies no filters."""
    ready = run_transforms([DIRECT, FILTERED, LATEST, LOOKED_UP], tables(spark, sf_dir), batch_log(spark, sf_dir), AS_OF)
    counts = [
        df.agg(F.lit(name).alias("load_ready"), F.count(F.lit(1)).alias("loaded"), F.max("B_ID").alias("batch"))
        for name, df in ready.items()
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def _written(spark, sf_dir, spec, apply_filters=False):
    """One load-ready table of a combined run of all mappings, each stage table read once; pairs get surrogates first."""
    every = [DIRECT, CONSTANTS, DATES, EXPRESSIONS, FILTERED, LATEST, LOOKED_UP, LINE_PRICES]
    keys = replace(PAIR_KEYS, where="lines.pair IS NOT NULL")
    found = write_transforms(
        every, tables(spark, sf_dir) | {"lines": lines(spark, sf_dir)}, batch_log(spark, sf_dir), AS_OF, apply_filters, [keys]
    )
    return found[ready_name(spec)]


def _typed_events(spark, sf_dir):
    """Event times and values at declared types."""
    declared = {"whole": "TIMESTAMP(0)", "milli": "TIMESTAMP(3)", "full": "timestamp", "day": "DATE"}
    return table(spark, sf_dir, "events").select(
        "event_id",
        *(cast_to(F.col("ts"), parse_type(t)).alias(n) for n, t in declared.items()),
        cast_to(F.col("value"), parse_type("DECIMAL(8,1)")).cast("double").alias("amount"),
        cast_to(F.col("event_type"), parse_type("CHAR(3)")).alias("short_type"),
    )


def _run_mapping(spark, sf_dir):
    return run_mapping(FLAGSHIP, tables(spark, sf_dir), order_model(spark, sf_dir), batch_log(spark, sf_dir), AS_OF).target


MAPPED_UPSERT_SQL = UPSERT_SQL.replace(
    "CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ORD_ID", "o_orderkey AS ORD_ID", 1
).replace("CAST(20 AS BIGINT) AS B_ID", f"{BATCH_SQL} AS B_ID", 1) + """
SELECT m.ORD_ID, COALESCE(u.CUST_ID, m.CUST_ID) AS CUST_ID, COALESCE(u.ORD_STS, m.ORD_STS) AS ORD_STS,
       COALESCE(u.ORD_AMT, m.ORD_AMT) AS ORD_AMT,
       CASE WHEN u.ORD_ID IS NOT NULL THEN u.ORD_PRTY ELSE m.ORD_PRTY END AS ORD_PRTY,
       m.ORD_STRT_DT, m.R_ID, COALESCE(u.B_ID, m.B_ID) AS B_ID, m.INSRT_DTTM,
       COALESCE(u.UPDT_DTTM, m.UPDT_DTTM) AS UPDT_DTTM
FROM model m LEFT JOIN (SELECT * FROM flagged WHERE FLAG = 'U') u ON m.ORD_ID = u.ORD_ID
UNION ALL
SELECT ORD_ID, CUST_ID, ORD_STS, ORD_AMT, ORD_PRTY, ORD_STRT_DT, R_ID, B_ID, INSRT_DTTM, UPDT_DTTM
FROM flagged WHERE FLAG = 'I'
"""

def _spec_rows(record_id, entity, load_type, columns, filter_rule):
    """Rows of a mapping table for columns given as name, type, key, table, column and rule."""
    return [
        (record_id, entity, name, kind, key, "", load_type, "SHOP", SOURCE, source, column, rule, source, "", filter_rule, "N")
        for name, kind, key, source, column, rule in columns
    ]


def _filtered_by_spec(spark, sf_dir):
    """A mapping table with one rule that filters rows and, of the rest, keeps the last per user."""
    rule = "WHERE events.event_type <> 'where qualify' and events.value > 10 QUALIFY " \
        "row_number() OVER (PARTITION BY events.user_id ORDER BY events.ts DESC, events.event_id DESC) = 1"
    mapped = _spec_rows(411, "LAST_EVENTS", "INSERT", [
        ("USER_ID", "BIGINT", "PK", "events", "user_id", "1:1"), ("EVENT_ID", "BIGINT", "", "events", "event_id", "1:1"),
        ("EVENT_TYPE", "VARCHAR(20)", "", "events", "event_type", "1:1"),
    ], rule)
    schema = ", ".join(f"`{c}` {'int' if c == 'Record_ID' else 'string'}" for c in SPEC_COLUMNS)
    (spec,) = specs_from_table(spark.createDataFrame(mapped, schema))
    return transform(spec, tables(spark, sf_dir), batch_log(spark, sf_dir), AS_OF)


LINE_COLUMNS = [
    col("DOC_ID", "BIGINT", "orders", "o_orderkey", pk=True), col("ITEM_ID", "BIGINT", "orders", "o_custkey"),
    col("AMT", "FLOAT", "orders", "o_totalprice"), col("DOC_STRT_DT", "DATE", "orders", "o_orderdate"),
    col("DOC_END_DT", "DATE", "orders", "o_orderdate", "open", expr="DATE'9999-12-31'"),
]
ORDER_HISTORY = [
    col("ORD_ID", "BIGINT", "orders", "o_orderkey", pk=True, role="HKEY"),
    col("ORD_STS", "VARCHAR(10)", "orders", "o_orderstatus", role="HCOL"),
    col("ORD_PRTY", "VARCHAR(20)", "orders", "o_orderpriority", "dash when not specified", role="HCOL",
        expr="CASE WHEN orders.o_orderpriority = '4-NOT SPECIFIED' THEN '-' ELSE orders.o_orderpriority END"),
    col("ORD_STRT_DT", "DATE", "JOB", "JOB", "JOB START", role="S"),
    col("ORD_END_DT", "DATE", "JOB", "JOB", "OPEN", role="E"),
]
CUSTOMER_HISTORY = [
    col("CUST_ID", "BIGINT", "orders", "o_custkey", pk=True, role="HKEY"),
    col("LAST_STS", "VARCHAR(10)", "orders", "o_orderstatus", "none while pending", role="HCOL",
        expr="CASE WHEN orders.o_orderstatus <> 'P' THEN orders.o_orderstatus END"),
    col("LAST_PRTY", "VARCHAR(20)", "orders", "o_orderpriority", "none when not specified", role="HCOL",
        expr="CASE WHEN orders.o_orderpriority <> '4-NOT SPECIFIED' THEN orders.o_orderpriority END"),
    col("CUST_STRT_DT", "DATE", "orders", "o_orderdate", role="S"),
    col("CUST_END_DT", "DATE", "JOB", "JOB", "OPEN", role="E"),
]


def _mapped(spec, model, **options):
    """The model after a mapping was run from the stage tables to it."""
    return lambda s, d: run_mapping(spec, tables(s, d), model(s, d), batch_log(s, d), AS_OF, **options).target


def _timed_lines(spark, sf_dir):
    never = F.lit(None).cast("timestamp_ntz")
    return line_model(spark, sf_dir).withColumns({"INSRT_DTTM": never, "UPDT_DTTM": never})


QUERIES = {
    "transform_where_qualify": _filtered_by_spec,
    "run_mapping_insert": _mapped(mapping(101, FLAGSHIP.columns, load_type="INSERT"), order_model),
    "run_mapping_delete_insert": _mapped(mapping(3, LINE_COLUMNS, load_type="DELETE_INSERT", entity="LINES"), _timed_lines),
    "run_mapping_history_delete_insert": _mapped(
        mapping(3, LINE_COLUMNS, load_type="DELETE INSERT - HISTORY HANDLED", entity="LINES"), _timed_lines
    ),
    "run_mapping_history": _mapped(mapping(201, ORDER_HISTORY, load_type="HISTORY", entity="VERSIONS"), version_model),
    "run_mapping_history_legacy": _mapped(
        mapping(202, CUSTOMER_HISTORY, load_type="HISTORY", entity="CUSTOMERS"), dated_model, initial=True
    ),
    "transform_direct": run(DIRECT),
    "transform_constants": run(CONSTANTS),
    "transform_dates": run(DATES),
    "transform_expressions": run(EXPRESSIONS),
    "transform_filter": run(FILTERED),
    "transform_qualify": run(LATEST),
    "transform_group": run(GROUPED),
    "transform_joins": run(JOINED),
    "transform_lookup": run(LOOKED_UP),
    "run_transforms": _all_transforms,
    **{f"write_transforms_{spec.record_id}": partial(_written, spec=spec) for spec in (DIRECT, FILTERED, LATEST, LOOKED_UP)},
    "write_transforms_filtered_405": partial(_written, spec=FILTERED, apply_filters=True),
    "write_transforms_filtered_406": partial(_written, spec=LATEST, apply_filters=True),
    "write_transforms_filtered_411": partial(_written, spec=LINE_PRICES, apply_filters=True),
    "run_mapping": _run_mapping,
    "technical_columns": lambda s, d: technical_columns(table(s, d, "customer"), 410, 12, AS_OF),
    "batch_id": lambda s, d: table(s, d, "orders").select("o_orderkey").withColumns(
        {"B_ID": batch_id(batch_log(s, d), SOURCE), "none": batch_id(batch_log(s, d), "unknown")}
    ),
    "parse_type": _typed_events,
    "qualify": lambda s, d: qualify(
        table(s, d, "lineitem"),
        "rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) = 1 "
        "AND count(*) OVER (PARTITION BY l_orderkey) > 3",
    ),
    "grouped": lambda s, d: grouped(table(s, d, "lineitem"), ["l_partkey", "l_returnflag"], "l_quantity > 10"),
}
EVENTS_SQL = "SELECT user_id AS USER_ID, event_id AS EVENT_ID, event_type AS EVENT_TYPE" + TECHNICAL_SQL.format(rid=406) + "FROM events"
ORACLES = {
    "transform_direct": "SELECT o_orderkey AS ORD_ID, left(CAST(o_orderkey AS VARCHAR), 3) AS ORD_KEY_TXT, "
        "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(12,1)) AS ORD_AMT, CAST(o_orderdate AS DATE) AS ORD_DT, "
        "left(o_orderpriority, 5) AS ORD_PRTY, CAST(trunc(o_totalprice) AS INTEGER) AS ORD_WHOLE"
        + TECHNICAL_SQL.format(rid=401) + "FROM orders",
    "transform_constants": "SELECT o_orderkey AS ORD_ID, CAST(NULL AS VARCHAR) AS CLOSED_FLG, 'WEB SHOP' AS SRC_CD, "
        "CAST(7 AS INTEGER) AS CNT, CAST(1.25 AS DECIMAL(5,2)) AS RATE, CAST(0.5 AS DOUBLE) AS FACTOR, "
        "DATE '2001-02-03' AS FROM_DT, 'OPEN' AS ORD_END_CD" + TECHNICAL_SQL.format(rid=402) + "FROM orders",
    "transform_dates": "SELECT o_orderkey AS ORD_ID, o_orderstatus AS ORD_STS, DATE '2024-06-01' AS ORD_STRT_DT, "
        "DATE '9999-12-31' AS ORD_END_DT, TIMESTAMP '2024-06-01 00:00:00' AS LOADED_AT"
        + TECHNICAL_SQL.format(rid=403) + "FROM orders",
    "transform_expressions": "SELECT o_orderkey AS ORD_ID, CAST(year(o_orderdate) AS INTEGER) AS ORD_YEAR, "
        "CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END "
        "AS ORD_BAND" + TECHNICAL_SQL.format(rid=404) + "FROM orders",
    "transform_filter": "SELECT o_orderkey AS ORD_ID, o_custkey AS CUST_ID" + TECHNICAL_SQL.format(rid=405)
        + "FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "transform_qualify": "SELECT user_id AS USER_ID, event_id AS EVENT_ID, event_type AS EVENT_TYPE"
        + TECHNICAL_SQL.format(rid=406)
        + "FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "transform_group": "SELECT l.l_partkey AS PART_ID, l.l_suppkey AS SUPP_ID, p.p_name AS PART_NAME"
        + TECHNICAL_SQL.format(rid=407)
        + "FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') l "
          "LEFT JOIN part p ON l.l_partkey = p.p_partkey",
    "transform_joins": "SELECT o.o_orderkey AS ORD_ID, c.c_name AS CUST_NAME, n.n_name AS NATION"
        + TECHNICAL_SQL.format(rid=408)
        + "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 "
          "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey",
    "transform_lookup": "SELECT l.l_orderkey AS ORD_ID, l.l_linenumber AS LINE_NO, k.PAIR_ID"
        + TECHNICAL_SQL.format(rid=409)
        + "FROM lineitem l LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey, l_partkey * 1000000 + l_suppkey AS PAIR_ID "
          "FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00') k "
          "ON l.l_partkey = k.l_partkey AND l.l_suppkey = k.l_suppkey",
    "run_transforms": f"""
        SELECT 'ORDERS_R401' AS load_ready, COUNT(*) AS loaded, {BATCH_SQL} AS batch FROM orders
        UNION ALL SELECT 'ORDERS_R405', COUNT(*), {BATCH_SQL} FROM orders
        UNION ALL SELECT 'USER_EVENTS_R406', COUNT(*), {BATCH_SQL} FROM events
        UNION ALL SELECT 'LINES_R409', COUNT(*), {BATCH_SQL} FROM lineitem""",
    "run_mapping": MAPPED_UPSERT_SQL,
    "technical_columns": "SELECT *, CAST(410 AS INTEGER) AS R_ID, CAST(12 AS INTEGER) AS B_ID, "
        "TIMESTAMP '2024-06-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2024-06-01 00:00:00' AS UPDT_DTTM FROM customer",
    "batch_id": f'SELECT o_orderkey, {BATCH_SQL} AS B_ID, CAST(0 AS BIGINT) AS "none" FROM orders',
    "parse_type": """
        SELECT event_id, date_trunc('second', ts) AS whole, date_trunc('millisecond', ts) AS milli, ts AS "full",
               CAST(ts AS DATE) AS "day", CAST(CAST(CAST(value AS DECIMAL(9,2)) AS DECIMAL(8,1)) AS DOUBLE) AS amount,
               left(event_type, 3) AS short_type
        FROM events""",
    "qualify": """
        SELECT * FROM lineitem
        QUALIFY RANK() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) = 1
            AND COUNT(*) OVER (PARTITION BY l_orderkey) > 3""",
    "grouped": "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 10",
}

MAPPED = ("CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ORD_ID", "o_orderkey AS ORD_ID", 1)
MAPPED_BATCH = ("CAST(20 AS BIGINT) AS B_ID", f"{BATCH_SQL} AS B_ID", 1)
ORACLES["transform_where_qualify"] = (
    "SELECT user_id AS USER_ID, event_id AS EVENT_ID, event_type AS EVENT_TYPE" + TECHNICAL_SQL.format(rid=411)
    + "FROM events WHERE event_type <> 'where qualify' AND value > 10 "
    "QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
)
ORACLES["run_mapping_insert"] = INSERT_SQL.replace(*MAPPED).replace(*MAPPED_BATCH) + (
    f"SELECT * FROM model UNION ALL SELECT {ALL} FROM flagged WHERE FLAG = 'I'"
)
NEVER = "CAST(NULL AS TIMESTAMP) AS INSRT_DTTM, CAST(NULL AS TIMESTAMP) AS UPDT_DTTM"
LOADED = "TIMESTAMP '2024-06-01 00:00:00', TIMESTAMP '2024-06-01 00:00:00'"
ORACLES["run_mapping_delete_insert"] = DELETE_INSERT_SQL.replace(
    "CAST(10 AS BIGINT) AS B_ID", f"CAST(10 AS BIGINT) AS B_ID, {NEVER}"
).replace("CAST(20 AS BIGINT)", f"{BATCH_SQL}, {LOADED}")
ORACLES["run_mapping_history_delete_insert"] = ORACLES["run_mapping_delete_insert"]
ORACLES["run_mapping_history"] = VERSION_SQL.replace(*MAPPED).replace(*MAPPED_BATCH) + VERSION_TARGET_SQL
ORACLES["run_mapping_history_legacy"] = REBUILD_SQL.replace("o_orderkey AS B_ID", f"{BATCH_SQL} AS B_ID", 1).replace(
    "ORDER BY B_ID ASC NULLS FIRST, incoming",
    "ORDER BY B_ID ASC NULLS FIRST, incoming, LAST_STS NULLS FIRST, LAST_PRTY NULLS FIRST", 1,
) + "SELECT * FROM model"
ORACLES |= {
    "write_transforms_401": ORACLES["transform_direct"],
    "write_transforms_405": "SELECT o_orderkey AS ORD_ID, o_custkey AS CUST_ID" + TECHNICAL_SQL.format(rid=405) + "FROM orders",
    "write_transforms_406": EVENTS_SQL,
    "write_transforms_409": SGK_SQL + """, fresh AS (
            SELECT pair, (SELECT MAX(PAIR_ID) FROM sgk) + ROW_NUMBER() OVER (ORDER BY pair DESC) AS PAIR_ID
            FROM (SELECT DISTINCT pair FROM lines WHERE pair IS NOT NULL
                  AND pair NOT IN (SELECT SRC_KEY FROM sgk WHERE SGK_ID = 1))),
        known AS (SELECT SRC_KEY, PAIR_ID FROM sgk WHERE SGK_ID = 1 UNION ALL SELECT pair, PAIR_ID FROM fresh)
        SELECT l.l_orderkey AS ORD_ID, CAST(l.l_linenumber AS INTEGER) AS LINE_NO, k.PAIR_ID""" + TECHNICAL_SQL.format(rid=409)
        + "FROM lineitem l LEFT JOIN known k ON k.SRC_KEY = concat(l.l_partkey, '-', l.l_suppkey)",
    "write_transforms_filtered_405": ORACLES["transform_filter"],
    "write_transforms_filtered_406": ORACLES["transform_qualify"],
    "write_transforms_filtered_411": "SELECT l_orderkey AS ORD_ID, CAST(l_extendedprice AS DECIMAL(12,2)) AS PRICE"
        + TECHNICAL_SQL.format(rid=411) + "FROM lineitem WHERE l_returnflag = 'R'",
}
