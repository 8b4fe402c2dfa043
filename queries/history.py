"""History loads: versions of orders by status, and of customers by their dated orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.types import end_before, high_value, parse_type
from millrace.operators.history import apply_history, apply_history_auto, apply_history_legacy
from millrace.operators.windows import first_by, next_start, previous
from millrace.plans.spec import ColumnSpec, MappingSpec
from millrace.sources.publish import publish, read_model
from queries.common import AS_OF, KNOWN_UNTIL, day, fresh_folder, moment, table

ORDER_VERSIONS = MappingSpec(
    201, "ORDER_VERSIONS", "HISTORY",
    (
        ColumnSpec("ORD_ID", "BIGINT", pk=True, role="HKEY"),
        ColumnSpec("ORD_STS", "VARCHAR(10)", role="HCOL"),
        ColumnSpec("ORD_PRTY", "VARCHAR(20)", role="HCOL"),
        ColumnSpec("ORD_STRT_DT", "DATE", role="S", source_table="JOB", source_column="JOB"),
        ColumnSpec("ORD_END_DT", "DATE", role="E", source_table="JOB", source_column="JOB"),
    ),
)
CUSTOMER_VERSIONS = MappingSpec(
    202, "CUSTOMER_VERSIONS", "HISTORY_LEGACY",
    (
        ColumnSpec("CUST_ID", "BIGINT", pk=True, role="HKEY"),
        ColumnSpec("LAST_STS", "VARCHAR(10)", role="HCOL"),
        ColumnSpec("LAST_PRTY", "VARCHAR(20)", role="HCOL"),
        ColumnSpec("CUST_STRT_DT", "DATE", role="S", source_table="orders", source_column="o_orderdate"),
        ColumnSpec("CUST_END_DT", "DATE", role="E", source_table="JOB", source_column="JOB"),
    ),
)


def technical(record_id: int, batch, at: str):
    return [
        F.lit(record_id).alias("R_ID"), batch.cast("long").alias("B_ID"),
        moment(at).alias("INSRT_DTTM"), moment(at).alias("UPDT_DTTM"),
    ]


def version_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as they are now; small orders carry no number."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_totalprice") >= 5000, F.col("o_orderkey")).alias("ORD_ID"),
        F.col("o_orderstatus").alias("ORD_STS"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "-").otherwise(F.col("o_orderpriority")).alias("ORD_PRTY"),
        day(AS_OF).alias("ORD_STRT_DT"),
        day("9999-12-31").alias("ORD_END_DT"),
        *technical(201, F.lit(20), AS_OF),
    )


def version_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed first version of every order, an open one of orders placed before 2000."""
    orders = table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate").cast("date")
    closed = orders.select(
        F.col("o_orderkey").alias("ORD_ID"), F.lit("N").alias("ORD_STS"), F.col("o_orderpriority").alias("ORD_PRTY"),
        F.date_sub(placed, 30).alias("ORD_STRT_DT"), F.date_sub(placed, 1).alias("ORD_END_DT"),
        *technical(201, F.lit(5), "2019-01-01"),
    )
    open_versions = orders.filter(F.col("o_orderdate") < moment(KNOWN_UNTIL)).select(
        F.col("o_orderkey").alias("ORD_ID"),
        F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("ORD_STS"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("ORD_PRTY"),
        placed.alias("ORD_STRT_DT"), day("9999-12-31").alias("ORD_END_DT"),
        *technical(201, F.lit(10), "2020-01-01"),
    )
    return closed.unionByName(open_versions)


def dated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a dated row of its customer; a customer may have two on a day."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("CUST_ID"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("LAST_STS"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("LAST_PRTY"),
        F.col("o_orderdate").cast("date").alias("CUST_STRT_DT"),
        day("9999-12-31").alias("CUST_END_DT"),
        *technical(202, F.col("o_orderkey"), AS_OF),
    )


def dated_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older versions: on the day of each finished order, and fifty years before every order."""
    orders = table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate").cast("date")
    same_day = orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("CUST_ID"), F.lit("Z").alias("LAST_STS"), F.col("o_orderpriority").alias("LAST_PRTY"),
        placed.alias("CUST_STRT_DT"), day("9999-12-31").alias("CUST_END_DT"),
        *technical(202, F.col("o_orderkey") - 1_000_000_000_000, "2020-01-01"),
    )
    long_ago = orders.select(
        F.col("o_custkey").alias("CUST_ID"), F.col("o_orderstatus").alias("LAST_STS"),
        F.col("o_orderpriority").alias("LAST_PRTY"),
        F.add_months(placed, -600).alias("CUST_STRT_DT"), placed.alias("CUST_END_DT"),
        *technical(202, F.lit(1), "2020-01-01"),
    )
    return same_day.unionByName(long_ago)


def latest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer as today's version."""
    latest = first_by(
        table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    )
    return latest.select(
        F.col("o_custkey").alias("CUST_ID"), F.col("o_orderstatus").alias("LAST_STS"),
        F.col("o_orderpriority").alias("LAST_PRTY"), day(AS_OF).alias("CUST_STRT_DT"),
        day("9999-12-31").alias("CUST_END_DT"), *technical(202, F.lit(2_000_000_000_000).cast("long"), AS_OF),
    )


VERSION_SQL = """
WITH load AS (
    SELECT CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ORD_ID, o_orderstatus AS ORD_STS,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '-' ELSE o_orderpriority END AS ORD_PRTY,
           DATE '2024-06-01' AS ORD_STRT_DT, DATE '9999-12-31' AS ORD_END_DT,
           CAST(201 AS INTEGER) AS R_ID, CAST(20 AS BIGINT) AS B_ID,
           TIMESTAMP '2024-06-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2024-06-01 00:00:00' AS UPDT_DTTM
    FROM orders
), model AS (
    SELECT o_orderkey AS ORD_ID, 'N' AS ORD_STS, o_orderpriority AS ORD_PRTY,
           CAST(o_orderdate AS DATE) - 30 AS ORD_STRT_DT, CAST(o_orderdate AS DATE) - 1 AS ORD_END_DT,
           CAST(201 AS INTEGER) AS R_ID, CAST(5 AS BIGINT) AS B_ID,
           TIMESTAMP '2019-01-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2019-01-01 00:00:00' AS UPDT_DTTM
    FROM orders
    UNION ALL
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END,
           CAST(o_orderdate AS DATE), DATE '9999-12-31', CAST(201 AS INTEGER), CAST(10 AS BIGINT),
           TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP '2020-01-01 00:00:00'
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
), flagged AS (
    SELECT l.*, CASE WHEN l.ORD_ID IS NULL OR l.ORD_STRT_DT IS NULL THEN NULL
                     WHEN m.ORD_ID IS NULL THEN 'I'
                     WHEN COALESCE(l.ORD_STS, '-') = COALESCE(m.ORD_STS, '-')
                      AND COALESCE(l.ORD_PRTY, '-') = COALESCE(m.ORD_PRTY, '-') THEN 'D'
                     ELSE 'U' END AS FLAG
    FROM load l LEFT JOIN model m ON l.ORD_ID = m.ORD_ID AND l.ORD_END_DT = m.ORD_END_DT
)
"""
VERSION_COLUMNS = "ORD_ID, ORD_STS, ORD_PRTY, ORD_STRT_DT, ORD_END_DT, R_ID, B_ID, INSRT_DTTM, UPDT_DTTM"

REBUILD_SQL = """
WITH load AS (
    SELECT o_custkey AS CUST_ID, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS LAST_STS,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS LAST_PRTY,
           CAST(o_orderdate AS DATE) AS CUST_STRT_DT, DATE '9999-12-31' AS CUST_END_DT,
           CAST(202 AS INTEGER) AS R_ID, o_orderkey AS B_ID,
           TIMESTAMP '2024-06-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2024-06-01 00:00:00' AS UPDT_DTTM
    FROM orders
), old_model AS (
    SELECT o_custkey AS CUST_ID, 'Z' AS LAST_STS, o_orderpriority AS LAST_PRTY,
           CAST(o_orderdate AS DATE) AS CUST_STRT_DT, DATE '9999-12-31' AS CUST_END_DT,
           CAST(202 AS INTEGER) AS R_ID, o_orderkey - 1000000000000 AS B_ID,
           TIMESTAMP '2020-01-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2020-01-01 00:00:00' AS UPDT_DTTM
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT o_custkey, o_orderstatus, o_orderpriority,
           CAST(CAST(o_orderdate AS DATE) - INTERVAL 600 MONTH AS DATE), CAST(o_orderdate AS DATE),
           CAST(202 AS INTEGER), CAST(1 AS BIGINT),
           TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP '2020-01-01 00:00:00'
    FROM orders
), merged AS (
    SELECT *, 1 AS incoming FROM load
    UNION ALL
    SELECT *, 0 FROM old_model m
    WHERE EXISTS (SELECT 1 FROM load l WHERE l.CUST_ID = m.CUST_ID AND l.CUST_STRT_DT = m.CUST_STRT_DT)
), single AS (
    SELECT * FROM merged
    QUALIFY ROW_NUMBER() OVER (PARTITION BY CUST_ID, CUST_STRT_DT ORDER BY B_ID ASC NULLS FIRST, incoming) = 1
), seen AS (
    SELECT *, LAG(LAST_STS) OVER w AS pre_sts, LAG(LAST_PRTY) OVER w AS pre_prty
    FROM single WINDOW w AS (PARTITION BY CUST_ID ORDER BY CUST_STRT_DT)
), kept AS (
    SELECT * FROM seen
    WHERE (pre_sts IS NULL AND pre_prty IS NULL) OR pre_sts <> LAST_STS OR pre_prty <> LAST_PRTY
), model AS (
    SELECT * FROM old_model m
    WHERE NOT EXISTS (SELECT 1 FROM load l WHERE l.CUST_ID = m.CUST_ID AND l.CUST_STRT_DT = m.CUST_STRT_DT)
    UNION ALL
    SELECT CUST_ID, LAST_STS, LAST_PRTY, CUST_STRT_DT,
           COALESCE(LEAD(CUST_STRT_DT) OVER (PARTITION BY CUST_ID ORDER BY CUST_STRT_DT), DATE '9999-12-31'),
           R_ID, B_ID, INSRT_DTTM, UPDT_DTTM
    FROM kept
)
"""
LATER_RUN_SQL = REBUILD_SQL + """, today AS (
    SELECT o_custkey AS CUST_ID, o_orderstatus AS LAST_STS, o_orderpriority AS LAST_PRTY,
           DATE '2024-06-01' AS CUST_STRT_DT, DATE '9999-12-31' AS CUST_END_DT, CAST(202 AS INTEGER) AS R_ID,
           CAST(2000000000000 AS BIGINT) AS B_ID, TIMESTAMP '2024-06-01 00:00:00' AS INSRT_DTTM,
           TIMESTAMP '2024-06-01 00:00:00' AS UPDT_DTTM
    FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
), flagged AS (
    SELECT l.*, CASE WHEN m.CUST_ID IS NULL THEN 'I'
                     WHEN COALESCE(l.LAST_STS, '-') = COALESCE(m.LAST_STS, '-')
                      AND COALESCE(l.LAST_PRTY, '-') = COALESCE(m.LAST_PRTY, '-') THEN 'D'
                     ELSE 'U' END AS FLAG
    FROM today l LEFT JOIN model m ON l.CUST_ID = m.CUST_ID AND l.CUST_END_DT = m.CUST_END_DT
)
SELECT m.CUST_ID, m.LAST_STS, m.LAST_PRTY, m.CUST_STRT_DT,
       CASE WHEN u.CUST_ID IS NULL THEN m.CUST_END_DT ELSE u.CUST_STRT_DT - 1 END AS CUST_END_DT, m.R_ID,
       COALESCE(u.B_ID, m.B_ID) AS B_ID, m.INSRT_DTTM, COALESCE(u.UPDT_DTTM, m.UPDT_DTTM) AS UPDT_DTTM
FROM model m LEFT JOIN (SELECT * FROM flagged WHERE FLAG = 'U') u
  ON m.CUST_ID = u.CUST_ID AND m.CUST_END_DT = u.CUST_END_DT
UNION ALL
SELECT CUST_ID, LAST_STS, LAST_PRTY, CUST_STRT_DT, CUST_END_DT, R_ID, B_ID, INSRT_DTTM, UPDT_DTTM
FROM flagged WHERE FLAG IN ('I', 'U')
"""


def _history(spark, sf_dir, **options):
    return apply_history(version_load(spark, sf_dir), version_model(spark, sf_dir), ORDER_VERSIONS, **options)


def _rebuild(spark, sf_dir, **options):
    return apply_history_legacy(dated_load(spark, sf_dir), dated_model(spark, sf_dir), CUSTOMER_VERSIONS, **options)


def _later_run(spark, sf_dir):
    """The first load rebuilds and is published; the next one closes and inserts on what was published."""
    folder = fresh_folder(spark)
    first = apply_history_auto(dated_load(spark, sf_dir), dated_model(spark, sf_dir), CUSTOMER_VERSIONS, initial=True)
    publish(spark, folder, "CUSTOMERS", first)
    model = read_model(spark, folder, "CUSTOMERS")
    return apply_history_auto(latest_load(spark, sf_dir), model, CUSTOMER_VERSIONS, initial=False).target


def version_ends(spark, sf_dir):
    """The last moment before each event, and the open end, at every precision."""
    def text(column):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")

    types = {"day": "DATE", "whole": "TIMESTAMP(0)", "milli": "TIMESTAMP(3)", "micro": "TIMESTAMP"}
    parsed = {n: parse_type(t) for n, t in types.items()}
    return table(spark, sf_dir, "events").select(
        "event_id",
        *(text(end_before(F.col("ts"), t)).alias(f"before_{n}") for n, t in parsed.items()),
        *(text(high_value(t)).alias(f"high_{n}") for n, t in parsed.items()),
    )


def neighbours_query(spark, sf_dir, **options):
    """Each event with the type and value of the user's previous event."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    return previous(events, ["event_type", "value"], ["user_id"], "ts", **options)


def next_start_query(spark, sf_dir, **options):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return next_start(events, ["user_id"], "ts", "until", moment("2099-12-31 23:59:59.999999"), **options)


def undated_events(spark, sf_dir):
    """All events; the first one of each user has no time."""
    first = first_by(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select(F.col("event_id").alias("first"))
    events = table(spark, sf_dir, "events").join(first, F.col("event_id") == F.col("first"), "left")
    return events.select("user_id", F.when(F.col("first").isNull(), F.col("ts")).alias("ts"), "event_type", "value")


def _previous_undated(spark, sf_dir, **options):
    return previous(undated_events(spark, sf_dir), ["event_type", "value"], ["user_id"], "ts", **options)


def _rebuild_undated(spark, sf_dir, **options):
    """The rebuild of a load whose rows of low priority have no start."""
    start = F.when(F.col("LAST_PRTY") != "5-LOW", F.col("CUST_STRT_DT"))
    load = dated_load(spark, sf_dir).withColumn("CUST_STRT_DT", F.when(F.col("LAST_PRTY").isNull(), F.col("CUST_STRT_DT")).otherwise(start))
    return apply_history_legacy(load, dated_model(spark, sf_dir), CUSTOMER_VERSIONS, **options)


def _sourced_ends(spark, sf_dir):
    """Rows that end when the first version of their order did, never, or at no known day."""
    ended = version_load(spark, sf_dir).join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("placed")),
        F.col("ORD_ID") == F.col("k"), "left",
    )
    end = F.when(F.col("ORD_STS") == "F", F.date_sub("placed", 1)).when(F.col("ORD_STS") == "O", F.col("ORD_END_DT"))
    load = ended.withColumn("ORD_END_DT", end).drop("k", "placed")
    return apply_history(load, version_model(spark, sf_dir), ORDER_VERSIONS).target


PREVIOUS_SQL = """
SELECT user_id, ts, event_type, value, LAG(event_type) OVER w AS PRE_event_type, LAG(value) OVER w AS PRE_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
"""
NEXT_SQL = """
SELECT user_id, event_id, ts, COALESCE(LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts),
       TIMESTAMP '2099-12-31 23:59:59.999999') AS "until" FROM events
"""

QUERIES = {
    "apply_history": lambda s, d: _history(s, d).target,
    "apply_history_shuffled": lambda s, d: _history(s, d, small_load=False).target,
    "apply_history_flags": lambda s, d: _history(s, d).flagged,
    "apply_history_duplicates": lambda s, d: _history(s, d).duplicates,
    "apply_history_legacy": lambda s, d: _rebuild(s, d).target,
    "apply_history_legacy_long_keys": lambda s, d: _rebuild(s, d, hot_rows=8).target,
    "apply_history_legacy_null_start": lambda s, d: _rebuild_undated(s, d).target,
    "apply_history_legacy_null_start_long_keys": lambda s, d: _rebuild_undated(s, d, hot_rows=2).target,
    "apply_history_sourced_ends": _sourced_ends,
    "apply_history_auto": _later_run,
    "end_before": version_ends,
    "previous": neighbours_query,
    "previous_long_keys": lambda s, d: neighbours_query(s, d, hot_rows=20),
    "previous_null_start": _previous_undated,
    "previous_null_start_long_keys": lambda s, d: _previous_undated(s, d, hot_rows=5),
    "next_start": next_start_query,
    "next_start_long_keys": lambda s, d: next_start_query(s, d, hot_rows=20),
    "first_by": lambda s, d: first_by(
        table(s, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], n=3
    ),
}

ORACLES = {
    "apply_history": VERSION_SQL + f"""
        SELECT m.ORD_ID, m.ORD_STS, m.ORD_PRTY, m.ORD_STRT_DT,
               CASE WHEN u.ORD_ID IS NULL THEN m.ORD_END_DT ELSE u.ORD_STRT_DT - 1 END AS ORD_END_DT, m.R_ID,
               COALESCE(u.B_ID, m.B_ID) AS B_ID, m.INSRT_DTTM, COALESCE(u.UPDT_DTTM, m.UPDT_DTTM) AS UPDT_DTTM
        FROM model m LEFT JOIN (SELECT * FROM flagged WHERE FLAG = 'U') u
          ON m.ORD_ID = u.ORD_ID AND m.ORD_END_DT = u.ORD_END_DT
        UNION ALL SELECT {VERSION_COLUMNS} FROM flagged WHERE FLAG IN ('I', 'U')""",
    "apply_history_flags": VERSION_SQL + "SELECT * FROM flagged",
    "apply_history_duplicates": VERSION_SQL + f"SELECT {VERSION_COLUMNS} FROM flagged WHERE FLAG = 'D'",
    "apply_history_legacy": REBUILD_SQL + "SELECT * FROM model",
    "apply_history_auto": LATER_RUN_SQL,
    "end_before": """
        SELECT event_id,
               strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d %H:%M:%S.%f') AS before_day,
               strftime(ts - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS before_whole,
               strftime(ts - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%f') AS before_milli,
               strftime(ts - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS before_micro,
               '9999-12-31 00:00:00.000000' AS high_day, '9999-12-31 23:59:59.000000' AS high_whole,
               '9999-12-31 23:59:59.999000' AS high_milli, '9999-12-31 23:59:59.999999' AS high_micro
        FROM events""",
    "previous": PREVIOUS_SQL,
    "next_start": NEXT_SQL,
    "first_by": """
        SELECT * FROM events
        QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""",
}
ORACLES["apply_history_shuffled"] = ORACLES["apply_history"]
ORACLES["apply_history_legacy_long_keys"] = ORACLES["apply_history_legacy"]
ORACLES["previous_long_keys"] = PREVIOUS_SQL
ORACLES["next_start_long_keys"] = NEXT_SQL

VERSION_TARGET_SQL = ORACLES["apply_history"].removeprefix(VERSION_SQL)
ORACLES["apply_history_sourced_ends"] = VERSION_SQL.replace(
    "DATE '2024-06-01' AS ORD_STRT_DT, DATE '9999-12-31' AS ORD_END_DT",
    "DATE '2024-06-01' AS ORD_STRT_DT, CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 5000 "
    "THEN CAST(o_orderdate AS DATE) - 1 WHEN o_orderstatus = 'O' THEN DATE '9999-12-31' END AS ORD_END_DT", 1,
) + VERSION_TARGET_SQL
ORACLES["apply_history_legacy_null_start"] = REBUILD_SQL.replace(
    "CAST(o_orderdate AS DATE) AS CUST_STRT_DT, DATE '9999-12-31' AS CUST_END_DT",
    "CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS CUST_STRT_DT, "
    "DATE '9999-12-31' AS CUST_END_DT", 1,
).replace("ORDER BY CUST_STRT_DT)", "ORDER BY CUST_STRT_DT NULLS FIRST)") + "SELECT * FROM model"
ORACLES["apply_history_legacy_null_start_long_keys"] = ORACLES["apply_history_legacy_null_start"]
ORACLES["previous_null_start"] = """
    WITH undated AS (
        SELECT user_id, CASE WHEN event_id <> MIN(event_id) OVER (PARTITION BY user_id) THEN ts END AS ts, event_type, value
        FROM events)
    SELECT *, LAG(event_type) OVER w AS PRE_event_type, LAG(value) OVER w AS PRE_value
    FROM undated WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST)"""
ORACLES["previous_null_start_long_keys"] = ORACLES["previous_null_start"]
