"""Insert, upsert and delete-insert loads of orders.

The model knows the orders placed before 2000: pending ones as still open, unspecified
priorities as missing. The load brings all orders as they are now. Small orders carry no
number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.apply import (
    apply_delete_insert, apply_history_delete_insert, apply_insert, apply_upsert,
)
from millrace.operators.checks import check_not_null, check_unique, duplicate_keys, null_counts
from millrace.sources.dictionary import SourceColumn, SourceTable
from millrace.functions.predicates import sentinel_equal
from millrace.functions.types import parse_type
from millrace.plans.spec import ColumnSpec, MappingSpec
from queries.common import AS_OF, KNOWN_UNTIL, day, moment, table

COLUMNS = (
    ColumnSpec("ORD_ID", "BIGINT", pk=True, source_table="orders", source_column="o_orderkey", rule="1:1"),
    ColumnSpec("CUST_ID", "BIGINT", source_table="orders", source_column="o_custkey", rule="1:1"),
    ColumnSpec("ORD_STS", "VARCHAR(10)", source_table="orders", source_column="o_orderstatus", rule="1:1"),
    ColumnSpec("ORD_AMT", "FLOAT", source_table="orders", source_column="o_totalprice", rule="1:1"),
    ColumnSpec("ORD_PRTY", "VARCHAR(20)", source_table="orders", source_column="o_orderpriority", rule="1:1"),
    ColumnSpec("ORD_STRT_DT", "DATE", source_table="JOB", source_column="JOB", rule="JOB START"),
)
UPSERT_SPEC = MappingSpec(101, "ORDERS", "UPSERT", COLUMNS, source="SALES", from_table="orders")
INSERT_SPEC = MappingSpec(101, "ORDERS", "INSERT", COLUMNS, source="SALES", from_table="orders")


def order_number():
    return F.when(F.col("o_totalprice") >= 5000, F.col("o_orderkey"))


def order_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        order_number().alias("ORD_ID"),
        F.col("o_custkey").alias("CUST_ID"),
        F.col("o_orderstatus").alias("ORD_STS"),
        F.col("o_totalprice").alias("ORD_AMT"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "-").otherwise(F.col("o_orderpriority")).alias("ORD_PRTY"),
        day(AS_OF).alias("ORD_STRT_DT"),
        F.lit(101).alias("R_ID"),
        F.lit(20).cast("long").alias("B_ID"),
        moment(AS_OF).alias("INSRT_DTTM"),
        moment(AS_OF).alias("UPDT_DTTM"),
    )


def order_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < moment(KNOWN_UNTIL)).select(
        order_number().alias("ORD_ID"),
        F.col("o_custkey").alias("CUST_ID"),
        F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("ORD_STS"),
        F.col("o_totalprice").alias("ORD_AMT"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("ORD_PRTY"),
        day("2020-01-01").alias("ORD_STRT_DT"),
        F.lit(100).alias("R_ID"),
        F.lit(10).cast("long").alias("B_ID"),
        moment("2020-01-01").alias("INSRT_DTTM"),
        moment("2020-01-01").alias("UPDT_DTTM"),
    )


INPUTS_SQL = """
WITH load AS (
    SELECT CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ORD_ID, o_custkey AS CUST_ID,
           o_orderstatus AS ORD_STS, o_totalprice AS ORD_AMT,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '-' ELSE o_orderpriority END AS ORD_PRTY,
           DATE '2024-06-01' AS ORD_STRT_DT, CAST(101 AS INTEGER) AS R_ID, CAST(20 AS BIGINT) AS B_ID,
           TIMESTAMP '2024-06-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2024-06-01 00:00:00' AS UPDT_DTTM
    FROM orders
), model AS (
    SELECT CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ORD_ID, o_custkey AS CUST_ID,
           CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS ORD_STS, o_totalprice AS ORD_AMT,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS ORD_PRTY,
           DATE '2020-01-01' AS ORD_STRT_DT, CAST(100 AS INTEGER) AS R_ID, CAST(10 AS BIGINT) AS B_ID,
           TIMESTAMP '2020-01-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2020-01-01 00:00:00' AS UPDT_DTTM
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
), flagged AS (
    SELECT l.*, CASE WHEN l.ORD_ID IS NULL THEN NULL
                     WHEN m.ORD_ID IS NULL THEN 'I'
                     WHEN COALESCE(l.CUST_ID, -1) = COALESCE(m.CUST_ID, -1)
                      AND COALESCE(l.ORD_STS, '-') = COALESCE(m.ORD_STS, '-')
                      AND COALESCE(l.ORD_AMT, -1) = COALESCE(m.ORD_AMT, -1)
                      AND COALESCE(l.ORD_PRTY, '-') = COALESCE(m.ORD_PRTY, '-') THEN 'D'
                     ELSE '{changed}' END AS FLAG
    FROM load l LEFT JOIN model m ON l.ORD_ID = m.ORD_ID
)
"""
UPSERT_SQL, INSERT_SQL = INPUTS_SQL.format(changed="U"), INPUTS_SQL.format(changed="X")
ALL = "ORD_ID, CUST_ID, ORD_STS, ORD_AMT, ORD_PRTY, ORD_STRT_DT, R_ID, B_ID, INSRT_DTTM, UPDT_DTTM"
UPSERT_MODEL_SQL = UPSERT_SQL + f"""
SELECT m.ORD_ID, COALESCE(u.CUST_ID, m.CUST_ID) AS CUST_ID, COALESCE(u.ORD_STS, m.ORD_STS) AS ORD_STS,
       COALESCE(u.ORD_AMT, m.ORD_AMT) AS ORD_AMT,
       CASE WHEN u.ORD_ID IS NOT NULL THEN u.ORD_PRTY ELSE m.ORD_PRTY END AS ORD_PRTY,
       m.ORD_STRT_DT, m.R_ID, COALESCE(u.B_ID, m.B_ID) AS B_ID, m.INSRT_DTTM,
       COALESCE(u.UPDT_DTTM, m.UPDT_DTTM) AS UPDT_DTTM
FROM model m LEFT JOIN (SELECT * FROM flagged WHERE FLAG = 'U') u ON m.ORD_ID = u.ORD_ID
UNION ALL SELECT {ALL} FROM flagged WHERE FLAG = 'I'
"""


def _insert(spark, sf_dir, **options):
    return apply_insert(order_load(spark, sf_dir), order_model(spark, sf_dir), INSERT_SPEC, **options)


def _upsert(spark, sf_dir, **options):
    return apply_upsert(order_load(spark, sf_dir), order_model(spark, sf_dir), UPSERT_SPEC, **options)


def line_model(spark, sf_dir):
    """Amounts per document, filled by seven mappings: one record id per line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("DOC_ID"),
        F.col("l_partkey").alias("ITEM_ID"),
        F.col("l_extendedprice").alias("AMT"),
        F.col("l_shipdate").cast("date").alias("DOC_STRT_DT"),
        day("9999-12-31").alias("DOC_END_DT"),
        F.col("l_linenumber").alias("R_ID"),
        F.lit(10).cast("long").alias("B_ID"),
    )


def line_load(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("DOC_ID"),
        F.col("o_custkey").alias("ITEM_ID"),
        F.col("o_totalprice").alias("AMT"),
        F.col("o_orderdate").cast("date").alias("DOC_STRT_DT"),
        day("9999-12-31").alias("DOC_END_DT"),
        F.lit(3).alias("R_ID"),
        F.lit(20).cast("long").alias("B_ID"),
    )


DELETE_INSERT_SQL = """
SELECT l_orderkey AS DOC_ID, l_partkey AS ITEM_ID, l_extendedprice AS AMT,
       CAST(l_shipdate AS DATE) AS DOC_STRT_DT, DATE '9999-12-31' AS DOC_END_DT,
       l_linenumber AS R_ID, CAST(10 AS BIGINT) AS B_ID
FROM lineitem WHERE l_linenumber <> 3
UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE), DATE '9999-12-31',
       CAST(3 AS INTEGER), CAST(20 AS BIGINT)
FROM orders
"""


def sentinel_query(spark, sf_dir):
    """Each order's priority and amount as known before and now, compared with sentinels."""
    load, model = order_load(spark, sf_dir).alias("n"), order_model(spark, sf_dir).alias("o")
    return load.join(model, F.col("n.ORD_ID") == F.col("o.ORD_ID"), "left").select(
        "n.ORD_ID",
        sentinel_equal(F.col("n.ORD_PRTY"), F.col("o.ORD_PRTY"), parse_type("VARCHAR(20)")).alias("same_text"),
        sentinel_equal(F.col("n.ORD_AMT"), F.col("o.ORD_AMT"), parse_type("FLOAT")).alias("same_number"),
        sentinel_equal(F.col("n.ORD_STRT_DT"), F.col("o.ORD_STRT_DT"), parse_type("DATE")).alias("same_day"),
        sentinel_equal(F.col("n.UPDT_DTTM"), F.lit(None).cast("timestamp_ntz"), parse_type("TIMESTAMP")).alias("same_time"),
    )


WHOLE_ORDERS = SourceTable("SALES", "ORDERS", (
    SourceColumn("o_orderkey", "BIGINT", key=True), SourceColumn("o_custkey", "BIGINT", nullable=False),
))


def _checked_values(spark, sf_dir):
    """Orders pass the check of their required values; what load and model miss is counted."""
    check_not_null(table(spark, sf_dir, "orders"), WHOLE_ORDERS)
    both = order_load(spark, sf_dir).unionByName(order_model(spark, sf_dir))
    return null_counts(both, ["ORD_ID", "CUST_ID", "ORD_PRTY", "ORD_AMT"])


def _checked_keys(spark, sf_dir):
    """Orders pass the check of their key; repeated keys of order lines are listed."""
    check_unique(table(spark, sf_dir, "orders"), WHOLE_ORDERS.keys)
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


QUERIES = {
    "apply_upsert": lambda s, d: _upsert(s, d).target,
    "apply_upsert_shuffled": lambda s, d: _upsert(s, d, small_load=False).target,
    "apply_upsert_flags": lambda s, d: _upsert(s, d).flagged,
    "apply_upsert_duplicates": lambda s, d: _upsert(s, d).duplicates,
    "apply_upsert_outcome": lambda s, d: _upsert(s, d).outcome,
    "apply_insert": lambda s, d: _insert(s, d).target,
    "apply_insert_shuffled": lambda s, d: _insert(s, d, small_load=False).target,
    "apply_insert_flags": lambda s, d: _insert(s, d).flagged,
    "apply_insert_duplicates": lambda s, d: _insert(s, d).duplicates,
    "apply_delete_insert": lambda s, d: apply_delete_insert(line_load(s, d), line_model(s, d), 3).target,
    "apply_history_delete_insert": lambda s, d: apply_history_delete_insert(line_load(s, d), line_model(s, d), 3).target,
    "apply_delete_insert_flags": lambda s, d: apply_delete_insert(line_load(s, d), line_model(s, d), 3).flagged,
    "sentinel_equal": sentinel_query,
    "check_not_null": _checked_values,
    "check_unique": _checked_keys,
}

ORACLES = {
    "apply_upsert": UPSERT_MODEL_SQL,
    "apply_upsert_shuffled": UPSERT_MODEL_SQL,
    "apply_upsert_flags": UPSERT_SQL + "SELECT * FROM flagged",
    "apply_upsert_duplicates": UPSERT_SQL + f"SELECT {ALL} FROM flagged WHERE FLAG = 'D'",
    "apply_upsert_outcome": UPSERT_MODEL_SQL.replace(
        UPSERT_SQL, UPSERT_SQL + f"SELECT {ALL}, 'duplicates' AS DEST FROM flagged WHERE FLAG = 'D' UNION ALL SELECT *, 'model' FROM ("
    ) + ")",
    "apply_insert": INSERT_SQL + f"SELECT * FROM model UNION ALL SELECT {ALL} FROM flagged WHERE FLAG = 'I'",
    "apply_insert_shuffled": INSERT_SQL + f"SELECT * FROM model UNION ALL SELECT {ALL} FROM flagged WHERE FLAG = 'I'",
    "apply_insert_flags": INSERT_SQL + "SELECT * FROM flagged",
    "apply_insert_duplicates": INSERT_SQL + f"SELECT {ALL} FROM flagged WHERE FLAG = 'D'",
    "apply_delete_insert": DELETE_INSERT_SQL,
    "apply_history_delete_insert": DELETE_INSERT_SQL,
    "apply_delete_insert_flags": """
        SELECT o_orderkey AS DOC_ID, o_custkey AS ITEM_ID, o_totalprice AS AMT,
               CAST(o_orderdate AS DATE) AS DOC_STRT_DT, DATE '9999-12-31' AS DOC_END_DT,
               CAST(3 AS INTEGER) AS R_ID, CAST(20 AS BIGINT) AS B_ID, 'DI' AS FLAG FROM orders""",
    "sentinel_equal": UPSERT_SQL + """
        SELECT l.ORD_ID, COALESCE(l.ORD_PRTY, '-') = COALESCE(m.ORD_PRTY, '-') AS same_text,
               COALESCE(l.ORD_AMT, -1) = COALESCE(m.ORD_AMT, -1) AS same_number,
               COALESCE(l.ORD_STRT_DT, DATE '1001-01-01') = COALESCE(m.ORD_STRT_DT, DATE '1001-01-01') AS same_day,
               COALESCE(l.UPDT_DTTM, TIMESTAMP '1001-01-01 00:00:00') = TIMESTAMP '1001-01-01 00:00:00' AS same_time
        FROM load l LEFT JOIN model m ON l.ORD_ID = m.ORD_ID""",
    "check_not_null": UPSERT_SQL + """, both_sides AS (SELECT * FROM load UNION ALL SELECT * FROM model)
        SELECT 'ORD_ID' AS column_name, COUNT(*) FILTER (WHERE ORD_ID IS NULL) AS missing FROM both_sides
        UNION ALL SELECT 'CUST_ID', COUNT(*) FILTER (WHERE CUST_ID IS NULL) FROM both_sides
        UNION ALL SELECT 'ORD_PRTY', COUNT(*) FILTER (WHERE ORD_PRTY IS NULL) FROM both_sides
        UNION ALL SELECT 'ORD_AMT', COUNT(*) FILTER (WHERE ORD_AMT IS NULL) FROM both_sides""",
    "check_unique": """
        SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
}
