"""Data mart loads of orders and of part-supplier pairs, and the raw archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.mart import insert_new_mart, load_mart, merge_mart, new_mart_rows
from millrace.sources.dictionary import SourceColumn, SourceTable
from millrace.sources.tables import append_archive
from queries.common import AS_OF, KNOWN_UNTIL, moment, table

ORDERS = SourceTable("SALES", "ORDERS", (
    SourceColumn("ord_id", "BIGINT", key=True),
    SourceColumn("cust_id", "BIGINT"),
    SourceColumn("ord_sts", "VARCHAR(2)"),
    SourceColumn("ord_amt", "FLOAT"),
))
LINES = SourceTable("SALES", "LINES", (
    SourceColumn("flag", "VARCHAR(1)", key=True, partition=True),
    SourceColumn("part_id", "BIGINT", key=True),
    SourceColumn("lines", "BIGINT"),
))
PAIRS = SourceTable("SALES", "PART_SUPP", (
    SourceColumn("part_id", "BIGINT", key=True),
    SourceColumn("supp_id", "BIGINT", key=True),
))


def order_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as staged today; small orders carry no number."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_totalprice") >= 5000, F.col("o_orderkey")).alias("ord_id"),
        F.col("o_custkey").alias("cust_id"), F.col("o_orderstatus").alias("ord_sts"),
        F.col("o_totalprice").alias("ord_amt"), F.lit(7).alias("batch_id"), F.lit("orders.csv").alias("filename"),
        moment(AS_OF).alias("dump_dttm"),
    )


def order_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders placed before 2000 as merged four years ago, pending ones as open."""
    known = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < moment(KNOWN_UNTIL))
    return known.select(
        F.when(F.col("o_totalprice") >= 5000, F.col("o_orderkey")).alias("ord_id"),
        F.col("o_custkey").alias("cust_id"),
        F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("ord_sts"),
        F.col("o_totalprice").alias("ord_amt"), F.lit(3).alias("batch_id"),
        F.lit(None).cast("string").alias("filename"), moment("2020-01-01").alias("insrt_dttm"),
        F.lit(None).cast("timestamp_ntz").alias("updt_dttm"), moment("2020-01-01").alias("dump_dttm"),
    )


def pair_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return lines.select(
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"), F.lit(7).alias("batch_id"),
        F.lit("lines.csv").alias("filename"), moment(AS_OF).alias("dump_dttm"),
    )


def pair_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < moment("1998-01-01"))
    return lines.select("l_partkey", "l_suppkey").distinct().select(
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"), F.lit(3).alias("batch_id"),
        F.lit(None).cast("string").alias("filename"), moment("2020-01-01").alias("insrt_dttm"),
        F.lit(None).cast("timestamp_ntz").alias("updt_dttm"), moment("2020-01-01").alias("dump_dttm"),
    )


def line_counts(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """Order lines per return flag and part."""
    return table(spark, sf_dir, "lineitem").filter(condition).groupBy(
        F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part_id")
    ).agg(F.count(F.lit(1)).alias("lines"))


def line_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open lines of flags A and R; flag N is not reached."""
    return line_counts(spark, sf_dir, "l_returnflag <> 'N' AND l_linestatus = 'O'").select(
        "*", F.lit(7).alias("batch_id"), moment(AS_OF).alias("dump_dttm")
    )


def line_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished lines of all flags, and all lines of flag N."""
    return line_counts(spark, sf_dir, "l_linestatus = 'F' OR l_returnflag = 'N'").select(
        "*", F.lit(3).alias("batch_id"), moment("2020-01-01").alias("insrt_dttm"),
        F.lit(None).cast("timestamp_ntz").alias("updt_dttm"), moment("2020-01-01").alias("dump_dttm"),
    )


def order_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_mart(spark, sf_dir).select(
        "ord_id", "cust_id", "ord_sts", "ord_amt", "batch_id", F.lit("old.csv").alias("filename"), "dump_dttm"
    )


NATIONS = SourceTable("SALES", "NATIONS", (
    SourceColumn("name", "VARCHAR(50)", key=True, case_blind=True), SourceColumn("region", "BIGINT"),
))


def _blind_merge(spark, sf_dir):
    """Nations spelled in small letters, and regions as nations, merged into nations as spelled."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    stage = nations.select(F.lower("name").alias("name"), (F.col("region") + 100).alias("region")).unionByName(
        regions.select(F.concat(F.lit("r-"), "name").alias("name"), "region")
    )
    return load_mart(stage, nations, NATIONS, AS_OF)


def _blind_customers(spark, sf_dir):
    """Customers spelled in small letters, and suppliers as customers, merged into customers as spelled."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("region")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s-"), "s_name").alias("name"), F.col("s_nationkey").cast("long").alias("region")
    )
    stage = customers.select(F.lower("name").alias("name"), (F.col("region") + 100).alias("region")).unionByName(suppliers)
    return load_mart(stage, customers, NATIONS, AS_OF)


MERGE_SQL = """
WITH stage AS (
    SELECT CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ord_id, o_custkey AS cust_id,
           o_orderstatus AS ord_sts, o_totalprice AS ord_amt
    FROM orders
), mart AS (
    SELECT CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ord_id, o_custkey AS cust_id,
           CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS ord_sts, o_totalprice AS ord_amt
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
)
SELECT m.ord_id, COALESCE(s.cust_id, m.cust_id) AS cust_id, COALESCE(s.ord_sts, m.ord_sts) AS ord_sts,
       COALESCE(s.ord_amt, m.ord_amt) AS ord_amt, CAST(3 AS INTEGER) AS batch_id, CAST(NULL AS VARCHAR) AS filename,
       TIMESTAMP '2020-01-01 00:00:00' AS insrt_dttm,
       CASE WHEN s.ord_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' END AS updt_dttm,
       CASE WHEN s.ord_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00'
            ELSE TIMESTAMP '2020-01-01 00:00:00' END AS dump_dttm
FROM mart m LEFT JOIN stage s ON s.ord_id = m.ord_id
UNION ALL
SELECT s.ord_id, s.cust_id, s.ord_sts, s.ord_amt, CAST(7 AS INTEGER), CAST(NULL AS VARCHAR),
       TIMESTAMP '2024-06-01 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-06-01 00:00:00'
FROM stage s WHERE NOT EXISTS (SELECT 1 FROM mart m WHERE m.ord_id = s.ord_id)
"""
NEW_PAIRS_SQL = """
SELECT DISTINCT l_partkey AS part_id, l_suppkey AS supp_id, CAST(7 AS INTEGER) AS batch_id,
       CAST(NULL AS VARCHAR) AS filename, TIMESTAMP '2024-06-01 00:00:00' AS insrt_dttm,
       CAST(NULL AS TIMESTAMP) AS updt_dttm, TIMESTAMP '2024-06-01 00:00:00' AS dump_dttm
FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey
                  AND k.l_shipdate < TIMESTAMP '1998-01-01 00:00:00')
"""
ALL_PAIRS_SQL = """
SELECT DISTINCT l_partkey AS part_id, l_suppkey AS supp_id, CAST(3 AS INTEGER) AS batch_id,
       CAST(NULL AS VARCHAR) AS filename, TIMESTAMP '2020-01-01 00:00:00' AS insrt_dttm,
       CAST(NULL AS TIMESTAMP) AS updt_dttm, TIMESTAMP '2020-01-01 00:00:00' AS dump_dttm
FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
UNION ALL
""" + NEW_PAIRS_SQL

QUERIES = {
    "merge_mart": lambda s, d: merge_mart(order_stage(s, d), order_mart(s, d), ["ord_id"], AS_OF),
    "merge_mart_shuffled": lambda s, d: merge_mart(
        order_stage(s, d), order_mart(s, d), ["ord_id"], AS_OF, small_load=False
    ),
    "insert_new_mart": lambda s, d: insert_new_mart(pair_stage(s, d), pair_mart(s, d), PAIRS.keys, AS_OF),
    "new_mart_rows": lambda s, d: new_mart_rows(pair_stage(s, d), pair_mart(s, d), PAIRS.keys, AS_OF),
    "load_mart_merge": lambda s, d: load_mart(order_stage(s, d), order_mart(s, d), ORDERS, AS_OF),
    "load_mart_all_keys": lambda s, d: load_mart(pair_stage(s, d), pair_mart(s, d), PAIRS, AS_OF),
    "load_mart_partitioned": lambda s, d: load_mart(line_stage(s, d), line_mart(s, d), LINES, AS_OF),
    "load_mart_case_blind": _blind_merge,
    "load_mart_case_blind_customers": _blind_customers,
    "append_archive": lambda s, d: append_archive(order_stage(s, d), order_archive(s, d)),
}
ORACLES = {
    "merge_mart": MERGE_SQL,
    "merge_mart_shuffled": MERGE_SQL,
    "insert_new_mart": ALL_PAIRS_SQL,
    "new_mart_rows": NEW_PAIRS_SQL,
    "load_mart_merge": MERGE_SQL,
    "load_mart_all_keys": ALL_PAIRS_SQL,
    "load_mart_partitioned": """
        WITH stage AS (
            SELECT l_returnflag AS flag, l_partkey AS part_id, COUNT(*) AS lines FROM lineitem
            WHERE l_returnflag <> 'N' AND l_linestatus = 'O' GROUP BY ALL
        ), mart AS (
            SELECT l_returnflag AS flag, l_partkey AS part_id, COUNT(*) AS lines FROM lineitem
            WHERE l_linestatus = 'F' OR l_returnflag = 'N' GROUP BY ALL
        )
        SELECT COALESCE(m.flag, s.flag) AS flag, COALESCE(m.part_id, s.part_id) AS part_id,
               COALESCE(s.lines, m.lines) AS lines, CAST(CASE WHEN m.flag IS NULL THEN 7 ELSE 3 END AS INTEGER) AS batch_id,
               CASE WHEN m.flag IS NULL THEN TIMESTAMP '2024-06-01 00:00:00'
                    ELSE TIMESTAMP '2020-01-01 00:00:00' END AS insrt_dttm,
               CASE WHEN m.flag IS NOT NULL AND s.flag IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' END AS updt_dttm,
               CASE WHEN s.flag IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00'
                    ELSE TIMESTAMP '2020-01-01 00:00:00' END AS dump_dttm
        FROM mart m FULL OUTER JOIN stage s ON m.flag = s.flag AND m.part_id = s.part_id""",
    "load_mart_case_blind": """
        SELECT n_name AS name, n_regionkey + 100 AS region FROM nation
        UNION ALL SELECT concat('r-', r_name), r_regionkey FROM region""",
    "load_mart_case_blind_customers": """
        SELECT c_name AS name, c_nationkey::BIGINT + 100 AS region FROM customer
        UNION ALL SELECT concat('s-', s_name), s_nationkey::BIGINT FROM supplier""",
    "append_archive": """
        SELECT CASE WHEN o_totalprice >= 5000 THEN o_orderkey END AS ord_id, o_custkey AS cust_id,
               CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS ord_sts, o_totalprice AS ord_amt,
               CAST(3 AS INTEGER) AS batch_id, 'old.csv' AS filename, TIMESTAMP '2020-01-01 00:00:00' AS dump_dttm
        FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'
        UNION ALL
        SELECT CASE WHEN o_totalprice >= 5000 THEN o_orderkey END, o_custkey, o_orderstatus, o_totalprice,
               CAST(7 AS INTEGER), 'orders.csv', TIMESTAMP '2024-06-01 00:00:00' FROM orders""",
}
