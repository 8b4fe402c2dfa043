"""Surrogate keys of part-supplier pairs, taken from all order lines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.keys import (
    append_surrogates, assign_keys, load_surrogates, lookup_key, max_key, new_keys,
)
from millrace.plans.numbering import number_rows
from millrace.plans.spec import Join, SurrogateSpec
from millrace.plans.surrogates import publish_surrogates
from millrace.sources.publish import publish, read_model, truncate_load
from queries.common import AS_OF, fresh_folder, moment, table

PAIR_KEYS = SurrogateSpec(
    record_id=301, entity="PART_SUPP_SGK", key="PAIR_ID", natural_key="SRC_KEY", natural_type="VARCHAR(50)",
    sgk_id=1, source="3-MEDIUM", source_table="lines", source_column="pair", null_columns=("SRC_NAME",),
)
CUSTOMER_LINE_KEYS = SurrogateSpec(
    record_id=302, entity="PART_SUPP_SGK", key="PAIR_ID", natural_key="SRC_KEY", natural_type="VARCHAR(50)",
    sgk_id=3, source="5-LOW", source_table="lines", source_column="pair", null_columns=("SRC_NAME",),
    joins=(Join("orders", "lines.l_orderkey = o.o_orderkey", alias="o", how="inner"),),
    where="o.o_orderstatus = 'F' AND lines.l_returnflag = 'R'",
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines with the natural key of their pair; lines without discount have none."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag",
        F.when(F.col("l_discount") > 0, F.concat_ws("-", "l_partkey", "l_suppkey")).alias("pair"),
    )


def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs shipped before 1998 under SGK_ID 1, customers under SGK_ID 2."""
    filler = (F.lit(None).cast("string").alias("SRC_NAME"),)
    old = moment("2020-01-01")
    rest = (F.lit(300).alias("R_ID"), F.lit(1).cast("long").alias("B_ID"), old.alias("INSRT_DTTM"), old.alias("UPDT_DTTM"))
    shipped = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < moment("1998-01-01"))
    pairs = shipped.select("l_partkey", "l_suppkey").distinct().select(
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("PAIR_ID"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("SRC_KEY"), *filler,
        F.lit(1).cast("short").alias("SGK_ID"), *rest,
    )
    customers = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1_000_000_000_000).alias("PAIR_ID"),
        F.col("c_name").alias("SRC_KEY"), *filler, F.lit(2).cast("short").alias("SGK_ID"), *rest,
    )
    return pairs.unionByName(customers)


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order counts as a batch of its priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("B_ID"), F.col("o_orderpriority").alias("B_SOURCE")
    )


SGK_SQL = """
WITH lines AS (
    SELECT l_orderkey, l_returnflag,
           CASE WHEN l_discount > 0 THEN concat(l_partkey, '-', l_suppkey) END AS pair
    FROM lineitem
), sgk AS (
    SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS PAIR_ID, concat(l_partkey, '-', l_suppkey) AS SRC_KEY,
           CAST(1 AS SMALLINT) AS SGK_ID
    FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
    UNION ALL
    SELECT c_custkey + 1000000000000, c_name, CAST(2 AS SMALLINT) FROM customer
)
"""
NEW_SQL = SGK_SQL + """, new_rows AS (
    SELECT l.pair AS SRC_KEY FROM lines l
    WHERE NOT EXISTS (SELECT 1 FROM sgk k WHERE k.SGK_ID = 1 AND k.SRC_KEY = l.pair)
)
"""
ASSIGN_SQL = """
SELECT CAST((SELECT COALESCE(MAX(PAIR_ID), 0) FROM sgk) + ROW_NUMBER() OVER (ORDER BY SRC_KEY DESC NULLS LAST) AS BIGINT)
       AS PAIR_ID, SRC_KEY
"""
FILLED_SQL = """, CAST(NULL AS VARCHAR) AS SRC_NAME, CAST({sgk} AS SMALLINT) AS SGK_ID, CAST({rid} AS INTEGER) AS R_ID,
       (SELECT COALESCE(MAX(o_orderkey), 0) FROM orders WHERE o_orderpriority = '{source}') AS B_ID,
       TIMESTAMP '2024-06-01 00:00:00' AS INSRT_DTTM, TIMESTAMP '2024-06-01 00:00:00' AS UPDT_DTTM
"""


def _assigned(spark, sf_dir):
    sgk = surrogates(spark, sf_dir)
    return assign_keys(new_keys(lines(spark, sf_dir), sgk, PAIR_KEYS), sgk, PAIR_KEYS)


def _loaded(spark, sf_dir, spec, distinct):
    tables = {"lines": lines(spark, sf_dir), "orders": table(spark, sf_dir, "orders")}
    return load_surrogates(
        tables, surrogates(spark, sf_dir), spec, batch_log(spark, sf_dir), AS_OF, distinct=distinct
    )


def _numbered(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "user_id")
    return number_rows(events, [F.col("event_type").desc()], "n")


def _highest(spark, sf_dir):
    by_set = surrogates(spark, sf_dir).groupBy("SGK_ID").agg(F.count(F.lit(1)).alias("key_rows"))
    return by_set.withColumn("highest", max_key(surrogates(spark, sf_dir), "PAIR_ID"))


def _appended(spark, sf_dir):
    """Surrogates published, new pairs appended, loaded again with nothing new, and looked up."""
    folder, spec = fresh_folder(spark), replace(PAIR_KEYS, where="lines.pair IS NOT NULL")
    stage = {"lines": lines(spark, sf_dir)}
    known = truncate_load(surrogates(spark, sf_dir), folder, "PART_SUPP_SGK")
    for _ in range(2):
        publish(spark, folder, "PART_SUPP_SGK", append_surrogates(
            stage, known, spec, batch_log(spark, sf_dir), AS_OF, distinct=True
        ))
        known = read_model(spark, folder, "PART_SUPP_SGK")
    return lookup_key(stage["lines"], known, "pair", "SRC_KEY", 1, "PAIR_ID", "PAIR_ID")


def _reserved(spark, sf_dir):
    """Two loads, of pairs with an even and an odd part, into one published table: each reserves the numbers it needs."""
    folder = fresh_folder(spark)
    truncate_load(surrogates(spark, sf_dir), folder, "PART_SUPP_SGK")
    for n in (0, 1):
        spec = replace(PAIR_KEYS, where=f"lines.pair IS NOT NULL AND CAST(split_part(lines.pair, '-', 1) AS BIGINT) % 2 = {n}")
        publish_surrogates(
            spark, folder, "PART_SUPP_SGK", {"lines": lines(spark, sf_dir)}, spec, batch_log(spark, sf_dir), AS_OF, distinct=True
        )
    return read_model(spark, folder, "PART_SUPP_SGK").filter("SGK_ID = 1").select("PAIR_ID", "SRC_KEY")


QUERIES = {
    "new_keys": lambda s, d: new_keys(lines(s, d), surrogates(s, d), PAIR_KEYS),
    "new_keys_distinct": lambda s, d: new_keys(lines(s, d), surrogates(s, d), PAIR_KEYS, distinct=True),
    "new_keys_prefiltered": lambda s, d: new_keys(lines(s, d), surrogates(s, d), PAIR_KEYS, distinct=True, prefilter=True),
    "assign_keys": _assigned,
    "load_surrogates": lambda s, d: _loaded(s, d, PAIR_KEYS, False),
    "load_surrogates_joined": lambda s, d: _loaded(s, d, CUSTOMER_LINE_KEYS, True),
    "append_surrogates": _appended,
    "publish_surrogates": _reserved,
    "number_rows": _numbered,
    "max_key": _highest,
    "lookup_key": lambda s, d: lookup_key(lines(s, d), surrogates(s, d), "pair", "SRC_KEY", 1, "PAIR_ID", "PAIR_ID"),
}
ORACLES = {
    "new_keys": NEW_SQL + "SELECT SRC_KEY FROM new_rows",
    "new_keys_distinct": NEW_SQL + "SELECT DISTINCT SRC_KEY FROM new_rows",
    "new_keys_prefiltered": NEW_SQL + "SELECT DISTINCT SRC_KEY FROM new_rows",
    "assign_keys": NEW_SQL + ASSIGN_SQL + "FROM new_rows",
    "load_surrogates": NEW_SQL + ASSIGN_SQL + FILLED_SQL.format(sgk=1, rid=301, source="3-MEDIUM") + "FROM new_rows",
    "load_surrogates_joined": SGK_SQL + """, new_rows AS (
        SELECT DISTINCT l.pair AS SRC_KEY FROM lines l JOIN orders o ON l.l_orderkey = o.o_orderkey
        WHERE o.o_orderstatus = 'F' AND l.l_returnflag = 'R'
    )
    """ + ASSIGN_SQL + FILLED_SQL.format(sgk=3, rid=302, source="5-LOW") + "FROM new_rows",
    "append_surrogates": SGK_SQL + """, fresh AS (
            SELECT pair, (SELECT MAX(PAIR_ID) FROM sgk) + ROW_NUMBER() OVER (ORDER BY pair DESC) AS PAIR_ID
            FROM (SELECT DISTINCT pair FROM lines WHERE pair IS NOT NULL
                  AND pair NOT IN (SELECT SRC_KEY FROM sgk WHERE SGK_ID = 1)))
        SELECT l.l_orderkey, l.l_returnflag, l.pair, COALESCE(k.PAIR_ID, f.PAIR_ID) AS PAIR_ID
        FROM lines l LEFT JOIN sgk k ON k.SRC_KEY = l.pair AND k.SGK_ID = 1 LEFT JOIN fresh f ON f.pair = l.pair""",
    "publish_surrogates": SGK_SQL + """, fresh AS (
            SELECT DISTINCT pair, CAST(split_part(pair, '-', 1) AS BIGINT) % 2 AS part FROM lines
            WHERE pair IS NOT NULL AND pair NOT IN (SELECT SRC_KEY FROM sgk WHERE SGK_ID = 1))
        SELECT PAIR_ID, SRC_KEY FROM sgk WHERE SGK_ID = 1
        UNION ALL SELECT (SELECT MAX(PAIR_ID) FROM sgk) + ROW_NUMBER() OVER (ORDER BY part, pair DESC), pair FROM fresh""",
    "number_rows": """
        SELECT ROW_NUMBER() OVER (ORDER BY event_type DESC, user_id) AS n, event_type, user_id FROM events""",
    "max_key": SGK_SQL + """
        SELECT SGK_ID, COUNT(*) AS key_rows, (SELECT MAX(PAIR_ID) FROM sgk) AS highest FROM sgk GROUP BY SGK_ID""",
    "lookup_key": SGK_SQL + """
        SELECT l.l_orderkey, l.l_returnflag, l.pair, k.PAIR_ID
        FROM lines l LEFT JOIN sgk k ON k.SRC_KEY = l.pair AND k.SGK_ID = 1""",
}
