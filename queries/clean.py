"""Cleaning of texts and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.clean import fill_missing, filter_in, rename_reserved, trim_text, truncate_floats
from queries.common import table


def padded_texts(spark, sf_dir):
    """All turns of conversations with white space put around their text."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit(" \t"), F.col("role"), F.lit("\r\n")).alias("role"),
        F.concat(F.lit("\n  "), F.col("text"), F.lit("  \t")).alias("text"),
    )


def gappy_events(spark, sf_dir):
    """All events; errors have no measured value, views no properties."""
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_type") == "error", F.lit("NaN").cast("double"))
        .when(F.col("event_type") != "signup", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("props"),
    )


def reserved_words(spark, sf_dir):
    """Market segments from F on are reserved words of one source, nation names of another."""
    segments = table(spark, sf_dir, "customer").filter("c_mktsegment >= 'F'")
    nations = table(spark, sf_dir, "nation")
    return segments.select(F.lit("TARGET").alias("Reserved words source"), F.col("c_mktsegment").alias("Reserved words")).union(
        nations.select(F.lit("OTHER"), F.col("n_name"))
    )


def wanted_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_type IN ('PROMO', 'SMALL')").select("p_partkey")


BLANKS_SQL = (
    "concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160), "
    "chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), "
    "chr(8201), chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))"
)

QUERIES = {
    "trim_text": lambda s, d: trim_text(padded_texts(s, d)),
    "trim_text_documents": lambda s, d: trim_text(table(s, d, "documents")),
    "fill_missing": lambda s, d: fill_missing(gappy_events(s, d)),
    "fill_missing_numbers": lambda s, d: fill_missing(gappy_events(s, d), -1),
    "truncate_floats": lambda s, d: truncate_floats(
        table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]
    ),
    "filter_in": lambda s, d: filter_in(
        table(s, d, "lineitem"), [("l_returnflag", ["R", "A"]), ("l_linestatus", ["O"])]
    ),
    "filter_in_long_list": lambda s, d: filter_in(table(s, d, "lineitem"), [("l_quantity", list(range(0, 3000, 2)))]),
    "filter_in_table": lambda s, d: filter_in(table(s, d, "lineitem"), [("l_partkey", wanted_parts(s, d))]),
    "rename_reserved": lambda s, d: rename_reserved(
        table(s, d, "customer"), reserved_words(s, d), "TARGET", ["c_mktsegment", "c_name"]
    ),
}
ORACLES = {
    "trim_text": f"""
        SELECT conv_id, turn, trim(role, {BLANKS_SQL}) AS role, trim(text, {BLANKS_SQL}) AS text FROM conversations""",
    "trim_text_documents": f"""
        SELECT doc_id, trim(text, {BLANKS_SQL}) AS text, trim(lang, {BLANKS_SQL}) AS lang,
               trim(source, {BLANKS_SQL}) AS source, n_chars FROM documents""",
    "fill_missing": """
        SELECT event_id, event_type, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS value,
               CASE WHEN event_type <> 'view' THEN props ELSE '' END AS props FROM events""",
    "fill_missing_numbers": """
        SELECT event_id, event_type, CASE WHEN event_type NOT IN ('error', 'signup') THEN value ELSE -1 END AS value,
               CASE WHEN event_type <> 'view' THEN props END AS props FROM events""",
    "truncate_floats": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS l_quantity,
               CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice, CAST(trunc(l_discount) AS BIGINT) AS l_discount,
               l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
    "filter_in": "SELECT * FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'O'",
    "filter_in_long_list": "SELECT * FROM lineitem WHERE l_quantity IN (SELECT unnest(range(0, 3000, 2)))",
    "filter_in_table": """
        SELECT * FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL'))""",
    "rename_reserved": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal,
               CASE WHEN c_mktsegment >= 'F' THEN concat(c_mktsegment, '_') ELSE c_mktsegment END AS c_mktsegment
        FROM customer""",
}
