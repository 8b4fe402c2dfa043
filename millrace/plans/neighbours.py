"""Previous and next row of a key, also when one key holds a large share of all rows.

A window sorts all rows of a key in one task. Keys counted to be long are therefore cut
into segments along their order; windows run per key and segment, and each segment gets
one extra row standing for the edge of the segment beside it. Results are those of a
plain window over the key, which is also what runs when no key is long; a NULL order value
comes first in both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.predicates import all_of
from millrace.plans.matching import broadcast_limit, row_bytes

HOT_ROWS = 1_000_000
"""Rows of one key beyond which the key is cut into segments."""
MOST_SEGMENTS = 1000
"""Segments of one key: each of its rows is compared with that many cut points at most, so the
segments of a key beyond ``HOT_ROWS * MOST_SEGMENTS`` rows are longer. Results are the same."""

SEGMENT, HOT, EDGE = "__segment", "__hot", "__edge"


@dataclass(frozen=True)
class LongKeys:
    """Keys with many rows and the cut points of their segments; ``cuts`` is None when there are none.

    ``small`` tells whether the keys and order values of the whole table may be broadcast,
    ``few`` whether the cut points may.
    """

    cuts: DataFrame | None
    small: bool = False
    few: bool = False


def long_keys(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS) -> LongKeys:
    """Find keys of more than ``hot_rows`` rows and even cut points along ``order``.

    The count is combined before it is shuffled; only its totals come to the driver.
    Quantile sketches are built for long keys alone.
    """
    spots = df.select(*keys, order)
    counts = (
        spots.withColumn("bytes", row_bytes(spots))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    )
    found = counts.agg(
        F.count_if(F.col("n") > hot_rows).alias("keys"), F.max("n").alias("longest"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    ).first()
    limit = broadcast_limit(df.sparkSession)
    if not found["keys"]:
        return LongKeys(None, found["bytes"] <= limit)
    segments = min(MOST_SEGMENTS, math.ceil(found["longest"] / hot_rows) + 1)
    same_key = all_of(F.col(f"r.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys)
    cuts = (
        spots.alias("r")
        .join(counts.filter(F.col("n") > hot_rows).alias("h"), same_key, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(order, [i / segments for i in range(1, segments)]).alias("cuts"))
    )
    return LongKeys(cuts, found["bytes"] <= limit, found["keys"] * (16 * segments + 256) <= limit)


def with_segments(df: DataFrame, long: LongKeys, keys: Sequence[str], order: str) -> DataFrame:
    """Number the segments of long keys; every other key is one segment."""
    if long.cuts is None:
        return df
    same_key = all_of(F.col(f"r.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys)
    cuts = F.col("h.cuts")
    segment = F.when(cuts.isNull(), F.lit(0)).otherwise(
        F.size(F.filter(cuts, lambda cut: cut <= F.col(f"r.`{order}`")))
    )
    table = F.broadcast(long.cuts) if long.few else long.cuts
    return df.alias("r").join(table.alias("h"), same_key, "left").select(
        "r.*", segment.alias(SEGMENT), cuts.isNotNull().alias(HOT)
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], which: str, prefix: str
) -> DataFrame:
    """Add ``prefix + column`` holding the value of the ``previous`` or ``next`` row of the key.

    ``df`` comes from :func:`with_segments`; ``order`` is unique within a key.
    """
    backward = which == "previous"
    step = F.lag if backward else F.lead
    if SEGMENT not in df.columns:
        window = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns({f"{prefix}{c}": step(F.col(f"`{c}`")).over(window) for c in columns})

    edge_row = F.struct(*(F.col(f"`{c}`") for c in columns))
    # a struct is never NULL, so a row with a NULL order value can be an edge too
    nearest = (F.max_by if backward else F.min_by)(edge_row, F.struct(F.col(f"`{order}`")))
    across = Window.partitionBy(*keys).orderBy(SEGMENT)
    edges = (
        df.filter(HOT)
        .groupBy(*keys, SEGMENT)
        .agg(nearest.alias("row"))
        .select(*keys, SEGMENT, step("row").over(across).alias("row"))
        .filter(F.col("row").isNotNull())
    )
    shown = [f"{prefix}{c}" for c in columns]
    inner = df.withColumns({s: F.col(f"`{c}`") for s, c in zip(shown, columns)} | {EDGE: F.lit(False)})
    extra = edges.select(
        *keys, SEGMENT, F.lit(True).alias(EDGE), *(F.col(f"row.`{c}`").alias(s) for s, c in zip(shown, columns))
    )
    edge_first = F.col(EDGE).desc() if backward else F.col(EDGE).asc()
    window = Window.partitionBy(*keys, SEGMENT).orderBy(edge_first, F.col(f"`{order}`"))
    return (
        inner.unionByName(extra, allowMissingColumns=True)
        .withColumns({s: step(F.col(f"`{s}`")).over(window) for s in shown})
        .filter(~F.col(EDGE))
        .drop(EDGE)
    )
