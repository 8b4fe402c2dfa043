"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col, lines, lower_ascii, row_key, stored, stripped, unused, whole, with_results

MOST_HELD = 200_000  # hashes that are broadcast, of 16 bytes each


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Documents without the lines whose key stands in ``min_docs`` documents or more.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case.
    Lines are hashed to 128 bits once and written; they are exploded, documents are counted per hash, positions
    to drop are joined back and the lines that stay are put together by position. Only hashes and
    positions are shuffled to find them; texts move once, to meet their positions. A line that a third
    of all documents have is one counted row per task before the shuffle. The hashes of frequent
    and of common lines meet the lines by broadcast if there are at most ``MOST_HELD`` of them, so that no line is a
    key; of more, Spark's join splits what is too large.

    ``text`` becomes the lines that stay, joined by line feeds; ``n_lines`` and ``n_dropped`` (long)
    are added, and input columns of these names give way. NULL and '' are one empty line, which
    has an empty key and stays: the text is then ''. Documents are told apart by ``key``: repeated
    rows of a key count once, a NULL key is one document. An empty table gives an empty table.
    """
    a, b, at, h1, h2, dropped, parts = unused(docs.columns, "row_a", "row_b", "at", "hash_a", "hash_b", "dropped", "parts")
    key_a, key_b = row_key(col(key), col(text))
    keyed = docs.withColumns({a: key_a, b: key_b})

    def hashes(line: Column) -> Column:
        shown = lower_ascii(stripped(line))
        first, second = row_key(shown)
        return F.struct((F.char_length(shown) >= min_chars).alias("counts"), first.alias("h1"), second.alias("h2"))

    line = stored(keyed.select(a, b, col(key).alias("doc"), F.transform(lines(col(text)), hashes).alias("lines")))
    line = line.select(a, b, "doc", F.posexplode("lines").alias(at, "line")).filter("line.counts").select(
        a, b, "doc", at, F.col("line.h1").alias(h1), F.col("line.h2").alias(h2)
    )

    def held(found: DataFrame) -> DataFrame:
        """Hashes, to be broadcast if they are few."""
        found = stored(found.select(h1, h2))
        return F.broadcast(found) if found.count() <= MOST_HELD else found

    # only lines that often repeat at all can be in that many documents
    often = held(line.groupBy(h1, h2).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs))
    repeated = line.join(often, [h1, h2])
    common = held(
        repeated.select(h1, h2, "doc").distinct()
        .groupBy(h1, h2).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    )
    found = line.join(common, [h1, h2], "left_semi").groupBy(a, b).agg(F.collect_set(at).alias(dropped))

    # the hint spares a sort of the texts: what is held in memory are the positions
    joined = keyed.join(found.hint("shuffle_hash"), [a, b], "left").withColumn(parts, lines(col(text)))
    n = F.size(col(parts))
    staying = F.transform(
        F.array_except(F.sequence(F.lit(0), n - 1), col(dropped)), lambda p: F.get(col(parts), p)
    )
    rest = F.when(col(dropped).isNull(), whole(col(text))).otherwise(F.array_join(staying, "\n"))
    out = with_results(joined, {
        text: rest, "n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size(col(dropped)), F.lit(0)).cast("long"),
    })
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*(col(c) for c in order), "n_lines", "n_dropped")
