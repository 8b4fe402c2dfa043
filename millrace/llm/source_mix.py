"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import col, stored, unused, words

MAX_EPOCHS = 2
BUCKETS = 4096


def fill(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``target`` for each source: its share of ``total`` by ``weight``, at most ``max_epochs`` sizes.

    ``sources`` has source, size and weight. Sources above their cap are clamped to it and the excess
    goes to the others by weight, until none is above. Each round is one aggregate over the sources,
    of which one row comes to the driver. If all caps together are below ``total``, all are clamped.
    NULL or negative weights count as 0; a source of weight or size 0 gets nothing.
    """
    cap = F.col("size").cast("double") * max_epochs
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    state = stored(sources.withColumns({"cap": cap, "weight": weight}))
    level, clamped = -1.0, -1
    while True:
        # clamped so far: those whose share at the last level is above their cap
        above = (F.col("cap") < F.col("weight") * level) if level >= 0 else F.lit(False)
        row = state.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(above).alias("n"),
        ).first()
        if not row["open"] or row["n"] == clamped:
            break
        clamped, level = row["n"], max(0.0, (total - row["held"]) / row["open"])
    target = F.least(F.col("cap"), F.col("weight") * level) if row["open"] else F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)
    return state.withColumn("target", F.coalesce(target, F.lit(0.0)).cast("double")).drop("cap")


def mix(
    docs: DataFrame, weights: DataFrame, share: float, max_epochs: float = MAX_EPOCHS, seed: int = 17,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """How often each document goes into a mix of ``share`` times all words: key, source, size,
    source_size, target and ``copies``.

    ``weights`` has source and weight; NULL is a source like any other, one without a weight has 0,
    of several weights the highest counts.
    Size is the number of words. With e = target / source_size, every document is taken floor(e)
    times; the rest of the target is filled with documents in an order seeded by their key: one is
    taken once more if the middle of its words lies below the rest. So a source is off its
    target by half a document at most, reruns agree, and no document is taken more than ceil(e) times.

    Sizes are written once and texts not read again. Places within a source come from totals of
    ``BUCKETS`` buckets of the seeded order and from windows within a bucket, so a source that holds
    a third of all documents is spread over as many tasks. NULL and '' texts have size 0; repeated
    keys are ordered by size, equal rows alike; an empty table gives an empty mix.
    """
    sized = stored(docs.select(
        col(key).alias("key"), col(source).alias("source"),
        F.size(words(col(text))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit("")))).alias("place"),
    ))
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"))
    given = weights.groupBy(F.col("source").alias("named")).agg(F.max("weight").alias("weight"))
    sources = sources.join(given, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    total = sized.agg(F.sum("size")).first()[0] or 0
    targets = fill(sources, share * total, max_epochs)
    epochs = F.floor(F.col("target") / F.col("size"))
    plan = targets.select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, epochs).otherwise(0).alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    bucket = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    placed = sized.withColumn("bucket", bucket)
    buckets = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("source").alias("of"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("before"),
    ).join(plan.withColumnRenamed("of", "named"), F.col("of").eqNullSafe(F.col("named"))).drop("named")
    joined = placed.join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("place", "key", "size")
    start = F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    more = (start + F.col("size") / 2 < F.col("rest")).cast("long")
    out_key, out_source = unused(["size", "source_size", "target", "copies"], key, source)
    return joined.select(
        F.col("key").alias(out_key), F.col("source").alias(out_source), "size", "source_size", "target",
        (F.col("whole") + more).cast("long").alias("copies"),
    )
