"""A Bloom filter of a load's keys, so that of a large table only rows that may meet them are moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import canonical

MOST_WORDS = 1 << 20  # rows of the broadcast, of 16 bytes each
KEYS_PER_WORD, MOST_PER_WORD = 4, 16
BITS_PER_KEY = 4


def _hashes(df: DataFrame, keys: Sequence[str], kinds: Sequence[T.DataType], words: int) -> tuple[Column, Column]:
    """The word a key belongs to and the bits it sets there. Texts that compare equal in any way hash alike."""
    typed = [F.col(f"`{k}`").cast(kind) for k, kind in zip(keys, kinds)]
    told = [canonical(c) if isinstance(kind, T.StringType) else c for c, kind in zip(typed, kinds)]
    place, bits = F.xxhash64(F.lit("place"), *told), F.xxhash64(F.lit("bits"), *told)
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        at = F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return F.pmod(place, F.lit(words).cast("long")), mask


def prefiltered(target: DataFrame, load: DataFrame, keys: Sequence[str], load_keys: Sequence[str] | None = None) -> DataFrame:
    """The target's rows whose key may be in the load: all that are, and few that are not.

    The load's keys set bits in words of 64; each task makes words of its own and Spark puts them together, so what is
    broadcast is at most ``MOST_WORDS`` rows whatever the load's size. The target is then filtered where
    it lies, before any shuffle. A join on the exact keys is to follow. Of a load so large that the
    filter would let most rows pass, nothing is filtered. Rows with a NULL key meet nothing and are left out.
    """
    load_keys = load_keys or keys
    kinds = [target.schema[k].dataType for k in keys]
    known = load.select(*(F.col(f"`{k}`").cast(kind).alias(f"key_{i}") for i, (k, kind) in enumerate(zip(load_keys, kinds)))).dropna()
    count = known.count()
    if count > MOST_WORDS * MOST_PER_WORD:
        return target
    words = max(1, min(MOST_WORDS, count // KEYS_PER_WORD))
    word, mask = _hashes(known, known.columns, kinds, words)
    bits = known.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))
    word, mask = _hashes(target, keys, kinds, words)
    rows = target.withColumns({"__at": word, "__mask": mask}).dropna(subset=list(keys))
    passing = (F.col("__at") == F.col("__word")) & (F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"))
    return rows.join(F.broadcast(bits), passing, "left_semi").drop("__at", "__mask")

