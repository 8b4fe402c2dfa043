"""Exact top-k search by inner product: a three-phase uniform threshold over slices of the vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import col, stored

SLICES = 2
CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
LIST_FACTOR, NODE_FACTOR = 8, 2
SCORES_AT_ONCE, PAIRS_AT_ONCE = 1 << 21, 1 << 13
LARGEST = float(1 << 61)


def _scaled(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(256 * values)


def _as_int(value: float) -> int:
    """floor(256 * value), exactly: from 2^53 on a double is a whole number."""
    return int(value) * 256 if abs(value) >= 2**53 else int(np.floor(256 * value))


_as_ints = np.vectorize(_as_int, otypes=[object])


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of floor(256 * x), which whole numbers already are; exact, or held at +-2^61 where they are beyond."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), dtype=np.int64)
    scaled = queries.dtype.kind == "i"
    q, c = (queries, candidates) if scaled else (_scaled(queries), _scaled(candidates))
    with np.errstate(over="ignore", invalid="ignore"):
        bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if scaled:  # so small that doubles hold every sum, and perhaps floats
        kind = np.float32 if bound < 2**24 else np.float64
        return q.astype(kind) @ c.astype(kind).T
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = _as_ints(queries) @ _as_ints(candidates).T
    return np.clip(exact, -int(LARGEST), int(LARGEST)).astype(np.int64)


def _block(ids: Column, key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), ids), F.lit(n)).cast("int")


def _nodes(candidates: DataFrame, queries: DataFrame, n_c: int, n_q: int, slices: int, width: int) -> DataFrame:
    """A row for each slice, candidate block and query block: what one node of the search sees. The vectors of a
    block are one array, each filled up with 0."""
    part = -(-width // slices)

    def gathered(df: DataFrame, side: str, n: int) -> DataFrame:
        zero = F.lit(0).cast(df.schema["vector"].dataType.elementType)
        filled = F.concat("vector", F.array_repeat(zero, F.lit(part * slices) - F.size("vector")))
        more = [F.get("cutoffs", F.col("slice")).alias("cutoff") for c in df.columns if c == "cutoffs"]
        cut = df.withColumn("vector", filled).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
            _block(F.col("id"), f"{side}_block", n).alias(f"{side}_block"), "slice",
            F.struct("id", F.slice("vector", F.col("slice") * part + 1, part).alias("part"), *more).alias("x"),
        )
        held = cut.groupBy(f"{side}_block", "slice").agg(F.collect_list("x").alias("held"))
        return held.select(
            f"{side}_block", "slice", F.col("held.id").alias(f"{side}_ids"), F.flatten("held.part").alias(side),
            *(F.col("held.cutoff").alias("cutoffs") for _ in more),
        )

    left = gathered(candidates, "c", n_c).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = gathered(queries, "q", n_q).withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    return left.join(right, ["slice", "c_block", "q_block"])


def _places(wanted: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where in ``ids`` the wanted ones are; -1 where they are not."""
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)]
    return np.where(ids[at] == wanted, at, -1)


def _seen(row) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some queries of a node at a time: which, all their partial scores, and these with a vector's own one at the lowest."""
    q, c = row.q.reshape(len(row.q_ids), -1), row.c.reshape(len(row.c_ids), -1)
    own = _places(row.q_ids, row.c_ids)
    step = max(1, SCORES_AT_ONCE // len(c))
    for begin in range(0, len(q), step):
        some = slice(begin, begin + step)
        scores = _products(q[some], c)
        lowest = scores.min(axis=1).astype(np.int64)
        at = np.flatnonzero(own[some] >= 0)
        scores[at, own[some][at]] = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
        yield some, lowest, scores


def _local_lists(most: int):
    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                for some, lowest, scores in _seen(row):
                    beyond = max(0, scores.shape[1] - most)
                    best = np.argpartition(scores, min(beyond, scores.shape[1] - 1), axis=1)[:, beyond:]
                    q_at, c_at = np.repeat(np.arange(len(scores)), best.shape[1]), best.ravel()
                    q_ids = row.q_ids[some]
                    kept = q_ids[q_at] != row.c_ids[c_at]
                    yield pd.DataFrame({
                        "query_id": q_ids[q_at][kept], "slice": row.slice, "vec_id": row.c_ids[c_at][kept],
                        "partial": scores[q_at, c_at][kept].astype(np.int64), "lowest": lowest[q_at][kept],
                    })

    return lists


def _above_cutoff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            for some, _, scores in _seen(row):
                cutoff = row.cutoffs[some].astype(np.float64) if scores.dtype.kind == "f" else row.cutoffs[some]
                q_at, c_at = np.nonzero(scores >= cutoff[:, None])
                kept = row.q_ids[some][q_at] != row.c_ids[c_at]
                q_at, c_at = q_at[kept], c_at[kept]
                yield pd.DataFrame({
                    "query_id": row.q_ids[some][q_at], "seen": np.int64(1) << row.slice, "vec_id": row.c_ids[c_at],
                    "partial": scores[q_at, c_at].astype(np.int64),
                })


def _scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            all_q, all_c = row.q.reshape(len(row.q_ids), -1), row.c.reshape(len(row.c_ids), -1)
            for begin in range(0, len(row.query_id), PAIRS_AT_ONCE):
                query_id, vec_id = (ids[begin : begin + PAIRS_AT_ONCE] for ids in (row.query_id, row.vec_id))
                q, c = all_q[_places(query_id, row.q_ids)], all_c[_places(vec_id, row.c_ids)]
                x, y = (v.astype(np.float64) if v.dtype.kind == "i" else _scaled(v) for v in (q, c))
                with np.errstate(over="ignore", invalid="ignore"):
                    usual = not q.size or np.abs(x).max() * np.abs(y).max() * q.shape[1] < 2**53
                if usual:
                    scores = (x * y).sum(axis=1)
                else:
                    scores = [int(_products(q[i : i + 1], c[i : i + 1])[0, 0]) for i in range(len(q))]
                yield pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": np.array(scores, dtype=np.int64)})


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    slices: int = SLICES,
) -> DataFrame:
    """For each query its ``k`` highest-scoring other vectors: query_id, rank (from 1), vec_id, score.

    Components become floor(256 * x); the score is their inner product, ties go to the smaller
    vec_id. The components are cut into ``slices``; a node holds one slice of a block of vectors and
    of a block of queries, and so partial scores only.

    1. Every node lists its highest partial scores. The listed vectors are scored exactly; the k-th
       best of them bounds the k-th best of all from below.
    2. A vector that reaches this bound must, in some slice, come as far between lowest and highest partial
       as the bound lies between their sums. This cutoff goes to the nodes with the queries; they return all
       partials above it.
    3. Vectors whose known partials and, for the rest, cutoffs can't reach the bound are dropped. Those
       with all partials known have their score; the others are scored by nodes that hold whole vectors.

    Rows with a NULL id, a NULL vector or NULL or non-finite components take no part. A vec_id that
    repeats counts once, with its least vector. Shorter vectors are as if filled up with 0. A
    query without other vectors has no rows; so has an empty table. Scores beyond +-2^61 are held there, so among
    them the smaller vec_id comes first; components may be any finite doubles, but vectors of such scores are not cut.
    """
    spark = vectors.sparkSession
    valid = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    clean = vectors.select(
        col(vec_id).cast("long").alias("id"), col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"),
    ).filter(F.col("id").isNotNull() & valid)
    clean = stored(clean.groupBy("id").agg(F.min("vector").alias("vector"), F.bool_or("asks").alias("asks")))
    greatest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
    width, most_ = clean.agg(F.max(F.size("vector")), greatest).first()
    width = width or 0
    if 2 * width * (256.0 * (most_ or 0.0) + 1) * (256.0 * (most_ or 0.0) + 1) >= LARGEST:
        slices = 1  # partial scores may leave 64 bits: nodes see whole vectors, and only scores are held
    elif width * (256.0 * (most_ or 0.0) + 1) ** 2 < 2**53:  # all in whole numbers, which are shorter
        clean = clean.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256).cast("int")))
    candidates, queries = clean.select("id", "vector"), clean.filter("asks").select("id", "vector")
    n_c, n_q = max(1, -(-clean.count() // CANDIDATES_PER_BLOCK)), max(1, -(-queries.count() // QUERIES_PER_BLOCK))

    def exact(pairs: DataFrame) -> DataFrame:
        """Scores of pairs, which go to the blocks of their vectors: no vector is shuffled for a pair."""
        blocks = _block(F.col("vec_id"), "c_block", n_c).alias("c_block"), _block(F.col("query_id"), "q_block", n_q).alias("q_block")
        asked = pairs.select(*blocks, F.struct("query_id", "vec_id").alias("x")).groupBy("c_block", "q_block").agg(F.collect_list("x").alias("held"))
        asked = asked.select("c_block", "q_block", F.col("held.query_id").alias("query_id"), F.col("held.vec_id").alias("vec_id"))
        both = _nodes(candidates, queries, n_c, n_q, 1, width).join(asked, ["c_block", "q_block"])
        return both.mapInPandas(_scored, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    # 1: local lists, and from them a bound and the cutoffs
    # the more vectors there are, the more are listed, but by the square root only: a better bound leaves fewer pairs
    most = LIST_FACTOR * k * math.isqrt(n_c - 1) + LIST_FACTOR * k
    lists = _nodes(candidates, queries, n_c, n_q, slices, width).mapInPandas(
        _local_lists(NODE_FACTOR * k), "query_id long, slice int, vec_id long, partial long, lowest long"
    )
    lists = stored(lists)
    lowest = lists.groupBy("query_id", "slice").agg(F.min("lowest").alias("lowest"), F.max("partial").alias("highest"))
    highest = Window.partitionBy("query_id", "slice").orderBy(F.desc("partial"), "vec_id")
    listed = lists.withColumn("n", F.row_number().over(highest)).filter(F.col("n") <= most)
    bound = exact(listed.select("query_id", "vec_id").distinct()).withColumn("n", F.row_number().over(best)).groupBy(
        "query_id"
    ).agg(F.min(F.when(F.col("n") == k, F.col("score"))).alias("bound"))
    lows = lowest.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slice", "lowest", "highest"))).alias("seen"))
    zero = F.lit(0).cast("decimal(38,0)")
    sum_low = F.aggregate("seen", zero, lambda a, x: (a + x["lowest"]).cast("decimal(38,0)"))
    sum_high = F.aggregate("seen", zero, lambda a, x: (a + x["highest"]).cast("decimal(38,0)"))
    way = (F.col("bound") - sum_low).cast("double")
    # the same share of the range of each slice, in all no more than the bound: rounding only lowers a cutoff
    step = lambda x: way * F.when(sum_high > sum_low, (x["highest"].cast("double") - x["lowest"]) / (sum_high - sum_low).cast("double")).otherwise(1.0 / slices)
    below = lambda x: F.floor(step(x) - F.abs(step(x)) * 1e-12 - 1).cast("long")
    cutoffs = stored(lows.join(bound, "query_id").select(
        "query_id", F.coalesce("bound", F.lit(-int(LARGEST) * 2)).alias("bound"),
        # without k listed vectors every vector is on some list's node: take all
        F.transform("seen", lambda x: F.coalesce(x["lowest"] + below(x), x["lowest"])).alias("cutoffs"),
    ))

    # 2: all partial scores that reach the cutoff
    armed = queries.join(cutoffs.withColumnRenamed("query_id", "id"), "id").select("id", "vector", "cutoffs")
    found = _nodes(candidates, armed, n_c, n_q, slices, width).mapInPandas(
        _above_cutoff, "query_id long, seen long, vec_id long, partial long"
    )

    # 3: what can still reach the bound
    summed = found.groupBy("query_id", "vec_id").agg(
        F.sum("partial").alias("score"), F.count(F.lit(1)).alias("known"), F.bit_or("seen").alias("seen")
    ).join(cutoffs, "query_id")
    at_most = F.col("score")
    for s in range(slices):
        unseen = F.col("seen").bitwiseAND(F.lit(1 << s).cast("long")) == 0
        at_most = at_most + F.when(unseen, F.get("cutoffs", F.lit(s)) - 1).otherwise(0)
    alive = stored(summed.filter(at_most >= F.col("bound")).select("query_id", "vec_id", "score", "known"))
    whole = alive.filter(F.col("known") == slices).select("query_id", "vec_id", "score")
    rest = exact(alive.filter(F.col("known") < slices).select("query_id", "vec_id"))
    ranked = whole.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
