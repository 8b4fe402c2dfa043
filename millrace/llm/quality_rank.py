"""A quality classifier by Bradley-Terry ranking: scores learned from pairs, cut at a quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col, unused, whole, with_results

MOST_LABELLED = 20_000
MOST_PAIRS = 200_000
THRESHOLD = 0.3
FEATURES = (
    "upper", "digits", "marks", "bars", "shouts", "stops", "commas", "other_ascii", "high_bytes", "spaces",
    "word_length", "distinct_words", "repeated_lines", "line_length", "capital_words", "log_words",
)


def features(text: str) -> list[float]:
    """What a text looks like: shares of kinds of bytes, lengths, repeats. All finite, for any text."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    total = max(1, len(raw))
    share = lambda chars: sum(int(kinds[c]) for c in chars) / total
    words = raw.split()
    n = max(1, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    named = b"#*$%&|<>!.,"
    return [
        int(kinds[65:91].sum()) / total, int(kinds[48:58].sum()) / total, share(b"#*$%&<>"), share(b"|"), share(b"!"),
        share(b"."), share(b","), sum(int(kinds[c]) for c in range(33, 127) if not chr(c).isalnum() and c not in named) / total,
        int(kinds[128:].sum()) / total, share(b" \t\n\r"),
        min(len(raw) / n / 10, 5.0), len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)),
        min(n / max(1, len(lines)) / 20, 5.0), sum(w[:1].isupper() for w in words) / n, np.log1p(len(words)) / 10,
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted score: weights over standardised features and their squares, and the raw score at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _expanded((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``THRESHOLD`` where the raw score is at the cut."""
        shifted = self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def _expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 6])


def fit(x: np.ndarray, label: np.ndarray, seed: int = 5, penalty: float = 1e-3) -> Ranking:
    """Learn a score from preference pairs: a document labelled 1 is preferred to one labelled 0.

    The loss is the logistic loss of score differences (Bradley-Terry) over at most ``MOST_PAIRS``
    seeded pairs, minimised by Newton steps. The cut is the score's quantile at the share of
    documents labelled 0. Without both labels, all scores equal the cut.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(x):
        x = np.zeros((1, len(FEATURES)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _expanded((x - mean) / scale)
    weights = np.zeros(z.shape[1])
    if not len(good) or not len(bad):
        return Ranking(mean, scale, weights, 0.0)
    rng = np.random.default_rng(seed)
    n = min(MOST_PAIRS, 20 * (len(good) + len(bad)))
    difference = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))  # how wrong each pair is
        gradient = penalty * weights - difference.T @ p / n
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / n
        step = np.linalg.solve(curvature + (penalty + 1e-6) * np.eye(len(weights)), gradient)
        size = np.linalg.norm(step)
        weights = weights - step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-6:
            break
    raw = z @ weights
    share = len(bad) / (len(good) + len(bad))
    # the middle of the gap there, so that neither side hangs on one document
    low, high = np.quantile(raw, share, method="lower"), np.quantile(raw, share, method="higher")
    return Ranking(mean, scale, weights, float((low + high) / 2))


def _features_of(docs: DataFrame, text: Column, *columns: Column) -> DataFrame:
    """The given columns and ``x``, the features of the whole text, computed in batches on the executors."""
    chosen = docs.select(*columns, whole(text).alias("__text"))
    names = [c for c in chosen.columns if c != "__text"]

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[names].assign(x=[features(t) for t in frame["__text"]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    return chosen.mapInPandas(compute, f"{fields}, x array<double>")


def learn(
    docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text",
    label: str = "quality",
) -> Ranking:
    """Fit on at most ``most`` labelled documents: those whose key, then text, has the lowest hash.

    Labels other than 0 and 1 and NULL keys or labels are left out. The features are computed on
    the executors; of each document of the sample only they and the label reach the driver. Equal
    rows count once. If keys repeat, so that the sample would be larger, those of the highest hash are left out.
    """
    chosen = labels.filter(col(label).isin(0, 1) & col(key).isNotNull()).select(col(key).alias("k"), col(label).cast("int").alias("label"))
    chosen = chosen.distinct().orderBy(F.xxhash64("k"), "k", "label").limit(most)
    # at most ``most`` keys and labels: sent to the texts, which stay where they are
    named = docs.select(col(key).alias("k"), col(text).alias("text"), F.xxhash64(col(text)).alias("t")).join(F.broadcast(chosen), "k")
    made = _features_of(named, F.col("text"), F.col("k"), F.col("t"), F.col("label")).dropDuplicates(["k", "t", "label"])
    rows = made.orderBy(F.xxhash64("k"), "k", "t", "label").limit(most).collect()
    rows.sort(key=lambda r: (r["k"], r["t"], r["label"]))
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], dtype=int))


def score_documents(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """Documents with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on).

    The score depends on the whole text alone; NULL is as ''. Repeated rows score alike, columns
    named like a result give way, an empty table stays empty. Rows pass through in batches; nothing
    is shuffled.
    """
    outputs = ("score", "predicted")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    (plain,) = unused(docs.columns, "whole_text")
    chosen = docs.select(*(col(c) for c in kept), whole(col(text)).alias(plain))

    def scored(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            yield pd.Series(ranking.score(x))

    judge = F.pandas_udf(scored, "double")
    out = with_results(chosen, {"score": judge(col(plain))}).drop(plain)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
