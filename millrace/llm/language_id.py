"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col, unused, whole, with_results

BUCKETS = 1 << 13
DIMENSIONS = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 600
REJECT_SHARE = 0.01
MOST_LANGUAGES = 10_000
UNDECIDED = "und"
PIECE = 1 << 20


def histogram(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's hashed byte n-grams, words padded by a space."""
    raw = b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" "
    counts = np.zeros(BUCKETS)
    for begin in range(0, len(raw), PIECE):
        data = np.frombuffer(raw[begin : begin + PIECE + max(GRAMS) - 1], dtype=np.uint8).astype(np.uint32)
        for n in GRAMS:
            length = min(PIECE, len(data) - n + 1)
            if length <= 0:
                continue
            hashed = np.full(length, n, dtype=np.uint32)
            for k in range(n):
                hashed = (hashed ^ data[k : k + length]) * np.uint32(0x01000193)
            counts += np.bincount((hashed ^ (hashed >> np.uint32(15))) % BUCKETS, minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    """Logits per bucket (embeddings times output layer), languages in order, calibration."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return _softmax((mean @ self.table + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], held: np.ndarray, seed: int = 6, epochs: int = 30) -> LanguageModel:
    """Stochastic gradient descent over embeddings and output layer; ``held`` rows calibrate.

    ``x`` are mean bucket counts. The temperature is the one with the least loss over the held rows;
    ``reject_below`` is the probability that all but ``REJECT_SHARE`` of the held rows reach.
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    out, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    rows = np.flatnonzero(~held) if (~held).any() else np.arange(len(x))
    rate = 1.0
    scale = np.sqrt(BUCKETS) / 4  # mean counts are tiny; larger inputs let plain steps learn
    for epoch in range(epochs):
        for begin in range(0, len(rows), 16):
            if not begin:
                rng.shuffle(rows)
            batch = rows[begin : begin + 16]
            inner = (x[batch] * scale) @ embed
            wrong = _softmax(inner @ out + bias)
            wrong[np.arange(len(batch)), y[batch]] -= 1
            wrong /= len(batch)
            back = wrong @ out.T
            out -= rate * (inner.T @ wrong)
            bias -= rate * wrong.sum(axis=0)
            embed -= rate * ((x[batch] * scale).T @ back)
        rate = 1.0 * (1 - (epoch + 1) / epochs) + 0.02
    table = scale * embed @ out
    check = np.flatnonzero(held) if held.any() else rows
    logits = x[check] @ table + bias
    if not len(check):
        return LanguageModel(languages, table, bias, 1.0, 0.0)
    temperatures = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    best = _softmax(logits / temperature).max(axis=1)
    return LanguageModel(languages, table, bias, temperature, float(np.quantile(best, REJECT_SHARE)))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on about ``per_language`` documents of each language, drawn by a hash of their key.

    Documents with a NULL language or without letters are left out. Bucket counts are computed on
    the executors; a sampled document sends at most ``BUCKETS`` of them to the driver.
    """
    known = docs.filter(col(lang).isNotNull() & has_letters(col(text)))
    share = known.groupBy(col(lang).alias("of")).agg(F.count(F.lit(1)).alias("n")).select(
        "of", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("share")
    )
    # a row per language: beyond any number of languages there are, Spark chooses the join
    share = F.broadcast(share) if share.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else share
    place = F.pmod(F.xxhash64(F.lit("sample"), col(key), col(text)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.select(col(lang).alias("of"), col(key).alias("k"), col(text).alias("text"), place.alias("place"))
    drawn = drawn.join(share, "of").filter(F.col("place") < F.col("share")).select("of", "k", "text", "place")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [histogram(t) for t in frame["text"]]
            used = [np.flatnonzero(m) for m in made]
            yield pd.DataFrame({
                "of": frame["of"], "place": frame["place"], "total": [float(m.sum()) for m in made],
                "at": [u.astype(np.int16) for u in used], "n": [m[u].astype(np.float32) for m, u in zip(made, used, strict=True)],
            })

    rows = drawn.mapInPandas(count, "of string, place double, total double, at array<smallint>, n array<float>").collect()
    rows.sort(key=lambda r: (r["place"], r["of"]))
    languages = tuple(sorted({r["of"] for r in rows})) or (UNDECIDED,)
    x, y = np.zeros((len(rows), BUCKETS)), np.array([languages.index(r["of"]) for r in rows], dtype=int)
    for i, row in enumerate(rows):
        x[i, np.array(row["at"], dtype=int)] = np.array(row["n"]) / max(row["total"], 1)
    return fit(x, y, languages, np.arange(len(rows)) % 5 == 4)


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Documents with ``lang_pred``, ``score`` (its calibrated probability) and ``rejected``.

    The prediction depends on the whole text alone: the mean of the embeddings of all its hashed
    byte n-grams, a linear softmax, the temperature. ``rejected`` is true where the probability is
    below the calibrated limit: callers that would rather have no answer take those as undecided.
    NULL texts and texts without letters are ``und`` with score 0 and rejected. Repeated rows are
    judged alike, columns named like a result give way, an empty table stays empty; nothing is shuffled.
    """
    (plain, found) = unused(docs.columns, "whole_text", "found")
    languages = model.languages

    def predict(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            p = np.zeros((0, len(languages)))
            for begin in range(0, len(texts), 256):
                counts = np.array([histogram(t) for t in texts.iloc[begin : begin + 256]]).reshape(-1, BUCKETS)
                p = np.vstack([p, model.probabilities(counts)])
            best = p.argmax(axis=1)
            yield pd.DataFrame({"lang": [languages[i] for i in best], "p": p[np.arange(len(p)), best]})

    judge = F.pandas_udf(predict, "lang string, p double")
    letters = has_letters(col(text))
    chosen = docs.withColumn(plain, whole(col(text))).withColumn(found, judge(col(plain)))
    return with_results(chosen, {
        "lang_pred": F.when(letters, col(found)["lang"]).otherwise(F.lit(UNDECIDED)),
        "score": F.when(letters, col(found)["p"]).otherwise(F.lit(0.0)),
        "rejected": ~letters | (col(found)["p"] < model.reject_below),
    }).drop(plain, found)
