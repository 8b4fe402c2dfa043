import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.llm import language_id, quality_rank
from millrace.llm.queries import QUERIES, fold
from millrace.llm.common import table

SF = "/root/testdata/sf0.01"


def test_quality_on_documents_it_has_not_seen(spark):
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    found = QUERIES["op5_quality_ranking"](spark, SF)
    assert found.count() == table(spark, SF, "documents").count()
    held = [tuple(r) for r in found.filter("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()]
    assert np.mean([q == p for q, _, p in held]) > 0.95
    good, bad = [s for q, s, _ in held if q == 1], [s for q, s, _ in held if q == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.97
    assert found.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.3 AS INT)").count() == 0


def test_languages_on_documents_it_has_not_seen(spark):
    lang = table(spark, SF, "documents").select("doc_id", "lang")
    found = QUERIES["op6_language_id"](spark, SF)
    held = found.filter("held_out").join(lang, "doc_id").filter("lang IS NOT NULL")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97 and found.filter("score < 0 OR score > 1").count() == 0


ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "x" * 200_000), (6, "a\x00b"), (7, "漢字 かな"), (None, "no id"), (8, "w " * 50_000)]


def test_odd_texts_have_a_quality(spark):
    rng = np.random.default_rng(1)
    ranking = quality_rank.fit(rng.normal(size=(60, len(quality_rank.FEATURES))), np.arange(60) % 2)
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in ODD] * 2, "doc_id long, text string, Score string, whole_text string")
    found = quality_rank.score_documents(df, ranking)
    assert found.columns == ["doc_id", "text", "whole_text", "score", "predicted"] and found.count() == 2 * len(ODD)
    assert found.filter("score IS NULL OR isnan(score) OR score < 0 OR score > 1").count() == 0
    assert found.select("doc_id", "text", "score").distinct().count() == len(ODD)
    assert quality_rank.score_documents(df.limit(0), ranking).count() == 0


def test_pairs_teach_an_order_and_one_label_teaches_none(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality_rank.FEATURES)))
    label = (x[:, 0] + 0.5 * x[:, 3] > 0.7).astype(int)
    ranking = quality_rank.fit(x, label)
    assert np.mean((ranking.score(x) >= quality_rank.THRESHOLD) == label) > 0.97
    same = quality_rank.fit(x, np.ones(400))
    assert set(np.round(same.score(x), 6)) == {quality_rank.THRESHOLD}
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (9, 1), (None, 0), (2, 5)], "doc_id long, quality int")
    assert np.isfinite(quality_rank.learn(docs, labels).cut)


def test_odd_texts_have_a_language(spark):
    rng = random.Random(1)
    train = [(i, " ".join(rng.choice(w) for _ in range(30)), lang) for i in range(80)
             for lang, w in [(("xx", "yy")[i % 2], (["alpha", "beta"], ["gamma", "delta"])[i % 2])]]
    train += [(100, "alpha", None), (101, None, "xx"), (102, "123", "yy")]
    model = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ("xx", "yy")
    df = spark.createDataFrame([(i, t, "s", "f") for i, t in ODD] + [(20, "Beta ALPHA", "", "")], "doc_id long, text string, Lang_Pred string, found string")
    found = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 20)] == ["und", "und", "und", "und", "xx"]
    assert found[1]["score"] == 0 and found[1]["rejected"] and found[5]["lang_pred"] in ("xx", "yy")
    assert all(0 <= r["score"] <= 1 and r["found"] in ("f", "") for r in found.values())
    assert language_id.identify(df.limit(0), model).count() == 0
    nothing = language_id.learn(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_long_texts_are_counted_whole():
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(3000))
    before, language_id.PIECE = language_id.PIECE, 100
    try:
        short = language_id.histogram(text)
    finally:
        language_id.PIECE = before
    assert (short == language_id.histogram(text)).all()


def test_folds_are_those_of_crc32(spark):
    import zlib

    found = spark.range(200).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in found)


def test_the_pairwise_loss_is_least_where_a_plain_loop_finds_it():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, len(quality_rank.FEATURES)))
    label = (x[:, 1] + rng.normal(size=40) > 0).astype(int)
    penalty, seed = 1e-2, 5
    ranking = quality_rank.fit(x, label, seed=seed, penalty=penalty)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    draw, n = np.random.default_rng(seed), min(quality_rank.MOST_PAIRS, 20 * 40)
    pairs = list(zip(draw.choice(good, n), draw.choice(bad, n)))

    def expanded(row):
        z = [max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(row, x.mean(axis=0), x.std(axis=0) + 1e-6)]
        return z + [v * v / 6 for v in z]

    rows_ = [expanded(row) for row in x]

    def loss(weights):
        raw = [sum(w * v for w, v in zip(weights, row)) for row in rows_]
        return sum(math.log1p(math.exp(raw[b] - raw[g])) for g, b in pairs) / n + penalty / 2 * sum(w * w for w in weights)

    least = loss(ranking.weights)
    for i in range(len(ranking.weights)):
        for step in (-1e-3, 1e-3):
            moved = ranking.weights.copy()
            moved[i] += step
            assert loss(moved) > least
    assert loss(ranking.weights * 0) > least


def test_steps_of_the_softmax_are_those_of_a_plain_loop(monkeypatch):
    monkeypatch.setattr(language_id, "BUCKETS", 12)
    monkeypatch.setattr(language_id, "DIMENSIONS", 3)
    rng = np.random.default_rng(9)
    x, y = rng.dirichlet(np.ones(12), 20), rng.integers(0, 3, 20)
    model = language_id.fit(x, y, ("a", "b", "c"), np.zeros(20, dtype=bool), seed=6, epochs=3)

    draw = np.random.default_rng(6)
    embed = draw.normal(0, 1 / 3, (12, 3)).tolist()
    out, bias = [[0.0] * 3 for _ in range(3)], [0.0] * 3
    order, rate, scale = np.arange(20), 1.0, math.sqrt(12) / 4
    for epoch in range(3):
        draw.shuffle(order)
        for begin in (0, 16):
            batch = order[begin : begin + 16]
            d_embed, d_out, d_bias = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(3)], [0.0] * 3
            for r in batch:
                given = [scale * v for v in x[r]]
                inner = [sum(given[i] * embed[i][d] for i in range(12)) for d in range(3)]
                logits = [sum(inner[d] * out[d][k] for d in range(3)) + bias[k] for k in range(3)]
                total = sum(math.exp(v) for v in logits)
                wrong = [(math.exp(v) / total - (k == y[r])) / len(batch) for k, v in enumerate(logits)]
                for k in range(3):
                    d_bias[k] += wrong[k]
                    for d in range(3):
                        d_out[d][k] += inner[d] * wrong[k]
                for i in range(12):
                    for d in range(3):
                        d_embed[i][d] += given[i] * sum(wrong[k] * out[d][k] for k in range(3))
            for d in range(3):
                for k in range(3):
                    out[d][k] -= rate * d_out[d][k]
                bias[d] -= rate * d_bias[d]
            for i in range(12):
                for d in range(3):
                    embed[i][d] -= rate * d_embed[i][d]
        rate = 1.0 * (1 - (epoch + 1) / 3) + 0.02
    assert np.allclose(model.table, scale * np.array(embed) @ np.array(out)) and np.allclose(model.bias, bias)


def test_repeated_keys_do_not_push_others_out_of_the_sample(spark):
    docs = [(i, f"text {i}") for i in range(30)] + [(1, "text 1")] * 40 + [(2, f"other {i}") for i in range(5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    whole, again = (quality_rank.learn(d, labels, most=35) for d in (df, df.dropDuplicates()))
    assert np.allclose(whole.weights, again.weights) and whole.cut == pytest.approx(again.cut)
