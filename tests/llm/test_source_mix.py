import random

import pytest
from conftest import rows

from millrace.llm.queries import source_weights
from millrace.llm.source_mix import fill, mix


def water(sizes, weights, total, most):
    """Capped water-filling by bisection of the level."""
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * s, w * level) for s, w in zip(sizes, weights, strict=True)) < total:
            low = level
        else:
            high = level
    return [min(most * s, w * high) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_targets_fill_up_to_the_caps(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 100, 1000, 50_000]) for _ in range(9)] + [10]
    weights = [rng.choice([1.0, 2.0, 3.0]) for _ in sizes]
    total = 1.5 * sum(sizes)
    df = spark.createDataFrame([(str(i), s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, size long, weight double")
    found = {int(r["source"]): r["target"] for r in fill(df, total, 2).collect()}
    assert [found[i] for i in range(len(sizes))] == pytest.approx(water(sizes, weights, total, 2), rel=1e-9, abs=1e-6)
    assert sum(found.values()) == pytest.approx(total)


def test_more_than_all_caps_no_weight_and_no_sources(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("b", 5, None), (None, 4, -1.0)], "source string, size long, weight double")
    assert rows(fill(df, 1000.0, 2), "source", "target") == [(None, 0.0), ("a", 20.0), ("b", 0.0)]
    assert fill(df.limit(0), 10.0).count() == 0


def documents(spark, seed=1):
    rng = random.Random(seed)
    values = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "w " * rng.randint(0, 60)) for i in range(400)]
    values += [(500, "d", None), (501, "e", "x " * 3000), (None, "a", "no id"), (7, "a", "again"), (7, "a", "again")]
    return spark.createDataFrame(values, "doc_id long, source string, text string").repartition(4), values


def test_a_mix_is_near_its_targets_and_repeats(spark):
    df, values = documents(spark)
    weights = source_weights(df, (3, 1, 2))
    assert rows(weights) == [(None, 2.0), ("a", 3.0), ("b", 1.0), ("c", 2.0), ("d", 3.0), ("e", 1.0)]
    found = mix(df, weights, 1.5).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mix(df.repartition(7), weights, 1.5).collect()), key=str)
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(i), len((t or "").split())) for i, _, t in values)
    for source in {s for _, s, _ in values}:
        own = [r for r in found if r["source"] == source]
        taken, longest = sum(r["size"] * r["copies"] for r in own), max(r["size"] for r in own)
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(taken - own[0]["target"]) <= longest / 2 + 1e-6
        assert all(0 <= r["copies"] <= 2 for r in own)
    other = mix(df, weights, 1.5, seed=99).collect()
    assert {(r["doc_id"], r["copies"]) for r in other} != {(r["doc_id"], r["copies"]) for r in found}


def test_an_empty_table_and_texts_without_words(spark):
    df, _ = documents(spark)
    assert mix(df.limit(0), source_weights(df, (1,)), 1.5).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, "b", None)], "doc_id long, source string, text string")
    assert rows(mix(blank, source_weights(blank, (1, 2)), 1.5), "doc_id", "size", "target", "copies") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
