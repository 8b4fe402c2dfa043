import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from millrace.llm import ngram_join as module
from millrace.llm.ngram_join import components, ngram_join, shingles, signatures, sketch

SCHEMA = "doc_id long, text string, component_id string"


def brute(texts, n, num, den):
    """Set sizes and least reachable ids, by comparing all pairs of Python sets."""
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = {i: grams(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return sorted((i, len(sets[i]), least[i]) for i in texts)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def families(seed):
    rng = random.Random(seed)
    texts, passage = {}, [f"p{i}" for i in range(60)]
    for family in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 9, 14, 40, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            words = edited(rng, base, rng.choice([0, 0.002, 0.01, 0.03, 0.06]))
            if rng.random() < 0.2:
                words = words + passage
            texts[len(texts)] = rng.choice([" ", "\n", "  \t"]).join(words)
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: " \t\n", len(texts) + 3: "one", len(texts) + 4: "ONE"}
    order = rng.sample(sorted(texts), len(texts))
    return {new: texts[old] for new, old in enumerate(order)}


@pytest.mark.parametrize("seed, n, num, den", [(1, 4, 85, 100), (2, 5, 80, 100), (3, 3, 70, 100)])
def test_components_are_those_of_all_pairs(spark, seed, n, num, den):
    texts = families(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(3)
    found = ngram_join(df, n=n, num=num, den=den)
    assert rows(found, "doc_id", "n_shingles", "component_id") == sorted(brute(texts, n, num, den), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (60, 100)])
def test_similar_sets_share_a_signature_and_pass_the_sketch(num, den):
    rng = np.random.default_rng(7)
    for _ in range(300):
        size = int(rng.choice([3, 6, 7, 8, 12, 15, 16, 31, 63, 64, 200, 1000]))
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        gone = rng.integers(0, max(1, size * (den - num) // den // 2 + 1))
        added = rng.integers(0, max(1, size * (den - num) // den // 2 + 2))
        other = np.unique(np.concatenate([base[gone:], rng.integers(0, 2**63, added, dtype=np.uint64)]))
        common, union = len(np.intersect1d(base, other)), len(np.union1d(base, other))
        if den * common < num * union or len(np.setxor1d(base, other)) == 0:
            continue
        assert np.intersect1d(signatures(base, num, den), signatures(other, num, den)).size
        bits = np.bitwise_count((sketch(base) ^ sketch(other)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(base, other))


def test_repeated_rows_missing_keys_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text, "a"), (5, text, "a"), (3, text + " more", "b"), (None, text, "c"), (None, None, None)], SCHEMA)
    found = rows(ngram_join(df, n=4, num=85, den=100), "doc_id", "n_shingles", "component_id")
    assert found == [(None, 0, None), (None, 47, 3), (3, 48, 3), (5, 47, 3), (5, 47, 3)]
    assert ngram_join(df.limit(0)).count() == 0


def test_shingles_of_short_and_long_texts():
    assert len(shingles("a b", 4)) == 1 and len(shingles(None, 4)) == 0
    assert shingles("A b", 4).tolist() == shingles("a\tB", 4).tolist() != shingles("a b c", 4).tolist()
    assert shingles("É", 4).tolist() != shingles("é", 4).tolist()
    assert len(shingles("x " * 300_000, 4)) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "u long, v long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def all_links(texts, n, num, den):
    """With how many documents of another set each one links, by comparing all pairs."""
    sets = {i: set(shingles(t, n).tolist()) for i, t in texts.items()}
    return sorted((i, sum(
        bool(s) and s != o and den * len(s & o) >= num * len(s | o) for o in sets.values()
    )) for i, s in sets.items())


@pytest.mark.parametrize("block_nodes", [128, 3])
def test_links_inside_a_component_count_and_so_do_copies(spark, monkeypatch, block_nodes):
    monkeypatch.setattr(module, "BLOCK_NODES", block_nodes)
    words = [f"w{i}" for i in range(200)]
    family = [" ".join(words[:i] + ["x"] + words[i + 1 :]) for i in (20, 60, 100, 140)] + [" ".join(words)]
    texts = dict(enumerate(family + family[:1] * 5 + ["quite another text of some words", None]))
    texts |= {i + 100: t for i, t in families(4).items()}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(4, family[4], "x")], SCHEMA).repartition(3)
    found = ngram_join(df, n=4, num=85, den=100)
    assert sorted(map(tuple, found.select("doc_id", "n_links").distinct().collect())) == all_links(texts, 4, 85, 100)
    assert dict(all_links(texts, 4, 85, 100))[1] == 9  # the other three, the original, and five more copies of the first


def test_texts_are_shuffled_once_and_mixed_groups_too(spark, monkeypatch):
    ran, write = [], module.stored

    def seen(df, folder=None):
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, folder)

    monkeypatch.setattr(module, "stored", seen)
    texts = {i: f"a b c d e f g h i x{i % 5}" for i in range(6)} | {6: "one two three", 7: None}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df = spark.createDataFrame([(i, t, "x") for i, t in [*texts.items(), (1, texts[1])]], SCHEMA)
        found = ngram_join(df, n=4, num=85, den=100, count_links=False).distinct()
        assert sorted(map(tuple, found.collect())) == brute(texts, 4, 85, 100)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    sets = [p for p in ran if "MapInPandas" in p and "sketch" not in p]
    assert len(sets) == 2 and all("Exchange" not in p.split("MapInPandas")[0] for p in sets)
    [mixed] = [p for p in ran if "LeftAnti" in p]
    assert "ReusedExchange" in mixed.split("SortMergeJoin [sig")[1]


@pytest.mark.parametrize("group_nodes, pairs_at_once", [(4096, 1 << 16), (3, 4)])
def test_mixed_groups_are_compared_in_blocks_of_arrays(spark, monkeypatch, group_nodes, pairs_at_once):
    monkeypatch.setattr(module, "GROUP_NODES", group_nodes)
    monkeypatch.setattr(module, "PAIRS_AT_ONCE", pairs_at_once)
    ran, write = [], module.stored

    def seen(df, folder=None):
        ran.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, folder)

    monkeypatch.setattr(module, "stored", seen)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    # one family whose members share signatures and are partly too different from all others
    texts = {i: " ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.05]))) for i in range(60)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(3)
    found = ngram_join(df, n=3, num=80, den=100, count_links=False)
    expected = brute(texts, 3, 80, 100)
    assert sorted(map(tuple, found.collect())) == expected
    assert 2 < len({least for *_, least in expected}) < 50
    [mixed] = [p for p in ran if "LeftAnti" in p]
    assert "bit_count" not in mixed and "MapInArrow" in mixed


@pytest.mark.parametrize("pairs_at_once", [1 << 16, 5])
def test_pairs_of_blocks_are_those_of_all_pairs(monkeypatch, pairs_at_once):
    monkeypatch.setattr(module, "PAIRS_AT_ONCE", pairs_at_once)
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.integers(0, 14):], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(40)]
    away = [None if i % 5 == 0 else float(rng.random() / 3) for i in range(40)]
    component = [int(c) for c in rng.integers(0, 6, 40)]
    rows_ = [(range(0, 12), None), (range(12, 20), range(20, 31)), (range(31, 32), None), (range(32, 40), range(32, 32)), (range(33, 40), None)]
    def packed(members):
        return None if members is None else [int(v) for i in members for v in (
            100 - i, component[i], len(sets[i]), -1 if away[i] is None else round(away[i] * module.AWAY), *sketch(sets[i])
        )]

    batch = pa.RecordBatch.from_pydict({
        side: pa.array([packed(r[at]) for r in rows_], pa.list_(pa.int64())) for at, side in enumerate(("one", "other"))
    })
    found = {tuple(r.values()) for out in module._alike(80, 100)(iter([batch.slice(0, 2), batch.slice(2)])) for r in out.to_pylist()}
    expected = set()
    for one, other in rows_:
        for i, j in ((i, j) for i in one for j in (other if other is not None else one) if other is not None or i < j):
            a, b = len(sets[i]), len(sets[j])
            bits = int(np.bitwise_count((sketch(sets[i]) ^ sketch(sets[j])).view(np.uint64)).sum())
            far = away[i] is not None and away[j] is not None and abs(away[i] - away[j]) * 100 > 20 + 1e-6
            if component[i] != component[j] and min(a, b) * 100 >= max(a, b) * 80 and not far and bits * 180 <= (a + b) * 20:
                expected.add((100 - j, 100 - i, b, a) if j > i else (100 - i, 100 - j, a, b))
    assert found == expected and 10 < len(expected)
