import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from millrace.llm import importance
from millrace.llm.importance import Vocabulary, resample, split_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute(docs, target, share, min_words, buckets, seed=42):
    def bucketed(text):
        n, found = features(text)
        placed = Counter()
        for crc, times in found.items():
            placed[crc % buckets] += times
        return n, placed

    ours = [(key, *bucketed(text)) for key, text in docs]
    s = sum((placed for _, _, placed in ours), Counter())
    t = sum((bucketed(text)[1] for text in target), Counter())
    big_s, big_t = s.total(), t.total()
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)
    ]
    out = []
    for key, n, placed in ours:
        weight = sum(gain[b] * times for b, times in placed.items())
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, n, placed.total(), weight, weight + noise, None])
    eligible = sorted((o for o in out if o[1] >= min_words), key=lambda o: (-o[4], o[0] is None, o[0]))
    for rank, o in enumerate(eligible[: share[0] * len(eligible) // share[1]], 1):
        o[5] = rank
    return sorted(map(tuple, out), key=str)


WORDS = "the of and to In a is THAT for it as was with be by on not he i this naïve 漢字 x1 été ".split()
DOCS = [(i, " ".join(WORDS[(i * k * k + k) % len(WORDS)] for k in range(i % 47)) + "." * (i % 3)) for i in range(150)]
DOCS += [(None, None), (500, ""), (501, "?!"), (502, "w" * 200 + " " + "é" * 60 + " the of"), (503, "Same text of this"), (503, "Same text of this"),
         (504, "the of and " * 3000), (None, "to be or not to be")]
TARGET = ["The naïve of 漢字 to be", "not that, for it! is x1 a", None, "", "unseen words elsewhere"]


@pytest.mark.parametrize("share, min_words, buckets", [((5, 100), 20, 10_000), ((1, 2), 1, 17), ((1, 1), 0, 64), ((0, 1), 5, 64)])
@pytest.mark.parametrize("words, block", [(200_000, 1 << 19), (6, 50)])
def test_scores_are_those_of_a_plain_loop(spark, monkeypatch, share, min_words, buckets, words, block):
    monkeypatch.setattr(importance, "MOST_WORDS", words)
    monkeypatch.setattr(importance, "BLOCK", block)  # in workers that are forked from now on
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resample(docs, target, share, min_words, buckets)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    expected = brute(DOCS, TARGET, share, min_words, buckets)

    def plain(table):  # equal rows may take each other's rank
        return sorted((r[:5] for r in table), key=str), sorted((r[5], r[4]) for r in table if r[5] is not None)

    assert plain(got) == plain(expected)
    unique = [r for r in expected if r[0] is not None and r[0] != 503]
    assert [r for r in got if r[0] is not None and r[0] != 503] == unique


def test_states_of_the_head_and_crcs_of_the_tail_are_the_same(monkeypatch):
    texts = pd.Series([t for _, t in DOCS])
    head = Vocabulary.build([b"the", b"of", "naïve".encode(), b"to"], [(b"the", b"of"), (b"of", b"the"), (b"x", b"of")])
    none = Vocabulary.build([], [])
    for block in (1 << 19, 50, 3):
        monkeypatch.setattr(importance, "BLOCK", block)
        for vocabulary in (head, none):
            found = Counter()
            for words in importance._blocks(texts):
                for states, _ in vocabulary.features(*words):
                    found.update(states.tolist())
            assert found == sum((features(t)[1] for t in texts), Counter())


def test_shift_tables_join_states():
    for a, b in ((b"the", b" of"), (b"", b"x"), ("é".encode() * 9, b" " + b"y" * 31)):
        state, crc = np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32)
        assert importance._appended(state, np.array([len(b)]), crc)[0] == zlib.crc32(a + b)


def test_words():
    assert split_words("A-b c_D9 É é\x7fz") == [b"a", b"b", b"c", b"d9", "É é".encode(), b"z"]
    assert split_words(None) == split_words("") == split_words("_`{") == []


def test_columns_with_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(1, "a b", 5, "x", 7, {"k": 1})], "doc_id long, text string, RANK long, row string, score int, made map<string,int>"
    )
    target = df.select("text")
    found = resample(df, target, share=(1, 1), min_words=1)
    assert found.columns == ["doc_id", "row", "made", "n_words", "n_features", "weight", "score", "rank"]
    assert [tuple(r)[:5] + (r["rank"],) for r in found.collect()] == [(1, "x", {"k": 1}, 2, 3, 1)]
    assert resample(df.limit(0), target).count() == 0
    assert resample(df, target.limit(0), share=(1, 1), min_words=1).first()["rank"] == 1
