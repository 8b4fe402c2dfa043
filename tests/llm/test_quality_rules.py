import random
from collections import Counter

import pytest
from conftest import rows

from millrace.llm.quality_rules import RULES, Measured, Rule, judge_quality, measured, ordered_rules, with_metrics

METRICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)
    )


def texts():
    rng = random.Random(4)
    made = [None, "", " \n\t", "a", "a a a a", "a b a b a b", "x#*$%&|<>é", "l\nl\n l\n\nl", "a\u00a0b a\u00a0b", "z " * 5000]
    for _ in range(30):
        made.append("".join(rng.choice(["a", "b", "cc", "é", "#"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 80))))
    return made


def test_metrics_are_those_counted_by_hand(spark):
    given = dict(enumerate(texts()))
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3)
    found = with_metrics(df, "text", set(METRICS)).select("doc_id", *METRICS).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {i: brute(t) for i, t in given.items()}


@pytest.mark.parametrize("order", [RULES, RULES[::-1]])
def test_verdicts_do_not_depend_on_the_order_or_the_metrics_kept(spark, order):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    kept = judge_quality(df, order, keep_metrics=True)
    lean = judge_quality(df, order)
    assert lean.columns == ["doc_id", "text", "kept"]
    expected = {}
    for i, text in enumerate(texts()):
        n_words, chars, symbols, n_lines, dup, repeat = brute(text)
        expected[i] = not (
            n_words < 50 or 100 * repeat > 50 * n_words or 100 * symbols > 10 * n_words
            or (dup > 2 and 100 * dup > 30 * n_lines) or chars < 2 * n_words or chars > 15 * n_words
        )
    assert dict(map(tuple, kept.select("doc_id", "kept").collect())) == expected
    assert dict(map(tuple, lean.select("doc_id", "kept").collect())) == expected


def test_rules_are_ordered_by_rejection_per_cost(spark):
    a, b, c = (Rule(n, ("n_words",), "n_words < 1") for n in "abc")
    assert [r.name for r in ordered_rules([Measured(a, 1.0, 0.5), Measured(b, 0.1, 0.2), Measured(c, 9.0, 0.0)])] == ["b", "a", "c"]
    df = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    (found,) = measured(df, [a])
    assert found.rejected == 0.5 and found.seconds > 0


def test_clashing_names_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", 3)], "doc_id long, text string, w string, grams string, Kept int")
    assert rows(judge_quality(df)) == [(1, "a b", "x", "y", False)]
    assert judge_quality(df, keep_metrics=True).columns[:4] == ["doc_id", "text", "w", "grams"]
    assert judge_quality(df.limit(0)).count() == 0
