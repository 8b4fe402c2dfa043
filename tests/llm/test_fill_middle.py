import hashlib
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.llm.fill_middle import Marks, fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return text, n, "plain", None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", n, "spm", len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", n, "psm", len(prefix), len(middle)


TEXTS = [
    None, "", " ", "\n\t", "one", " one two ", "a b\n\nc\x0bd\x0ce\rf g", "$1 \\2 $ {3}", "x <P> y", "<S>", "a <M", "< P> <", "<<P",
    "naïve 漢字 🙂🙂 é́     z", "P> S> M> a", "\x00 \x1c \x85 b", "again and again", "word " * 20_000, "x" * 100_000,
]
DOCS = [(i * 7 + j, t) for i, t in enumerate(TEXTS) for j in range(6)] + [(None, "no id here"), (7, "one"), (7, "one")]
COLUMNS = ("fim_text", "n", "form", "prefix_chars", "middle_chars")


@pytest.mark.parametrize("options", [{}, {"rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100}, {"rate": 0}, {"seed": 7}])
def test_texts_are_cut_as_by_hand(spark, options):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    made = fill_in_middle(df, **options).withColumn("back", restored(F.col("fim_text"), F.col("form")))
    found = sorted((tuple(r) for r in made.select("doc_id", "text", *COLUMNS, "back").collect()), key=str)
    assert found == sorted(((k, t, *brute(k, t, **options), t or "") for k, t in DOCS), key=str)


def test_columns_with_clashing_names_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x", "y", 9)], "doc_id long, text string, N long, form string, body string, draws int")
    made = fill_in_middle(df, rate=100)
    assert made.columns == ["doc_id", "text", "body", "draws", "fim_text", "n", "form", "prefix_chars", "middle_chars"]
    assert rows(made, "body", "draws", "n") == [("y", 9, 3)]
    assert fill_in_middle(df.limit(0)).count() == 0


def test_other_marks_and_marks_that_cannot_be_told_apart(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    marks = Marks("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    made = fill_in_middle(df, rate=100, marks=marks)
    back = made.filter("form <> 'plain'").select("text", restored(F.col("fim_text"), F.col("form"), marks).alias("back"))
    assert back.count() > 20 and back.filter("text <> back").count() == 0
    for bad in (("", "b", "c"), ("$1", "b", "c"), ("a", "a", "c"), ("xy", "yz", "c"), ("abc", "b", "d"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            Marks(*bad)


def test_nothing_is_shuffled_and_no_python_runs(spark, plan):
    text = plan(fill_in_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert not any(word in text for word in ("Exchange", "ArrowEvalPython", "BatchEvalPython", "MapIn"))
