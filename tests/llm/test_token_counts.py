import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import queries, token_counts
from millrace.llm.queries import TOKENIZER, tokenizer_path
from millrace.llm.token_counts import PreTokens, count_tokens, vocabulary

CASES = [
    None, "", " ", "\n", "a", " a", "a ", "a\nb", "a \nb", "a\n b", "a  b", "\na", "a\n", "a,\nb.", "it's don't", "x\ty", "''s 's",
    "<|endoftext|>", "<|endoftext|> a", "a <|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", "<|endoftext", "é È ß́",
    "漢字 かな", "\x1ca \x1c b", "a b 　 c ", "՘࢏ a՘b \U00010940\U00010941", "🙂 🙂🙂", "a\r\n\r\nb", "    x   ",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "Be", "é", " ", " ", "\n", "  ", "'s", "'", "12", ".", "-", "\t", "漢", "the", "<|endoftext|>", "՘", "\xa0", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(n)]


def test_pre_tokens_sum_up_to_the_library(library, monkeypatch):
    pre = PreTokens(tokenizer_path(TOKENIZER))
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 7)
    for text in [c or "" for c in CASES] + random_texts(3000, 5):
        assert sum(pre.pieces(t) * n for t, n in pre.frequencies(text).items()) == library(text), text


def test_a_file_made_otherwise_is_refused():
    with pytest.raises(ValueError):
        PreTokens(tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("known", [0, 5, 400_000])
def test_counts_are_those_of_the_library(spark, library, monkeypatch, known):
    monkeypatch.setattr(token_counts, "MOST_KNOWN", known)
    docs = [(i, t) for i, t in enumerate(CASES + random_texts(60, 6))]
    docs += [(None, "no id"), (1, "again and again"), (1, "again and again"), (99, "word " * 200_000), (98, "x" * 20_000), (97, "=" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = rows(count_tokens(df, tokenizer_path(TOKENIZER), limit=10), "doc_id", "n_bytes", "n_tokens", "over_limit")
    expected = [(i, len((t or "").encode()), library(t), library(t) > 10) for i, t in docs]
    assert found == sorted(expected, key=lambda r: [(v is not None, str(v)) for v in r])


def test_each_pre_token_is_counted_once(spark, monkeypatch):
    monkeypatch.setattr("millrace.llm.token_counts.FLUSH_AT", 3)
    df = spark.createDataFrame([("a b a\n c",), ("a b  a",), ("", )], "text string").repartition(2)
    assert rows(vocabulary(df, tokenizer_path(TOKENIZER)), "token", "n") == [
        ("\n", 1), (" ", 1), (" a", 2), (" b", 2), (" c", 1), ("a", 2),
    ]


def test_columns_with_clashing_names_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", {"k": 1})], "doc_id long, text string, N_Tokens long, row string, made map<string,int>")
    found = count_tokens(df, tokenizer_path(TOKENIZER))
    assert found.columns == ["doc_id", "row", "made", "n_bytes", "n_tokens", "over_limit"]
    assert [tuple(r) for r in found.collect()] == [(1, "x", {"k": 1}, 3, 2, False)]
    assert count_tokens(df.limit(0), tokenizer_path(TOKENIZER)).count() == 0


def test_the_query_agrees_with_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in queries.QUERIES["op11_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.octet_length("text").alias("n")).collect()
    assert len(found) == len(docs)
    for doc in docs:
        mine = found[doc["doc_id"]]
        assert (mine["n_bytes"], mine["n_tokens"]) == (doc["n"] or 0, library(doc["text"]))
        assert mine["over_limit"] == (mine["n_tokens"] > 512)
