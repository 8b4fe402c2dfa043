import os
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from conftest import rows
from tokenizers import Tokenizer

from millrace.llm.queries import QUERIES, TOKENIZER, tokenizer_path
from millrace.llm.token_files import Encoder, read_documents, read_tokens, write_tokens


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


CASES = ["", " ", "\n", "a", " a", "a ", "a\nb", "a \nb", "a\n b", "a  b", "\na", "a\n", "a,\nb.", "it's don't", "x\ty", "<|endoftext|> a",
         "é È ß́", "a\n\nb", "naïve,. 12 3a a3", "漢字 かな", "\x1ca \x1c b", "a 'b' \"c\"", "a\u00a0b", "-a- b- -", "''s 's", None]


def test_ids_are_those_of_the_library(library):
    encoder = Encoder(tokenizer_path(TOKENIZER), 2)
    rng = random.Random(3)
    parts = ["a", "Be", "é", " ", " ", "\n", "  ", "'s", "'", "12", ".", "-", "|", "\t", "漢", "the", "<|endoftext|>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text in [c or "" for c in CASES] + made + [" long word" * 250_000, "x" * 10_000]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library(text), text[:50]


def documents(spark):
    values = [(i * 3, c) for i, c in enumerate(CASES)] + [(None, "no id"), (6, "again"), (6, "again"), (9, "word " * 4000)]
    return spark.createDataFrame(values, "doc_id long, text string").repartition(5), values


def test_files_hold_all_documents_in_order(spark, tmp_path, library):
    df, values = documents(spark)
    folder = str(tmp_path / "ids")
    files = write_tokens(df, folder, tokenizer_path(TOKENIZER), 2)
    found = read_tokens(spark, folder, files, "crc long", zlib.crc32)
    whole = read_tokens(spark, folder, files, "ids binary").orderBy("start").collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in whole) == sorted(
        (str(i), library(t)) for i, t in values
    )
    ids = [r["doc_id"] for r in whole]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in whole:
        assert (r["start"], len(r["ids"])) == (at, 4 * r["n_tokens"])
        at += r["n_tokens"]
    assert rows(found, "doc_id", "crc") == rows(spark.createDataFrame(
        [(i, zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in ((i, library(t)) for i, t in values)], "doc_id long, crc long"
    ))


def test_single_documents_and_damage(spark, tmp_path, library):
    df, _ = documents(spark)
    folder = str(tmp_path / "ids")
    file = write_tokens(df.filter("doc_id = 9").coalesce(1), folder, tokenizer_path(TOKENIZER), 2).first()["file"]
    texts = [r["text"] for r in df.filter("doc_id = 9").collect()]
    found = read_documents(folder, file, [1, 0])
    assert sorted(x.tolist() for x in found) == sorted(library(t) for t in texts)
    path = os.path.join(folder, file)
    raw = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(plain) == 4 * sum(len(library(t)) for t in texts)
    with open(path, "wb") as out:
        out.write(raw[:12] + bytes([raw[12] ^ 255]) + raw[13:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        read_documents(folder, file, [0])
    with open(path, "wb") as out:
        out.write(raw[:-1])
    with pytest.raises(ValueError, match="no seek table"):
        read_documents(folder, file, [0])


def test_an_empty_table(spark, tmp_path):
    df, _ = documents(spark)
    files = write_tokens(df.limit(0), str(tmp_path / "ids"), tokenizer_path(TOKENIZER), 2)
    assert files.count() == 0 and read_tokens(spark, str(tmp_path / "ids"), files, "ids binary").count() == 0


def test_files_of_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Encoder(tokenizer_path("word_bpe_49k.json"), 2)


def test_the_query_agrees_with_the_library(spark, library):
    found = QUERIES["op10_token_files"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for row, doc in zip(found, docs, strict=True):
        ids = np.array(library(doc["text"]), dtype="<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
