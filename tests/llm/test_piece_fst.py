import random

import numpy as np
import pytest
import sentencepiece
from conftest import rows

from millrace.llm import piece_fst
from millrace.llm.piece_fst import PieceTransducer, decode_documents, encode_documents
from millrace.llm.queries import PIECE_MODEL, tokenizer_path

CASES = ["", " ", "  a  b", "a\nb\tc", "é é", "Ⅷ ﬁ", "a ", "漢字\u3000x", "\x00a", "<s>", "<0x41>", "   ", "x" * 100, " " * 50 + "a" + " " * 33,
         "日本語のテスト", "🙂 hi", "a \nb", "\nfoo", "a\n b", "a\n\nb", " foo", "\n", "a \n b", "it's 12.5%"]


@pytest.fixture(scope="module")
def model():
    return tokenizer_path(PIECE_MODEL)


def compared(path, texts):
    fst, library = PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in texts:
        assert fst.encode(text).tolist() == library.encode(text), text[:60]
    return fst


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "é", "ing", ".", "7", "▁", "漢", "b", "ab", "ba"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_the_shortest_path_is_what_the_library_returns(model):
    rng = random.Random(1)
    fst = PieceTransducer(model)
    pieces = [p for p in fst.pieces if not p.startswith("<")]
    made = ["".join(rng.choice(pieces)[: rng.randint(1, 6)] for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    texts = CASES + made + random_texts(1, 3000) + ["some words and " * 100_000, "x" * 20_000]
    fst = compared(model, texts)
    for text in texts:
        assert fst.decode(fst.encode(text)) == text.replace("▁", " ")


def test_forgotten_words_and_pairs_are_solved_again(model, monkeypatch):
    monkeypatch.setattr(piece_fst, "KEPT_WORDS", 3)
    monkeypatch.setattr(piece_fst, "KEPT_PAIRS", 3)
    monkeypatch.setattr(piece_fst, "KEPT_SECTIONS", 3)
    monkeypatch.setattr(piece_fst, "PIECE_CHARS", 5)
    compared(model, CASES + random_texts(2, 500))


def test_weights_of_merges_tell_whether_merging_leaves_two_pieces_apart(model):
    merges = PieceTransducer(model).merges

    def merged(parts):
        while True:
            pairs = [(merges.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in merges.rank]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    rng, pieces = random.Random(4), [*merges.rank]
    short = [p for p in pieces if len(p) < 4]
    for _ in range(6000):
        left, right = rng.choice(rng.choice((pieces, short, "aeirstn"))), rng.choice(rng.choice((pieces, short, "aeirstn")))
        assert (merges.weight(left, right) == piece_fst.APART) == (merged(list(left + right)) == [left, right])


def model_file(path, pieces, unigram, **normaliser):
    """A small model written by hand: bytes, then pieces with scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    made = pb.ModelProto()
    made.trainer_spec.model_type = 1 if unigram else 2
    made.trainer_spec.byte_fallback = True
    made.normalizer_spec.name = "identity"
    options = {"add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True} | normaliser
    for name, value in options.items():
        setattr(made.normalizer_spec, name, value)
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        made.pieces.add(piece=name, score=0, type=kind)
    for b in range(256):
        made.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for piece, score in pieces.items():
        made.pieces.add(piece=piece, score=score, type=1)
    path.write_bytes(made.SerializeToString())
    return str(path)


PIECES = {"▁": -2.1, "a": -2.03, "b": -2.57, "ab": -3.11, "ba": -3.93, "aba": -5.21, "▁a": -2.9, "the": -4.07, "t": -6.01, "h": -6.33,
          "e": -5.77, "▁the": -4.5, "\n": -3.01, "a▁": -4.2, "é": -7.7, "i": -5.31, "n": -5.83, "g": -6.11, "in": -6.2, "ing": -6.9}


@pytest.mark.parametrize("options", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": True},
                                     {"remove_extra_whitespaces": True, "add_dummy_prefix": False}])
@pytest.mark.parametrize("dropped", [(), ("a▁",), ("a▁", "é", "▁the")])
@pytest.mark.parametrize("unigram", [True, False])
def test_other_models_and_normalisers(tmp_path, options, dropped, unigram):
    path = model_file(tmp_path / "m.model", {p: s for p, s in PIECES.items() if p not in dropped}, unigram, **options)
    compared(path, [c for c in CASES if len(c) < 200] + random_texts(3, 800))


def test_documents_are_encoded_and_decoded(spark, model):
    values = [(i, t, "x", "y") for i, t in enumerate([*CASES, None, "a▁b"])]
    df = spark.createDataFrame(values + values[:3], "doc_id long, text string, Ids string, found string").repartition(3)
    found = encode_documents(df, model)
    assert found.columns == ["doc_id", "text", "found", "ids", "n_tokens", "round_trip"]
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for row in found.collect():
        assert row["ids"] == library.encode(row["text"] or "") and row["n_tokens"] == len(row["ids"])
        assert row["round_trip"] == ("▁" not in (row["text"] or ""))
    decoded = decode_documents(found, model)
    assert rows(decoded, "doc_id", "decoded") == rows(spark.createDataFrame(
        [(i, (t or "").replace("▁", " ")) for i, t, _, _ in values + values[:3]], "doc_id long, decoded string"
    ))
    assert encode_documents(df.limit(0), model).count() == 0


def test_models_that_are_not_compiled_are_refused(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2

    def changed(change):
        made = sentencepiece_model_pb2.ModelProto()
        made.ParseFromString(open(model, "rb").read())
        change(made)
        (tmp_path / "m.model").write_bytes(made.SerializeToString())
        return str(tmp_path / "m.model")

    def user_piece(made):
        made.pieces.add(piece="xyz", score=0, type=4)

    for change in (
        lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"xyz"), user_piece,
        lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.trainer_spec, "model_type", 3),
    ):
        with pytest.raises(ValueError, match="compiled"):
            PieceTransducer(changed(change))
    assert np.array_equal(PieceTransducer(model).encode("a b"), PieceTransducer(model).encode("a b"))
