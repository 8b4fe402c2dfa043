"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines are compiled from a model file:

* the normaliser: states for the begin of a text, within it and in a run of spaces; a space becomes the
  space mark, or nothing where runs are to be taken out, and a mark goes before the text;
* the pieces: a trie of states whose arcs read a character; the arc that ends a piece writes its id and goes back
  to the start. Its weight is the piece's negative score in a ``unigram`` model;
* byte fallback: from the start state an arc for every other character, which writes the ids of its bytes;
* in a ``bpe`` model, the merges: a machine over ids whose state is the last piece. The arc to the next one
  weighs 0 if merging leaves the two apart and infinity if it joins them, so the one path of
  finite weight is the result of merging.

They are composed with each input as the search asks for arcs, and the path of least weight (tropical
semiring: min, +) is the encoding; best-first search finds it (of several of least weight, any). Where no piece holds two neighbouring
characters together every path goes through the start state, so a text is solved in
such sections, and those of words met lately are kept solved.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import col, unused, whole, with_results

MARK = "▁"
#: What a worker keeps: solved words, sections and pairs, each at most twice so many and none of ``LONG`` characters;
#: results, of so many characters.
KEPT_WORDS, KEPT_SECTIONS, KEPT_PAIRS, LONG, BATCH_CHARS = 100_000, 100_000, 150_000, 100, 1 << 20
PIECE_CHARS = 1 << 20
APART, JOINED = 0.0, float("inf")
_UNKNOWN_SCORE = 10.0  # fixed value: how far below the worst piece an unknown character scores
_WORD_START = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_START = -1


class Normaliser:
    """A transducer over characters, given by its arcs: by state, the output and next state for a space and for others."""

    BEGIN, TEXT, GAP = range(3)

    def __init__(self, prefix: bool, collapse: bool):
        mark, none = MARK, ""
        first = mark if prefix else none
        self.collapse = collapse
        #: state: (output for a space, next state), (output before another character, next state)
        self.arcs = {
            self.BEGIN: ((none, self.BEGIN) if collapse else (first + mark, self.TEXT), (first, self.TEXT)),
            self.TEXT: ((none, self.GAP) if collapse else (mark, self.TEXT), (none, self.TEXT)),
            self.GAP: ((none, self.GAP), (mark, self.TEXT)),
        }

    def apply(self, text: str, state: int = BEGIN) -> tuple[str, int]:
        """Output and end state; within a text without runs to take out, all arcs of a state are taken at once."""
        if not text:
            return "", state
        if not self.collapse:
            head, state = self._step(text[0], state)
            return head + text[1:].replace(" ", self.arcs[self.TEXT][0][0]), state
        out = []
        for char in text:
            written, state = self._step(char, state)
            out.append(written)
        return "".join(out).rstrip(MARK), state  # marks at the end go too, whatever they come from

    def _step(self, char: str, state: int) -> tuple[str, int]:
        space, other = self.arcs[state]
        return space if char == " " else (other[0] + char, other[1])


class Merges:
    """The machine of a ``bpe`` model: whether merging leaves two neighbouring pieces apart."""

    def __init__(self, scores: dict[str, float]):
        order = sorted((p for p in scores if len(p) > 1), key=lambda p: -scores[p])
        self.rank: dict[str, int] = {}
        for n, piece in enumerate(order):  # pieces of one score merge as one: the leftmost pair first
            same = n and scores[piece] == scores[order[n - 1]]
            self.rank[piece] = self.rank[order[n - 1]] if same else n
        self.halves: dict[str, tuple[str, str] | None] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that merging joins last into this one; None if it ends otherwise."""
        if piece not in self.halves:
            parts, rank, last = list(piece), self.rank, None
            while len(parts) > 1:
                pairs = [(rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank]
                if not pairs:
                    break
                i = min(pairs)[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def weight(self, left: str, right: str) -> float:
        """Undo both pieces' merges from the last on; if at some time a pair over the border ranks before what
        was still to be merged beside it, merging would have joined it."""
        rank = self.rank
        before = rank.__len__() + 1
        l, r = rank.get(left, -1), rank.get(right, -1)
        if (l >= 0 and not self.split(left)) or (r >= 0 and not self.split(right)):
            return JOINED
        while True:
            pair = rank.get(left + right)
            if pair is not None and pair < before:
                return JOINED
            if l < 0 and r < 0:
                return APART
            if l > r:
                before, left = l, self.split(left)[1]
                l = rank.get(left, -1)
            else:  # of two pairs alike the left one is merged first
                before, right = r + 1, self.split(right)[0]
                r = rank.get(right, -1)


class PieceTransducer:
    """Compiled from a model file; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, trainer = model.normalizer_spec, model.trainer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if normal.precompiled_charsmap or trainer.treat_whitespace_as_suffix or not normal.escape_whitespaces:
            raise ValueError("a normaliser that replaces characters by a table is not compiled")
        if trainer.model_type not in (1, 2) or not trainer.byte_fallback:
            raise ValueError("only unigram and bpe models with byte fallback are compiled")
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("pieces defined by a user are not compiled")
        self.normaliser = Normaliser(normal.add_dummy_prefix, normal.remove_extra_whitespaces)
        self.prefix = normal.add_dummy_prefix
        scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.merges = Merges(scores) if trainer.model_type == 2 else None
        self.unknown = _UNKNOWN_SCORE - min(scores.values(), default=0.0)
        self.byte_id = [0] * 256
        self.surface: list[bytes] = []
        self.pieces: list[str] = [p.piece for p in model.pieces]
        #: the trie: a state is a dict from a character to (next state, id of the piece that ends here or -1, weight)
        self.start: dict = {}
        self.together: set[str] = set()
        for at, piece in enumerate(model.pieces):
            surface = b""
            if piece.type == kinds.BYTE:
                surface = bytes([int(piece.piece[3:5], 16)])
                self.byte_id[surface[0]] = at
            elif piece.type == kinds.NORMAL:
                self._add(piece.piece, at, 0.0 if self.merges else -piece.score)
                surface = piece.piece.replace(MARK, " ").encode()
            self.surface.append(surface)
        self.by_words = not any(pair[1] == MARK and pair[0] != MARK for pair in self.together)
        self.feeds_alone = not any("\n" in pair for pair in self.together)
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.sections: list[dict[str, bytes]] = [{}, {}]
        self.pairs: list[dict[int, float]] = [{}, {}]

    def _add(self, piece: str, at: int, weight: float) -> None:
        state = self.start
        for n, char in enumerate(piece, 1):
            following, known, cost = state.get(char) or ({}, -1, 0.0)
            state[char] = (following, at, weight) if n == len(piece) else (following, known, cost)
            state = following
            if n < len(piece):
                self.together.add(piece[n - 1 : n + 1])

    def arcs(self, section: str, begin: int) -> Iterator[tuple[int, int, float]]:
        """The composition with an input at one place of it: where a piece from there ends, its symbol and weight.

        A character that is no piece has a symbol of its own, beyond the ids: byte fallback.
        """
        state, single = self.start, False
        for end in range(begin, len(section)):
            arc = state.get(section[end])
            if arc is None:
                break
            state, symbol, weight = arc
            if symbol >= 0:
                single = single or end == begin
                yield end + 1, symbol, weight
        if not single:
            yield begin + 1, len(self.pieces) + ord(section[begin]), self.unknown

    def _spelling(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol < len(self.pieces) else chr(symbol - len(self.pieces))

    def joint(self, last: int, symbol: int) -> float:
        """The weight of the merges' arc from one piece to the next; that from the begin is only open to
        pieces that merging makes."""
        key = (last + 1) << 32 | symbol
        young, old = self.pairs
        found = young.get(key)
        if found is None:
            found = old.get(key)
            if found is None:
                spelled = self._spelling(symbol)
                if last == _START:
                    found = APART if len(spelled) == 1 or self.merges.split(spelled) else JOINED
                else:
                    found = self.merges.weight(self._spelling(last), spelled)
            young[key] = found
            if len(young) > KEPT_PAIRS:
                self.pairs = [{}, young]
        return found

    def shortest(self, section: str) -> list[int]:
        """The symbols on the path of least weight through the section, by best-first search.

        In a ``bpe`` model all finite weights are 0: the first whole path is a shortest one, and the longest
        step is tried first. A place is left once: its last piece is part of the state, but only one has
        a path of finite weight, as merging a prefix has one result.
        """
        return self._free_path(section) if self.merges else self._weighted_path(section)

    def _free_path(self, section: str) -> list[int]:
        whole_, start, own = len(section), self.start, len(self.pieces)
        joints, joint = self.pairs[0], self.joint
        at, last, open_arcs, closed = 0, _START, [], set()
        while at < whole_:
            # the arcs of the composition that leave this place
            state, arcs = start, []
            for end in range(at, whole_):
                arc = state.get(section[end])
                if arc is None:
                    break
                state, symbol, _ = arc
                if symbol >= 0:
                    arcs.append((end + 1, symbol))
            if not arcs or arcs[0][0] > at + 1:
                arcs.insert(0, (at + 1, own + ord(section[at])))
            while True:
                weight = JOINED
                while arcs and weight:
                    end, symbol = arcs.pop()
                    if end not in closed:
                        weight = joints.get((last + 1) << 32 | symbol)
                        if weight is None:
                            weight = joint(last, symbol)
                            joints = self.pairs[0]
                if not weight:
                    open_arcs.append((at, last, arcs))
                    at, last = end, symbol
                    break
                closed.add(at)
                if not open_arcs:
                    raise ValueError(f"no path through {section!r}")
                at, last, arcs = open_arcs.pop()
        return [symbol for _, symbol, _ in open_arcs[1:]] + [last]

    def _weighted_path(self, section: str) -> list[int]:
        whole_, count = len(section), 0
        heap: list[tuple] = [(0.0, 0, 0, _START, None)]
        left = set()
        while heap:
            weight, place, _, last, path = heapq.heappop(heap)
            at = -place
            if at == whole_:
                found = []
                while path is not None:
                    found.append(last)
                    last, path = path
                return found[::-1]
            if at in left:
                continue
            left.add(at)
            for end, symbol, cost in self.arcs(section, at):
                if end not in left:
                    count += 1
                    heapq.heappush(heap, (weight + cost, -end, count, symbol, (last, path)))
        raise ValueError(f"no path through {section!r}")

    def _section(self, section: str) -> bytes:
        young, old = self.sections
        found = old.get(section)
        if found is None:
            ids, known = [], len(self.pieces)
            for symbol in self.shortest(section):
                if symbol < known:
                    ids.append(symbol)
                else:
                    ids += [self.byte_id[b] for b in chr(symbol - known).encode()]
            found = array("i", ids).tobytes()
        if len(section) < LONG:
            young[section] = found
            if len(young) > KEPT_SECTIONS:
                self.sections = [{}, young]
        return found

    def _word(self, word: str) -> bytes:
        """The ids of a stretch that begins and ends in the start state."""
        together, known = self.together, self.sections[0].get
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in together]
        if not cuts:
            return known(word) or self._section(word)
        parts = [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]
        return b"".join([known(part) or self._section(part) for part in parts])

    def _solved(self, words: list[str], mark: str) -> list[bytes]:
        """Ids of words, each with ``mark`` before it unless it begins with a line feed; words met lately are known."""
        young, old = self.words
        found = list(map(young.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            ids = young.get(word)  # it may have come up a moment ago
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = self._word(word if word[:1] == "\n" or not mark else mark + word)
                if len(word) < LONG:
                    young[word] = ids
            found[at] = ids
        if len(young) > KEPT_WORDS:
            self.words = [{}, young]
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; none for ''."""
        # within such texts single spaces begin a word and line feeds a section, so words can be told apart at once
        usual = (
            self.by_words and self.feeds_alone and self.prefix and MARK not in text and "  " not in text
            and not text.startswith(" ") and not (self.normaliser.collapse and text.endswith(" "))
        )
        out, begin, state = [], 0, Normaliser.BEGIN
        while begin < len(text):
            end = text.find(" ", begin + PIECE_CHARS) if self.by_words and not self.normaliser.collapse else -1
            while 0 <= end < len(text) and text[end - 1] in (" ", MARK):  # not within a run of marks
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            if usual and (not self.normaliser.collapse or "\n " not in text and " \n" not in text):
                out += self._solved(text[begin + (begin > 0) : end].replace("\n", " \n").split(" "), MARK)
            else:
                marked, state = self.normaliser.apply(text[begin:end], state)
                pieces = _WORD_START.split(marked) if self.by_words else [marked]
                out += [self._word(p) for p in pieces if p]
            begin = end
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids stand for: pieces, bytes, marks as spaces, without the mark before the text."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """One per Python worker: compiled once, what is solved lasts from task to task."""
    return PieceTransducer(path)


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Documents with ``ids`` (array of int), ``n_tokens`` (long) and ``round_trip``.

    ``round_trip`` tells whether decoding the ids gives the text back; it does for every text without
    the space mark itself. NULL is as '': no ids, and a round trip of ''. Repeated rows are
    encoded alike, columns named like a result give way, an empty table stays empty. Whole texts are
    encoded on the executors, long ones section by section; nothing is shuffled. Results leave a
    worker in batches of about ``BATCH_CHARS`` characters, so its memory does not grow with
    Spark's batches; without ``keep_text`` the texts do not come back. ``model`` is a path that all executors can read.
    """
    (plain,) = unused([*docs.columns, "ids", "n_tokens", "round_trip"], "whole_text")
    results = {"ids", "n_tokens", "round_trip"}
    kept = [f for f in docs.schema.fields if f.name.lower() not in results and (keep_text or f.name.lower() != text.lower())]
    names = [f.name for f in kept]
    schema = T.StructType([
        *kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)

        def made(part: pa.RecordBatch, ids: list[np.ndarray], back: list[bool]) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            columns = [part.column(i) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, listed, pa.array(sizes), pa.array(back)], names=schema.names)

        for batch in batches:
            begin, chars, ids, back = 0, 0, [], []
            texts = batch.column(len(names))
            for at in range(len(texts)):
                text_ = texts[at].as_py()
                ids.append(fst.encode(text_))
                back.append(fst.decode(ids[-1]) == text_)
                chars += len(text_)
                if chars > BATCH_CHARS:
                    yield made(batch.slice(begin, at + 1 - begin), ids, back)
                    begin, chars, ids, back = at + 1, 0, [], []
            if ids:
                yield made(batch.slice(begin), ids, back)

    given = docs.select(*(col(n) for n in names), whole(col(text)).alias(plain))
    return given.mapInArrow(encode, schema)


def decode_documents(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Documents with ``decoded``, the text their ids stand for; NULL ids are none."""
    def decode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = transducer(model)
        for held in frames:
            yield pd.Series([fst.decode(np.asarray(x, dtype=np.int32)) for x in held], dtype=object)

    run = F.pandas_udf(decode, "string")
    return with_results(docs, {"decoded": run(F.coalesce(col(ids), F.array().cast("array<int>")))})
