"""Token counts of texts: pieces are counted once per distinct pre-token and summed by frequency."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col, stored, unused, whole, with_results

#: Bounds of the broadcast: so many pre-tokens, so many bytes of them.
MOST_KNOWN, MOST_KNOWN_BYTES = 400_000, 8_000_000
#: A task hands on the distinct pre-tokens it has met when there are so many, or so many characters of them.
FLUSH_AT, FLUSH_CHARS = 200_000, 8_000_000
PIECE_CHARS = 1 << 20
_STEPS = 8  # bins of the number of occurrences to a power of two

# fixed values: the pattern that byte-level tokenizer files split texts by, and Unicode's white space
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RARE_SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

_SPACE = f"[ \n{RARE_SPACES}]"
_UNIT = re.compile(f"{_SPACE}*[^ \n{RARE_SPACES}]+|{_SPACE}+")
_BREAK = re.compile(f"(?<=[^ \n{RARE_SPACES}]){_SPACE}")
_ODD = (*RARE_SPACES, "  ", " \n", "\n ")


class PreTokens:
    """Pre-tokens of texts and the number of pieces of each, as a ``tokenizers`` file has them.

    No pre-token reaches over the begin of white space, so a text is first cut there into units,
    which repeat a lot and are split once; cuts at single spaces are exact wherever no white space
    stands beside them. Units of characters that the ``regex`` module classes as the library does (each
    character is tried once) are split by the pattern, all others by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is not None or "ByteLevel" not in repr(self.tokenizer.pre_tokenizer):
            raise ValueError("only byte-level models without a normaliser are counted by pre-tokens")
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        # special strings count as one token each, as the library has it by default
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.names = tuple(names)
        self.model, self.pattern = self.tokenizer.model, regex.compile(BYTE_LEVEL)
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.spelled = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}
        self.alike: dict[str, bool] = {}
        self._compare()

    def _compare(self) -> None:
        """The library's own counts of a few texts, so that a file made otherwise is refused."""
        for text in ("it's  a\n\n b1 2.\t'll x,y é z", " a  ", "\n \n", "don'tt  's\r\n1a!"):
            ours = sum(self.pieces(t) * n for t, n in self.frequencies(text).items())
            if ours != len(self.tokenizer.encode(text, add_special_tokens=False).ids):
                raise ValueError("this tokenizer file does not split texts by the byte-level pattern")

    def _same(self, char: str) -> bool:
        """Whether the pattern splits texts with this character as the library does."""
        found = self.alike.get(char)
        if found is None:
            text = f"a{char}a 1{char}1 .{char}. {char} {char}"
            spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            found = self.alike[char] = spans == [m.span() for m in self.pattern.finditer(text)]
        return found

    def split(self, unit: str) -> list[str]:
        """The pre-tokens of a unit or any text without special strings."""
        if unit.isascii() or all(map(self._same, set(unit))):
            return self.pattern.findall(unit)
        return [unit[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    def parts(self, text: str) -> Iterator[str]:
        """The text between special strings, which themselves come as they are; long ones in pieces."""
        marked = self.special is not None and any(name in text for name in self.names)
        ends = [(m.start(), m.end()) for m in self.special.finditer(text)] if marked else []
        begin = 0
        for stop, after in [*ends, (len(text), len(text))]:
            while begin < stop:
                at = _BREAK.search(text, begin + PIECE_CHARS, stop) if stop - begin > PIECE_CHARS else None
                end = at.start() if at else stop
                yield text[begin:end]
                begin = end
            if after > stop:
                yield text[stop:after]
            begin = after

    @staticmethod
    def units(part: str) -> Iterable[str]:
        """White space with what follows it, left to right."""
        if any(map(part.__contains__, _ODD)):
            return _UNIT.findall(part)
        first, *rest = part.split(" ")
        return [*([first] if first else []), *[" " + u for u in rest]]

    def unit_counts(self, text: str) -> Counter[str]:
        """How often each unit stands in a text; a special string is a unit."""
        found: Counter[str] = Counter()
        for part in self.parts(text):
            found.update((part,) if part in self.names else self.units(part))
        return found

    def of_unit(self, unit: str) -> list[str]:
        return [unit] if unit in self.names else self.split(unit)

    def frequencies(self, text: str) -> Counter[str]:
        """How often each pre-token stands in a text."""
        found: Counter[str] = Counter()
        for unit, n in self.unit_counts(text).items():
            for token in self.of_unit(unit):
                found[token] += n
        return found

    def pieces(self, token: str) -> int:
        """The number of pieces of a pre-token; 1 for a special string."""
        if token in self.names:
            return 1
        return len(self.model.tokenize(token.encode().decode("latin-1").translate(self.spelled)))


@functools.lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One per Python worker."""
    return PreTokens(path)


def _vocabulary(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pre-tokens of texts with their numbers, added up as far as a task's memory is meant for it."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library, units, chars = pre_tokens(path), Counter(), 0

        def flush() -> pd.DataFrame:
            found: Counter[str] = Counter()
            for unit, n in units.items():
                for token in library.of_unit(unit):
                    found[token] += n
            units.clear()
            return pd.DataFrame({"token": list(found.keys()), "n": list(found.values())})

        for frame in frames:
            for text in frame["text"]:
                before = len(units)
                units.update(library.unit_counts(text))
                chars += len(text) if len(units) > before else 0
                if len(units) > FLUSH_AT or (chars > FLUSH_CHARS and sum(map(len, units)) > FLUSH_CHARS):
                    yield flush()
                    chars = 0
                elif chars > FLUSH_CHARS:
                    chars = 0
        if units:
            yield flush()

    return count


def vocabulary(texts: DataFrame, tokenizer: str) -> DataFrame:
    """Every distinct pre-token of the column ``text``: token, n (occurrences) and pieces.

    Tasks add up what they meet, Spark adds up the tasks, and each distinct pre-token is handed to
    the library's model once.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = pre_tokens(tokenizer)
        for frame in frames:
            yield frame.assign(pieces=[library.pieces(t) for t in frame["token"]])

    met = texts.select("text").mapInPandas(_vocabulary(tokenizer), "token string, n long")
    return met.groupBy("token").agg(F.sum("n").alias("n")).mapInPandas(count, "token string, n long, pieces long")


def _most_frequent(tokens: DataFrame) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, within the bounds.

    Numbers of occurrences are put into bins, a few hundred rows; as many of the highest bins as fit are taken.
    """
    bins = tokens.groupBy(F.floor(F.log2("n") * _STEPS).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("token")).alias("bytes")
    ).collect()
    lowest, rows, size = None, 0, 0
    for row in sorted(bins, key=lambda r: -r["bin"]):
        rows, size = rows + row["rows"], size + row["bytes"]
        if rows > MOST_KNOWN or size > MOST_KNOWN_BYTES:
            break
        lowest = row["bin"]
    if lowest is None:
        return {}
    chosen = tokens.filter(F.floor(F.log2("n") * _STEPS).cast("int") >= lowest).select("token", "pieces")
    found = chosen.toPandas()
    return dict(zip(found["token"], found["pieces"].tolist(), strict=True))


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text",
) -> DataFrame:
    """The table without its texts, with ``n_bytes`` (UTF-8), ``n_tokens`` (long) and ``over_limit``.

    The distinct pre-tokens of all texts are counted and each is split into pieces once. The
    frequencies of a document's pre-tokens meet these numbers in two ways, both exact: those of the most
    frequent pre-tokens, of proven size, are broadcast and summed where the text is read; what is left of a
    document, pre-tokens that are all rare, so that none is a hot key, is shuffled and joined. No ids are kept.

    Texts are read twice and not shuffled; a task holds one text and bounded tables. Special strings in
    a text are one token each. NULL texts count as ''; equal rows count alike, each for itself; an
    empty table gives an empty table; columns named like a result give way.
    """
    spark = docs.sparkSession
    body, made, row = unused(docs.columns, "body", "made", "row")
    texts = docs.select(whole(col(text)).alias("text"))
    tokens = stored(vocabulary(texts, tokenizer))
    broadcast = spark.sparkContext.broadcast(_most_frequent(tokens))

    @F.pandas_udf("known long, rest array<string>, times array<long>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        library, pieces = pre_tokens(tokenizer), broadcast.value
        whole_units: dict[str, int] = {}  # units of broadcast pre-tokens only
        for batch in batches:
            sums, rests, numbers = [], [], []
            for text_ in batch:
                total, rare = 0, Counter()
                for unit, n in library.unit_counts(text_).items():
                    found = whole_units.get(unit)
                    if found is None:
                        split = library.of_unit(unit)
                        had = [pieces.get(token) for token in split]
                        if None in had:
                            for token, k in zip(split, had):
                                if k is None:
                                    rare[token] += n
                                else:
                                    total += n * k
                            continue
                        if len(whole_units) > MOST_KNOWN:
                            whole_units.clear()
                        found = whole_units[unit] = sum(had)
                    total += n * found
                sums.append(total)
                rests.append(list(rare.keys()))
                numbers.append(list(rare.values()))
            yield pd.DataFrame({"known": sums, "rest": rests, "times": numbers})

    counted = docs.withColumn(body, whole(col(text)))
    kept = [col(c) for c in docs.columns if c.lower() != text.lower()]
    counted = counted.select(
        *kept, F.octet_length(col(body)).cast("long").alias(body), count(col(body)).alias(made),
        F.monotonically_increasing_id().alias(row),
    )
    # once written, a row's number is its own
    counted = stored(counted)
    parts = counted.select(
        F.col(row).alias("row"), F.explode(F.arrays_zip(f"{made}.rest", f"{made}.times")).alias("part")
    ).select("row", F.col("part.rest").alias("token"), F.col("part.times").alias("n"))
    rare = (
        parts.join(tokens.select("token", "pieces"), "token").groupBy(F.col("row").alias("of"))
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    )
    of, more = unused(counted.columns, "of", "rare")
    joined = counted.join(rare.select(F.col("of").alias(of), F.col("rare").alias(more)), F.col(row) == F.col(of), "left")
    total: Column = F.col(f"{made}.known") + F.coalesce(F.col(more), F.lit(0))
    found = with_results(joined, {"n_bytes": F.col(body), "n_tokens": total.cast("long"), "over_limit": total > limit})
    return found.drop(body, made, row, of, more)
