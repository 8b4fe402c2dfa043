"""Resampling towards a target distribution by importance weights of hashed n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import col, stored, unused, whole, with_results
from millrace.plans.numbering import number_rows

LONGEST = 3
#: Bounds of the broadcast vocabulary; words longer than so many bytes belong to the tail.
MOST_WORDS, MOST_PAIRS, LONGEST_WORD = 200_000, 65_536, 31
#: Words handled together; of a longer text, so many at a time.
BLOCK = 1 << 19
_OFTEN = 4  # a feature is proposed for the vocabulary from so many occurrences in a block
_SLOTS = 1 << 19  # of the table of pairs, eight for each
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd number that spreads keys over the upper bits

# A-Z to a-z; 0-9, a-z and all bytes beyond ASCII stay, the rest ends a word
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    """Words as UTF-8: runs of digits, a-z and everything beyond ASCII, after A-Z is lower-cased."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def _shift_tables() -> np.ndarray:
    """What appending n zero bytes makes of a CRC-32 state, n up to a word and a space, by the state's four bytes.

    The step is linear, so the state of joined texts is the shifted state of the first, exclusive-or the
    CRC of the second.
    """
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    states = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    found = [states]
    for _ in range(LONGEST_WORD + 1):
        states = table[states & 0xFF] ^ (states >> np.uint32(8))
        found.append(states)
    return np.stack(found)


_SHIFTS = _shift_tables()


def _appended(state: np.ndarray, length: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """States of texts after ``length`` more bytes whose CRC is ``crc``."""
    parts = [_SHIFTS[length, k, (state >> np.uint32(8 * k)) & np.uint32(0xFF)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3] ^ crc


@dataclass
class Vocabulary:
    """The head: exact CRC states of frequent words, and of frequent pairs in a table of one key a slot.

    A pair whose slot is taken is left out; like all features that are not in the tables, it is
    computed where it occurs, so what is in them decides the speed only.
    """

    words: dict[bytes, int]
    state: np.ndarray
    spaced: np.ndarray
    length: np.ndarray
    keys: np.ndarray
    pair_state: np.ndarray

    @classmethod
    def build(cls, words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> Vocabulary:
        """``pairs`` of these words, the most frequent first."""
        numbers = {w: n for n, w in enumerate(words)}
        keys, states = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint32)
        for a, b in pairs:
            if a in numbers and b in numbers:
                key = cls.pair_keys(np.array([numbers[a]]), np.array([numbers[b]]))
                slot = cls.slots(key)[0]
                if not keys[slot]:
                    keys[slot], states[slot] = key[0], zlib.crc32(a + b" " + b)
        return cls(
            numbers, np.array([zlib.crc32(w) for w in words], np.uint32),
            np.array([zlib.crc32(b" " + w) for w in words], np.uint32),
            np.array([len(w) + 1 for w in words], np.int64), keys, states,
        )

    @staticmethod
    def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Never 0, which marks a free slot."""
        return (first.astype(np.uint64) << np.uint64(32)) + second.astype(np.uint64) + np.uint64(1)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - _SLOTS.bit_length() + 1)).astype(np.int64)

    def features(self, words: list[bytes], text: np.ndarray, own: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """CRC of each run of one to three words of the same text that begins in the first ``own`` words, with
        the position of its first word. ``text`` tells which text a word is of.
        """
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        joined = b" ".join(words)
        begins = np.cumsum(lengths + 1) - lengths - 1
        head = known >= 0
        previous: np.ndarray | None = None  # states of the runs one shorter, right where all words are known
        for n in range(1, min(LONGEST, len(words)) + 1):
            count = len(words) - n + 1
            in_head, last = head[:count].copy(), known[n - 1 :]
            for k in range(1, n):
                in_head &= head[k : k + count]
            states = np.zeros(count, np.uint32)
            if n == 1:
                states[head] = self.state[known[head]]
            else:
                open_ = np.flatnonzero(in_head)
                if n == 2 and len(open_):
                    keys = self.pair_keys(known[open_], last[open_])
                    slots = self.slots(keys)
                    hit = self.keys[slots] == keys
                    states[open_[hit]] = self.pair_state[slots[hit]]
                    open_ = open_[~hit]
                ends = last[open_]
                states[open_] = _appended(previous[open_], self.length[ends], self.spaced[ends])
            same = text[:count] == text[n - 1 :]
            same[own:] = False
            tail = np.flatnonzero(same & ~in_head)
            stops = (begins[n - 1 :] + lengths[n - 1 :])[tail].tolist()
            states[tail] = [zlib.crc32(joined[a:b]) for a, b in zip(begins[tail].tolist(), stops)]
            at = np.flatnonzero(same)
            yield states[at], at
            previous = states


def _blocks(texts: pd.Series) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Words of several texts, the row of each, and how many of the words are the block's own.

    A text longer than a block comes in parts; the words after the own ones are lent from the next part, so
    that runs over the cut are whole.
    """
    words: list[bytes] = []
    rows: list[np.ndarray] = []
    for row, text in enumerate(texts):
        split = split_words(text)
        for begin in range(0, len(split), BLOCK):
            part = split[begin : begin + BLOCK + LONGEST - 1]
            if words and len(words) + len(part) > BLOCK:
                yield words, np.concatenate(rows), len(words)
                words, rows = [], []
            words.extend(part)
            rows.append(np.full(len(part), row, np.int64))
            if begin + BLOCK < len(split):
                yield words, np.concatenate(rows), len(words) - (len(part) - BLOCK)
                words, rows = [], []
    if words:
        yield words, np.concatenate(rows), len(words)


def _frequent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and pairs that repeat within a block of texts: proposals for the vocabulary."""
    for frame in frames:
        for words, rows, _ in _blocks(frame["text"]):
            single = Counter(words)
            pairs = Counter(zip(words, words[1:]))  # a pair over the end of a text does no harm here
            found = [(w.decode(), None, n) for w, n in single.items() if n >= _OFTEN and len(w) <= LONGEST_WORD]
            found += [
                (a.decode(), b.decode(), n) for (a, b), n in pairs.items()
                if n >= _OFTEN and len(a) <= LONGEST_WORD and len(b) <= LONGEST_WORD
            ]
            yield pd.DataFrame(found, columns=["word", "next", "n"])


def vocabulary(texts: DataFrame) -> Vocabulary:
    """The most frequent words and pairs of the column ``text``, at most ``MOST_WORDS`` and ``MOST_PAIRS``.

    Proposals of all blocks are added up. Numbers of occurrences go into bins, a few hundred rows, and
    as many of the highest bins as fit are taken, so what is broadcast has a proven size.
    """
    met = texts.select("text").mapInPandas(_frequent, "word string, next string, n long")
    counted = stored(met.groupBy("word", "next").agg(F.sum("n").alias("n")).withColumn(
        "bin", F.floor(F.log2("n") * 8).cast("int")
    ))

    def most(rows: DataFrame, limit: int) -> pd.DataFrame:
        lowest, total = None, 0
        for row in sorted(rows.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
            total += row["count"]
            if total > limit:
                break
            lowest = row["bin"]
        chosen = rows.filter(F.col("bin") >= lowest) if lowest is not None else rows.limit(0)
        return chosen.toPandas().sort_values(["n", "word", "next"], ascending=[False, True, True])

    words = most(counted.filter("next IS NULL"), MOST_WORDS)
    pairs = most(counted.filter("next IS NOT NULL"), MOST_PAIRS)
    return Vocabulary.build(
        [w.encode() for w in words["word"]], [(a.encode(), b.encode()) for a, b in zip(pairs["word"], pairs["next"])]
    )


def bucket_totals(texts: DataFrame, head: Vocabulary, buckets: int) -> np.ndarray:
    """How many features of the column ``text`` are in each bucket, exactly; one row a bucket comes to the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(buckets, np.int64)
        for frame in frames:
            for block in _blocks(frame["text"]):
                for states, _ in shared.value.features(*block):
                    totals += np.bincount(states % buckets, minlength=buckets)
        at = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": at, "n": totals[at]})

    met = texts.select("text").mapInPandas(add, "bucket long, n long")
    found = met.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(buckets, np.int64)
    totals[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return totals


def gains(spark: SparkSession, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier a bucket is in the target, rounded down; one is added to all totals."""
    n, s, t = F.lit(len(source)), F.lit(int(source.sum())), F.lit(int(target.sum()))
    totals = spark.createDataFrame(
        list(zip(range(len(source)), source.tolist(), target.tolist())), "bucket int, s long, t long"
    )
    ours, theirs = (F.col("s") + 1).cast("double") * (t + n), (F.col("t") + 1).cast("double") * (s + n)
    found = totals.select("bucket", F.floor(F.log(theirs / ours) * 1000).alias("gain")).toPandas().sort_values("bucket")
    return found["gain"].to_numpy(np.int64)


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, buckets: int = 10_000,
    seed: int = 42, key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """The table without its texts, with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (long).

    Features are all runs of one to three words; a feature's bucket is the CRC-32 of its UTF-8 bytes
    modulo ``buckets``. The weight of a document is the sum of its features' gains; its score adds Gumbel noise
    drawn from its key, so the highest scores are a sample without replacement by importance.
    Of the documents with ``min_words`` or more, the ``share`` with the highest scores is drawn, ties to the
    smaller key; they are ranked from 1, the others have a NULL rank.

    Frequent words come with their CRC states and frequent pairs with their states in a broadcast of
    bounded size. Runs of frequent words extend these states; runs with a word of the tail take the
    CRC of their bytes. Both give the same buckets, and totals cover all texts. Texts are read
    three times and never shuffled; the totals are one row a bucket and task. Of the scores only those that
    can be drawn are sorted, over ranges.

    NULL texts have no words: weight and features 0. A NULL key is ''; it comes last among equal scores.
    Equal rows have equal scores and a rank each. Empty tables give empty results, an empty target a
    weight by the source alone. Columns named like a result give way.
    """
    spark = docs.sparkSession
    texts, wanted = docs.select(whole(col(text)).alias("text")), target.select(whole(col(target_text)).alias("text"))
    head = vocabulary(texts)
    gain = gains(spark, bucket_totals(texts, head, buckets), bucket_totals(wanted, head, buckets))
    shared = spark.sparkContext.broadcast((head, gain))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary_, gain_ = shared.value
        for batch in batches:
            sums = np.zeros((3, len(batch)), np.int64)
            for words, rows, own in _blocks(batch):
                first = rows[0]  # rows of a block are neighbours
                for n, (states, at) in enumerate(vocabulary_.features(words, rows, own)):
                    of = rows[at] - first
                    size = np.bincount(of)
                    if n == 0:
                        sums[0, first : first + len(size)] += size
                    sums[1, first : first + len(size)] += size
                    # sums of whole numbers below 2^53 are exact
                    sums[2, first : first + len(size)] += np.bincount(of, weights=gain_[states % buckets]).astype(np.int64)
            yield pd.DataFrame({"n_words": sums[0], "n_features": sums[1], "weight": sums[2]})

    made, row, score, of, place = unused(docs.columns, "made", "row", "score", "of", "place")
    kept = [col(c) for c in docs.columns if c.lower() != text.lower()]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    noise = F.floor(F.log(-F.log(uniform)) * -1000)
    # once written, a row's number is its own
    weighed = stored(docs.select(*kept, weigh(whole(col(text))).alias(made), F.monotonically_increasing_id().alias(row)))
    weighed = weighed.withColumn(score, F.col(f"{made}.weight") + noise)

    part, of_all = share
    eligible = weighed.filter(F.col(f"{made}.n_words") >= min_words).select(
        F.col(score).alias("score"), col(key).alias("key"), F.col(row).alias("row")
    )
    # a quantile that is surely low enough: its rank is off by a ten-thousandth at most
    low = max(0.0, 1 - part / of_all - 0.01)
    about = eligible.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", low, 10_000).alias("cut")).first()
    drawn = part * about["n"] // of_all
    best = eligible.filter(F.col("score") >= about["cut"]) if drawn else eligible.limit(0)
    best = best.withColumn("once", F.lit(1).cast("long"))
    ranked = number_rows(best, [F.col("score").desc(), F.col("key").asc_nulls_last()], "rank", counted="once")
    ranked = ranked.filter(F.col("rank") <= drawn).select(F.col("row").alias(of), F.col("rank").alias(place))
    joined = weighed.join(ranked, F.col(row) == F.col(of), "left")
    found = with_results(joined, {
        "n_words": F.col(f"{made}.n_words"), "n_features": F.col(f"{made}.n_features"),
        "weight": F.col(f"{made}.weight"), "score": F.col(score), "rank": F.col(place),
    })
    return found.drop(*({made, row, score, of, place} - {"score"}))
