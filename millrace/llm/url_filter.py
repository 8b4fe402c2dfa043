"""Allowing or blocking URLs by listed hosts and paths: a blocked Bloom filter, then an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, col, unused, whole, with_results

MOST_WORDS = 1 << 20
WORDS_PER_ROW = 1024
BITS_PER_KEY = 12
PROBES = 4
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL.

    The host goes from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    the path from there up to ``?``, ``#`` or the end. Both are '' for NULL or without ``://``.
    """
    host = F.regexp_extract(whole(url), _URL, 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(whole(url), _URL, 2)


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _word(key: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words).cast("long"))


def _mask(key: Column) -> Column:
    """The bits a key sets within its 64-bit word: six bits of a second hash name each."""
    second, mask = F.xxhash64(F.lit("bits"), key), F.lit(0).cast("long")
    for probe in range(PROBES):
        bit = F.shiftrightunsigned(second, 6 * probe).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_filter(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of the keys as rows of ``WORDS_PER_ROW`` 64-bit words, and its words.

    Each key sets up to ``PROBES`` bits of one word. The filter has ``BITS_PER_KEY`` bits a key and
    never more than ``MOST_WORDS`` words, 8 MB, so it may always be broadcast; a list beyond that
    only lets more false positives through to the exact join.
    """
    count = listed.count()
    n_words = 1
    while n_words < MOST_WORDS and n_words * 64 < count * BITS_PER_KEY:
        n_words *= 2
    masks = listed.groupBy(_word(F.col(key), n_words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))
    in_row = F.struct((F.col("word") % WORDS_PER_ROW).alias("at"), F.col("bits").alias("bits"))
    rows = masks.groupBy(F.floor(F.col("word") / WORDS_PER_ROW).alias("row")).agg(
        F.map_from_entries(F.collect_list(in_row)).alias("filled")
    )
    dense = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(min(n_words, WORDS_PER_ROW) - 1).cast("long")),
        lambda at: F.coalesce(F.element_at("filled", at), F.lit(0).cast("long")),
    )
    return rows.select("row", dense.alias("words")), n_words


def passing(keys: DataFrame, key: str, bloom: DataFrame, n_words: int) -> DataFrame:
    """The rows whose key may be listed; every row whose key is listed is among them."""
    word, row, held, at = unused(keys.columns, "word", "row", "held", "at")
    probed = keys.withColumn(word, _word(col(key), n_words))
    probed = probed.withColumns({row: F.floor(col(word) / WORDS_PER_ROW), at: (col(word) % WORDS_PER_ROW).cast("int")})
    joined = probed.join(F.broadcast(bloom.toDF(row, held)), row)
    mask = _mask(col(key))
    return joined.filter(F.get(col(held), col(at)).bitwiseAND(mask) == mask).select(*(col(c) for c in keys.columns))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Pages with ``host``, ``path``, ``rule`` (host and path of the rule, or NULL) and ``verdict``.

    ``rules`` has text columns host, path and verdict. A rule fits its host and all subdomains if
    the URL's path starts with the rule's. The longest rule wins, then the one with the longer host,
    then, of equal rules, the one whose verdict comes last in order (block over allow). URLs without
    a rule get ``default``.

    Each distinct host and path is expanded to the keys that a rule could have, one for each
    combination of label count and path length in the list. A blocked Bloom filter of the listed
    keys drops nearly all of them; what passes is joined with the list exactly, so false positives
    fall away. Only passing keys are shuffled for that; pages meet the result by host and path.

    NULL, '' and URLs without ``://`` have an empty host and path and fit no rule. Rules with a
    NULL or empty host are left out, a NULL path is ''. Repeated pages stay repeated; columns named
    like a result give way. An empty list gives every page the default.
    """
    host, path = canonical(col(url))
    judged = with_results(pages, {"host": host, "path": path, "rule": F.lit(None).cast("string")}).drop("rule")
    listed = rules.select(
        F.translate(whole(F.col("host")), UPPER, LOWER).alias("rule_host"),
        whole(F.col("path")).alias("rule_path"), "verdict",
    ).filter(F.col("rule_host") != "")
    listed = listed.groupBy(F.concat("rule_host", "rule_path").alias("key")).agg(
        F.max("verdict").alias("verdict"), F.first("rule_host").alias("rule_host"), F.first("rule_path").alias("rule_path")
    )
    shapes = listed.select(
        _labels(F.col("rule_host")).alias("labels"), F.char_length("rule_path").alias("length")
    ).distinct().collect()  # label counts by path lengths: as many as hosts have labels, times path lengths
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    bloom, n_words = bloom_filter(listed, "key")
    urls = judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("host") != "")
    possible = F.array(*(F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["length"]).alias("length")) for s in shapes))
    fitting = F.filter(
        possible,
        lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["length"] <= F.char_length("path")),
    )
    candidates = urls.select("host", "path", F.explode(fitting).alias("s")).select(
        "host", "path",
        F.concat(
            F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("s.labels")),
            F.call_function("left", F.col("path"), F.col("s.length")),
        ).alias("key"),
    )
    hits = passing(candidates, "key", bloom, n_words).join(listed, "key")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(
            F.char_length("key").alias("length"), F.char_length("rule_host").alias("host_length"), "key", "verdict"
        )).alias("best")
    ).select("host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("rule_verdict"))
    order = [c for c in judged.columns if c.lower() not in ("host", "path", "verdict")]
    return judged.drop("verdict").join(best, ["host", "path"], "left").select(
        *(col(c) for c in order), "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")
    )
