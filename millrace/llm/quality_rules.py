"""Quality rules as a short-circuit cascade: rules that reject most per second come first."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col, lines, stripped, stored, unused, whole, with_results, words

SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS, RUNS = 2000, 3
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the metrics it ``needs``; NULL counts as passing."""

    name: str
    needs: tuple[str, ...]
    fails: str


@dataclass(frozen=True)
class Measured:
    """A rule with its seconds and share of rejected documents over the sample."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


BASE = (
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)


def with_metrics(docs: DataFrame, text: str, needs: set[str]) -> DataFrame:
    """The table with the metrics ``needs`` as long columns, each from the whole text.

    n_words; word_chars: code points in words; n_symbols: characters of ``[#*$%&|<>]``; n_lines: lines
    with a word; n_dup_lines: of these, lines equal to an earlier one; n_repeat_words: words that
    lie in a three-word window found twice or more in the text, its first place included. Windows
    are compared by 64-bit hash within one text. All are 0 for NULL and ''.
    """
    w, with_word, grams, ordered = unused(docs.columns, "w", "with_word", "grams", "ordered")
    source, out = whole(col(text)), {}
    df = docs
    if needs & {"n_words", "word_chars", "n_repeat_words"}:
        df = df.withColumn(w, words(source))
        out["n_words"] = F.size(col(w))
        out["word_chars"] = F.char_length(F.array_join(col(w), ""))
    out["n_symbols"] = F.regexp_count(source, F.lit(SYMBOLS))
    if needs & {"n_lines", "n_dup_lines"}:
        df = df.withColumn(with_word, F.filter(lines(source), lambda line: stripped(line) != ""))
        out["n_lines"] = F.size(col(with_word))
        out["n_dup_lines"] = F.size(col(with_word)) - F.size(F.array_distinct(col(with_word)))
    if "n_repeat_words" in needs:
        starts = F.slice(col(w), 1, F.greatest(F.size(col(w)) - (WINDOW - 1), F.lit(0)))
        df = df.withColumn(grams, F.transform(
            starts, lambda first, i: F.xxhash64(first, *(F.get(col(w), i + k) for k in range(1, WINDOW)))
        ))
        # equal windows stand side by side once sorted with their places; most short texts have none
        repeats = F.size(F.array_distinct(col(grams))) < F.size(col(grams))
        placed = F.array_sort(F.transform(col(grams), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        df = df.withColumn(ordered, F.when(repeats, placed))
        twice = F.filter(col(ordered), lambda x, k: (
            F.coalesce(F.get(col(ordered), k - 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get(col(ordered), k + 1)["g"] == x["g"], F.lit(False))
        ))
        covered = F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + (WINDOW - 1))))
        out["n_repeat_words"] = F.coalesce(F.size(F.array_distinct(covered)), F.lit(0))
    chosen = {name: out[name].cast("long") for name in out if name in needs}
    return with_results(df, chosen).drop(w, with_word, grams, ordered)


def measured(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of about ``sample_rows`` documents, drawn from all of them.

    A rule's cost is its least time of ``RUNS``, less that of a job over the same rows that does nothing. The
    sample sets the order of the rules and nothing else: verdicts don't depend on it.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = stored(docs.select(col(text).alias("text")).sample(False, share, 11))

    def timed(judged: DataFrame) -> tuple[float, int, int]:
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            row = judged.agg(F.count(F.lit(1)), F.count_if("fails")).first()
            runs.append(time.perf_counter() - started)
        return min(runs), row[0], row[1]

    nothing, total, _ = timed(sample.select((F.octet_length("text") < 0).alias("fails")))
    found = []
    for rule in rules:
        seconds, _, rejected = timed(with_metrics(sample, "text", set(rule.needs)).select(F.expr(rule.fails).alias("fails")))
        found.append(Measured(rule, max(seconds - nothing, 1e-3), rejected / max(total, 1)))
    return found


def ordered_rules(found: Sequence[Measured]) -> list[Rule]:
    """Most rejected per second first; ties by name."""
    return [m.rule for m in sorted(found, key=lambda m: (-m.rank, m.rule.name))]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that fails, or NULL; later rules are not evaluated then."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(F.expr(rule.fails), F.lit(rule.name)).otherwise(first)
    return first


def judge_quality(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep_metrics: bool = False,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Documents with ``kept``: no rule fails; the cascade runs in the order a sample gives.

    ``kept`` is the same for every order. With ``keep_metrics`` all metrics are added too; without,
    a metric that only a later rule needs is computed for documents that earlier rules let pass.
    NULL and '' have no words and fail ``few_words``. Repeated rows are judged alike, input columns
    named like a result give way, an empty table stays empty. Nothing is shuffled.
    """
    order = ordered_rules(measured(docs, rules, text, sample_rows))
    needs = {name for rule in rules for name in rule.needs}
    if keep_metrics:
        judged = with_metrics(docs, text, needs)
        return with_results(judged, {"kept": cascade(order).isNull()})
    (left,) = unused([*docs.columns, *needs], "left_text")
    known: set[str] = set()
    state = unused([*docs.columns, *needs, left], "failed")[0]
    judged = docs.withColumns({state: F.lit(False), left: col(text)})
    held = [c for c in docs.columns if c.lower() not in needs]
    for rule in order:
        # a document that failed goes on as an empty text, which costs nothing
        judged = with_metrics(judged.withColumn(left, F.when(~col(state), col(left))), left, set(rule.needs) - known)
        known |= set(rule.needs)
        judged = judged.withColumn(state, col(state) | F.coalesce(F.expr(rule.fails), F.lit(False)))
    return with_results(judged.select(*(col(c) for c in held), col(state)), {"kept": ~col(state)}).drop(state)
