"""Fill-in-middle: a text is cut in three and its parts change places around marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col, unused, whole, with_results

#: A token: white space with the word after it, or white space at the end. Possessive, so no match is tried twice.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Marks:
    """What stands before the prefix, the suffix and the middle; none may be part of another or hold ``$`` or a backslash."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if any(not m or "$" in m or "\\" in m for m in marks):
            raise ValueError("a mark is empty or holds a character with a meaning in replacements")
        if any(a in b for a in marks for b in marks if a != b):
            raise ValueError("a mark is part of another")
        # the end of one mark that begins another would let a mark arise where two texts meet
        if len(set(marks)) < 3 or any(a[-n:] == b[:n] for a in marks for b in marks for n in range(1, len(a) + (a != b))):
            raise ValueError("a mark must not begin with the end of a mark")

    @property
    def pattern(self) -> str:
        return "|".join(rf"\Q{m}\E" for m in (self.prefix, self.suffix, self.middle))


def _draw(digest: Column, n: int) -> Column:
    """The n-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * n - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Marks = Marks(),
    key: str = "doc_id", text: str = "text", out: str = "fim_text",
) -> DataFrame:
    """The table with ``out``, ``n`` (tokens, long), ``form`` and ``prefix_chars``, ``middle_chars`` (long).

    Four numbers come from the SHA-256 of ``seed:key``, so reruns agree and no row depends on
    another. The cuts lie after the smaller and the larger of two of them modulo n + 1 tokens.
    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of these with the suffix first; the others stay plain, as
    do empty texts and those that hold a mark. The pattern of a row counts out its own
    tokens: ``\\A(unit{a}+)(unit{b-a}+)(.*)\\z``. The groups are possessive, so that Java steps through them
    without recursion whatever the length, and one match makes the output from its three groups.

    All of it is one projection: no shuffle, and a very long text is no more than its row. NULL texts
    count as ''; a NULL key as ''. Plain rows have NULL ``prefix_chars`` and ``middle_chars``. Equal rows give
    equal results, an empty table an empty one; input columns named like a result give way.
    """
    body, draws, n, form, first, last = unused(docs.columns, "body", "draws", "n", "form", "first", "last")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.withColumns({
        body: whole(col(text)), draws: F.array(*(_draw(digest, i) for i in range(1, 5))),
    }).withColumn(n, F.regexp_count(col(body), F.lit(UNIT)).cast("long"))
    h1, h2, h3, h4 = (F.get(col(draws), i) for i in range(4))
    plain = (col(body) == "") | F.regexp_like(col(body), F.lit(marks.pattern)) | (h3 % 100 >= rate)
    rows = rows.withColumns({
        form: F.when(plain, PLAIN).when(h4 % 100 < spm_rate, SPM).otherwise(PSM),
        first: F.least(h1 % (col(n) + 1), h2 % (col(n) + 1)), last: F.greatest(h1 % (col(n) + 1), h2 % (col(n) + 1)),
    })
    pattern = F.concat(
        F.lit(rf"(?s)\A({UNIT}{{"), col(first), F.lit(rf"}}+)({UNIT}{{"), col(last) - col(first), F.lit(r"}+)(.*)\z")
    )
    order = {PSM: f"{marks.prefix}$1{marks.suffix}$3{marks.middle}$2", SPM: f"{marks.suffix}$3{marks.prefix}$1{marks.middle}$2"}
    made = F.when(col(form) == PLAIN, col(body)).otherwise(
        F.regexp_replace(col(body), pattern, F.when(col(form) == SPM, order[SPM]).otherwise(order[PSM]))
    )
    (new,) = unused(rows.columns, "made")
    rows = rows.withColumn(new, made)
    prefix, middle, _ = parts(col(new), col(form), marks)
    return with_results(rows, {
        out: col(new), "n": col(n), "form": col(form), "prefix_chars": F.char_length(prefix).cast("long"),
        "middle_chars": F.char_length(middle).cast("long"),
    }).drop(*({body, draws, n, form, first, last, new} - {"n", "form"}))


def parts(made: Column, form: Column, marks: Marks = Marks()) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output; NULL where it is plain."""
    cut = F.when(form != PLAIN, F.split(made, marks.pattern, -1))
    return F.get(cut, F.when(form == SPM, 2).otherwise(1)), F.get(cut, 3), F.get(cut, F.when(form == SPM, 1).otherwise(2))


def restored(made: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text an output was made from."""
    return F.when(form == PLAIN, made).otherwise(F.concat(*parts(made, form, marks)))
