"""Line-first quality rules, as DataFrame expressions only.

Each line is judged alone: noise punctuation, navigation, missing end punctuation of a fragment,
boilerplate phrases.  Failing lines go; a document that loses too much of its text goes with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Phrases that mark a line as page furniture.
BOILERPLATE = (
    "accept cookies|all rights reserved|back to top|click here|cookie policy|enable javascript|follow us|"
    "log in|lorem ipsum|powered by|privacy policy|read more|share this|sign in|sign up|subscribe|"
    "terms of service|terms of use"
)


@dataclass(frozen=True)
class Rules:
    #: Most per cent of a line's characters that may be noise punctuation.
    noise_percent: int = 8
    #: A line with this many separators is navigation.
    separators: int = 3
    #: Lines of fewer words must end in punctuation.
    fragment_words: int = 4
    #: Boilerplate phrases only condemn lines of at most so many words.
    boilerplate_words: int = 30
    #: Most per cent of a document's words that may go with its failing lines.
    lost_percent: int = 30
    min_words: int = 50
    repeat_percent: int = 50


#: Names that this operator uses on the way.
_SCRATCH = ("_q", "_n", "_b", "_k", "_p", "_r", "_f", "_l")


def _words_in(text: Column) -> Column:
    """Number of words, without an array of them."""
    return F.size(F.array_remove(F.split(text, SPACE + "+"), "")).cast("bigint")


def _line_fails(line: Column, r: Rules) -> Column:
    noise = F.length(line) - F.length(F.regexp_replace(line, r"[#*$%&|<>!^~=]", ""))
    navigation = line.rlike(r"(?:[|»›•·][^|»›•·]*){%d}" % r.separators)
    ended = line.rlike(r"[.!?…:;,\"”»)\]'’]" + SPACE + "*$")
    boilerplate = line.rlike("(?i)(?:" + BOILERPLATE + ")")
    return (
        (100 * noise > r.noise_percent * F.length(line))
        | navigation
        | (~ended & (_words_in(line) < r.fragment_words))
        | (boilerplate & (_words_in(line) <= r.boilerplate_words))
    )


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All columns of ``docs`` and a struct ``quality`` with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_lost_words, kept and clean_text (the text without
    its failing lines).

    One row per input row, repeated rows included.  A null text has no words and fails; so does an
    empty one.  Columns named ``quality`` or like the scratch names are replaced.  Repeated words are found on the
    whole text: a 3-word window gets a key whose low bits are its position, keys are sorted, and
    neighbours that agree in the high bits are compared word for word.
    """
    own = [c for c in docs.columns if c not in ("quality", *_SCRATCH)]
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.struct(
            F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
            F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("symbols"),
        ).alias("_q"),
    )
    n = F.size("_q.words")
    bits = F.length(F.bin(n))
    a = a.withColumn("_n", n).withColumn("_b", bits)
    # written in SQL: shifts by a column and lambda variables side by side are plainer there
    key = F.expr(
        "case when _n >= 3 then sort_array(transform(sequence(0, _n - 3), i -> "
        "shiftleft(shiftrightunsigned(xxhash64(get(_q.words, i), get(_q.words, i + 1), get(_q.words, i + 2)), _b), _b) | cast(i as bigint))) "
        "else cast(array() as array<bigint>) end"
    )
    a = a.withColumn("_k", key)
    at = "cast({} & (shiftleft(1L, _b) - 1) as int)"
    same = (
        "(shiftrightunsigned(x, _b) = shiftrightunsigned(get(_k, j {0} 1), _b) and "
        "slice(_q.words, " + at.format("x") + " + 1, 3) = slice(_q.words, " + at.format("get(_k, j {0} 1)") + " + 1, 3))"
    )
    repeated = f"filter(_k, (x, j) -> coalesce({same.format('-')}, false) or coalesce({same.format('+')}, false))"
    a = a.withColumn("_p", F.expr(f"sort_array(transform({repeated}, x -> {at.format('x')}))"))
    a = a.withColumn(
        "_r",
        F.expr("aggregate(transform(_p, (p, j) -> least(3, coalesce(get(_p, j + 1) - p, 3))), 0L, (s, x) -> s + x)"),
    )
    failing = F.filter("_q.lines", lambda x: _line_fails(x, rules))
    a = a.withColumn("_f", failing)
    lost = F.aggregate("_f", F.lit(0).cast("bigint"), lambda s, x: s + _words_in(x))
    a = a.withColumn("_l", lost)
    n_words = F.col("_n").cast("bigint")
    base_failed = (n_words < rules.min_words) | (100 * F.col("_r") > rules.repeat_percent * n_words)
    lines = F.split(text, "\n")
    # always true; a filter on the verdict must not be pushed below, where it would compute every step anew per word
    once = F.monotonically_increasing_id() >= 0
    clean = F.when(F.size("_f") == 0, F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda x: ~F.array_contains("_f", x)), "\n")
    )
    return a.select(
        *[F.col(f"`{c}`") for c in own],
        F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join("_q.words", "")).cast("bigint").alias("word_chars"),
            F.col("_q.symbols").alias("n_symbols"),
            (F.size("_q.lines") - F.size(F.array_distinct("_q.lines"))).cast("bigint").alias("n_dup_lines"),
            F.col("_r").alias("n_repeat_words"),
            base_failed.alias("base_failed"),
            F.col("_l").alias("n_lost_words"),
            F.when(once, ~base_failed & (100 * F.col("_l") <= rules.lost_percent * n_words)).alias("kept"),
            clean.alias("clean_text"),
        ).alias("quality"),
    )
