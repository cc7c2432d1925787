"""Quality rules, line first, in DataFrame functions only.

Method: each line with a word is tried by three rules: punctuation (marks crowd out the text), navigation (bars or
arrows part short labels) and boilerplate (stock phrases of sites and licences). Failing lines are removed. A document
goes if the lines lost hold too large a part of its characters, or if it fails the base rules: too few words, or too
many words inside 3-word windows that occur twice or more.

All of it works on one row at a time: arrays of the row's words and lines, no shuffle. Windows are compared by their
64-bit XXH64 (within one text, a chance meeting of two different windows is below 1 in 10^10).

Defined results: null text counts as no words (and is rejected: too few words); repeated rows are judged
each; a null doc_id is kept; extra columns are kept, those named like added ones are replaced; ties do not occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>{}!^~="
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|accept (all )?cookies|uses cookies|enable javascript"
    r"|click here|sign up|log in|subscribe (now|to)|lorem ipsum|copyright \(c\)|licensed under)"
)
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept", "cleaned_text"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: the finish of a fold over nothing that starts with value. Nothing is copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def words_of(text: Column) -> Column:
    return let(F.trim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def repeat_words(words: Column) -> Column:
    """How many of words lie in a 3-word window that occurs twice or more."""

    def covered(hashes: Column) -> Column:
        def twice(rows: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(rows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False))
            return F.size(F.array_distinct(F.flatten(F.transform(F.filter(rows, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(rows, twice))

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, covered)).cast("long")


def bad_line(line: Column) -> Column:
    """If the line fails a rule. line: trimmed, with a word."""
    size = F.length(line)
    return (
        ((size - F.length(without(line, MARKS))) * 10 > size)
        | ((size - F.length(without(line, "|»›•"))) >= 3)
        | line.rlike(BOILERPLATE)
    )


def apply_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_lost: float = 0.5) -> DataFrame:
    """docs with the base counts, base_failed, lost_share, kept and cleaned_text (the text without its failing lines)."""
    kept = docs.select(*[c for c in docs.columns if c not in ADDED])
    text = text_or_empty()
    parts = kept.withColumns({"_words": words_of(text), "_lines": F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")})
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    counted = parts.withColumn("_good", F.filter("_lines", lambda x: ~bad_line(F.trim(x, F.lit(WHITE))))).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(without(text, WHITE)).cast("long"),
            "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")),
            "lost_share": F.coalesce(1 - F.try_divide(chars(F.col("_good")), chars(F.col("_lines"))), F.lit(1.0)),
            "cleaned_text": F.array_join("_good", "\n"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost)).drop("_words", "_lines", "_good")
