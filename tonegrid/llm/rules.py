"""Quality rules: a table of thresholds compiled into projections of built-in functions, without user functions.

A rule compares two counts of a text: it breaks where 100 * count is under ``least`` or over ``most`` times the other
count. Everything is integer arithmetic within the row; no text leaves its row, so there is no exchange.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Broken where 100 * count < least * of, or 100 * count > most * of; texts of fewer words than from_words pass."""

    name: str
    count: str
    of: str
    least: int | None = None
    most: int | None = None
    from_words: int = 0


#: The thresholds of the method, in hundredths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("letters", "n_letter_words", "n_words", least=50),
    Rule("capitals", "n_capitals", "word_chars", most=30),
    Rule("stop_words", "n_stop_words", "n_latin_words", least=2, from_words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=30),
)

#: Frequent words of languages in Latin script.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "have", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "au", "ce", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu", "zum",
    "con", "del", "el", "ella", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)

#: A text needs so many words, and at most so many of a hundred in windows that repeat.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

_SPACES = "\t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"
_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _repeated_words(frame: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words in windows of five that are found twice or more in the text.

    As many distinct hashes of windows as places tell the texts where none repeats; in the others the windows themselves
    are sorted with their places, and the places of equal neighbours are covered.
    """
    word = lambda i, k: F.get("words", i + k)
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    frame = frame.withColumn("hashes", F.transform(starts, lambda x, i: F.xxhash64(x, *(word(i, k) for k in range(1, WINDOW)))))
    window = lambda i: F.concat_ws(" ", *(word(i, k) for k in range(WINDOW)))
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(window(i).alias("window"), i.alias("at"))))
    frame = frame.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed))
    same = lambda x, i: F.coalesce(F.get("windows", i)["window"] == x["window"], F.lit(False))
    again = F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1))
    frame = frame.withColumn("again", F.sort_array(F.transform(again, lambda x: x["at"])))
    new = F.transform("again", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("again", i + 1) - x, F.lit(WINDOW))))
    return frame.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))).drop("hashes", "windows", "again")


def _broken(rule: Rule) -> Column:
    count, of = 100 * F.col(rule.count), F.col(rule.of)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (count < rule.least * of)
    if rule.most is not None:
        out = out | (count > rule.most * of)
    return out & (F.col("n_words") >= rule.from_words)


def apply_rules(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text: string) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed, kept (boolean) and failed_rules (array of the names of broken rules, in the table's order).

    Words are runs of other characters than ASCII spaces. base_failed: fewer than 10 words, or more than 20 of 100 words
    in windows of five words that are found twice or more. kept: not base_failed, and no rule is broken. A null, empty or
    blank text has no words and fails. Rows are judged one by one, repeated rows and rows without an id too; an empty
    table gives none. Clashing names: the added columns win.
    """
    own = F.struct(*(F.col(c) for c in keep if c not in _ADDED)) if any(c not in _ADDED for c in keep) else F.struct(F.lit(0).alias("_"))
    rows = docs.select(own.alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split(F.translate("text", _SPACES, " " * len(_SPACES)), " "), "")
    rows = rows.withColumn("words", words).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)))
    rows = _repeated_words(rows)

    size = lambda c: F.size(c).cast("long")
    lines = lambda rx: size(F.filter("lines", lambda x: x.rlike(rx)))
    times = lambda rx: F.regexp_count("text", F.lit(rx)).cast("long")
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    latin = F.octet_length("text") * 2 < F.length("text") * 3  # texts in other scripts have more bytes for a character
    counted = rows.select(
        "own", size("words").alias("n_words"), chars.alias("word_chars"), times(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", size("lines").alias("n_lines"), times("[A-Z]").alias("n_capitals"),
        size(F.filter("words", lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"), F.when(latin, size("words")).otherwise(F.lit(0)).alias("n_latin_words"),
        size(F.filter("words", lambda x: F.lower(x).isin(*stop_words))).alias("n_stop_words"), lines(r"^[\x20\t]*[-*•]").alias("n_bullet_lines"),
        lines(r"(?:\.\.\.|…)[\x20\t\r]*$").alias("n_ellipsis_lines"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(_broken(r), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    judged = counted.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return judged.select(*(F.col("own")[c].alias(c) for c in keep if c not in _ADDED), *_ADDED)
