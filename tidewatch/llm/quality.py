"""Quality rules, line first: drop bad lines, then documents that lost too much.

Every rule is a built-in expression over one row: one scan, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE, fresh, has_word, let

BOILERPLATE = (
    "cookie", "javascript", "terms of use", "terms of service", "privacy policy", "all rights reserved", "lorem ipsum",
    "sign up", "log in", "subscribe to", "read more", "click here", "share this", "skip to content",
)


ENDS = ".!?:;\"')]…»”"
MARKS = r"!#*$%&<>|»›·"
SEPARATORS = "|»›·"


@dataclass(frozen=True)
class LineRules:
    """Punctuation: a line ends in one of ``ENDS`` or is prose of ``prose_chars`` or more with a sentence end inside,
    and has at most ``max_marks`` of ``MARKS`` a word. Navigation: no ``min_separators`` or more of ``SEPARATORS`` with at
    least one for ``words_per_separator`` words. Boilerplate: of ``phrases`` fewer than one for ``words_per_phrase`` words, so a
    long line may mention them; None: not one. ``max_lost``: share of the characters in lines that a document
    may lose."""

    prose_chars: int = 80
    max_marks: float = 0.5
    min_separators: int = 3
    words_per_separator: int = 6
    phrases: tuple[str, ...] = BOILERPLATE
    words_per_phrase: int | None = 20
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost: float = 0.3


def _only(text: Column, characters: str) -> Column:
    """``text`` without all but these characters."""
    return F.regexp_replace(text, f"[^{characters}]+", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hash: sorted with their positions, equal ones are neighbours.
    """
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, j: (
            F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        places = let(F.sort_array(pairs), lambda o: F.sort_array(F.transform(twice(o), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places, covered))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows(words), count))


def line_passes(line: Column, rules: LineRules) -> Column:
    """The punctuation, navigation and boilerplate rules for one line; a line without a word passes."""
    n_words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1

    def marks_pass(marks: Column) -> Column:
        separators = F.length(_only(marks, SEPARATORS))
        menu = (separators >= rules.min_separators) & (separators * rules.words_per_separator >= n_words)
        return (marks == "") | ((F.length(marks) <= n_words * F.lit(rules.max_marks)) & ~menu)

    last = F.substring(F.rtrim(line, F.lit(" \t\r\x0b\x0c")), -1, 1)
    ended = (F.instr(F.lit(ENDS), last) > 0) | ((F.length(line) >= rules.prose_chars) & F.contains(line, F.lit(". ")))
    phrase = r"\b(?:" + "|".join(rules.phrases) + ")"
    boiler = F.lower(line).rlike(phrase)
    if rules.words_per_phrase is not None:
        boiler = boiler & (F.regexp_count(F.lower(line), F.lit(phrase)) * rules.words_per_phrase >= n_words)
    return ~has_word(line) | (ended & let(_only(line, MARKS), marks_pass) & ~boiler)


def verdict(text: Column, rules: LineRules) -> Column:
    """All figures of a document as one struct, the cleaned text included."""
    def line_figures(lines: Column) -> Column:
        worded = F.filter(lines, has_word)
        return F.struct(
            (F.size(worded) - F.size(F.array_distinct(worded))).alias("n_dup_lines"),
            F.filter(lines, lambda line: line_passes(line, rules)).alias("good"),
            F.aggregate(lines, F.lit(0), lambda a, line: a + F.length(line)).alias("line_chars"),
            F.size(lines).alias("n_lines"))

    def figures(t: Column) -> Column:
        return F.struct(
            let(_words(t), lambda w: F.struct(
                F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"))).alias("w"),
            F.length(_only(t, "#*$%&|<>")).alias("n_symbols"),
            let(F.split(t, "\n"), line_figures).alias("l"))

    def judged(f: Column) -> Column:
        failed = (f["w"]["n_words"] < rules.min_words) | (
            100 * f["w"]["n_repeat_words"] > rules.max_repeat_percent * f["w"]["n_words"])
        kept_chars = F.aggregate(f["l"]["good"], F.lit(0), lambda a, line: a + F.length(line))
        lost = (f["l"]["line_chars"] - kept_chars) > f["l"]["line_chars"] * F.lit(rules.max_lost)
        return F.struct(
            f["w"]["n_words"].cast("long").alias("n_words"), f["w"]["word_chars"].cast("long").alias("word_chars"),
            f["n_symbols"].cast("long").alias("n_symbols"), f["l"]["n_dup_lines"].cast("long").alias("n_dup_lines"),
            f["w"]["n_repeat_words"].cast("long").alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & ~lost).alias("kept"),
            (f["l"]["n_lines"] - F.size(f["l"]["good"])).cast("long").alias("n_bad_lines"),
            F.array_join(f["l"]["good"], "\n").alias("text"))

    return let(let(F.coalesce(text, F.lit("")), figures), judged)


def judge(docs: DataFrame, rules: LineRules = LineRules(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``kept``, ``n_bad_lines`` and the ``clean_text``.

    A null or empty text has no words and fails. Rows with equal ids are judged each on its own; extra columns are
    not looked at. Texts of any length are judged whole.
    """
    got = docs.select(F.col(id_column).alias("doc_id"), verdict(F.col(text), rules).alias("v"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines")
    return got.select("doc_id", *[F.col(f"v.{n}").alias(n) for n in names], F.col("v.text").alias("clean_text"))


def clean(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with bad lines taken out; all columns stay, ``n_chars`` follows the text."""
    (mark,) = fresh(docs, "_verdict")
    # a filter on the verdict would be pushed below it and work it out a second time; an empty array drops the row as well
    kept = F.filter(F.array(verdict(F.col(text), rules)), lambda v: v["kept"])
    rows = docs.select("*", F.explode(kept).alias(mark))
    changed = {text: F.col(mark)["text"]}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(F.col(mark)["text"]).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(changed).select(*docs.columns)
