"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages, as whole lower-case words.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this",
    "der", "die", "das", "und", "ein", "eine", "zu", "den", "von", "mit", "ist", "auf", "für", "im", "nicht",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "est", "pas",
    "el", "los", "las", "y", "se", "del", "por", "una", "con", "no", "su", "para",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least <= measure <= most``; a bound that is None does not apply."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def passes(self, measures: dict[str, Column]) -> Column:
        value, ok = measures[self.measure], F.lit(True)
        if self.least is not None:
            ok = ok & (value >= F.lit(self.least))
        if self.most is not None:
            ok = ok & (value <= F.lit(self.most))
        return ok


#: The table that ``judge`` compiles unless another is given.
RULES = (
    Rule("mean_word_length", "mean_word_length", least=2.0, most=20.0),
    Rule("symbols_per_word", "symbols_per_word", most=0.1),
    Rule("shouting", "shouts_per_word", most=0.3),
    Rule("upper_case", "upper_share", most=0.5),
    Rule("stop_words", "stop_word_share", least=0.05),
    Rule("repeated_lines", "dup_line_share", most=0.5),
    Rule("wordy_words", "letter_word_share", least=0.6),
    Rule("bullets", "bullet_line_share", most=0.9),
    Rule("ellipses", "ellipsis_line_share", most=0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more in the array, first included."""

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def of(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda k, j: F.get(s, k)["g"] == F.get(s, j)["g"]
            again = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda k: let(F.get(s, k)["i"], lambda i: F.array(i, i + 1, i + 2))))))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ordered, of))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, let(windows, covered)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of every length, symbol, stop-word and line count of ``text``; words are ``[^\\x20\\x09-\\x0D]+``."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column, lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(r"[^ \x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(full).cast("long").alias("n_lines"),
            (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_shouts"),
            (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÚ", ""))).cast("long").alias("n_upper"),
            F.size(F.filter(words, lambda w: F.lower(F.translate(w, ".,;:!?", "")).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            F.size(F.filter(full, lambda x: x.rlike(r"^[ \t]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(full, lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")
    return let(words, lambda w: let(F.split(text, "\n"), lambda x: of(w, x)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Every row of ``docs`` with a struct ``quality``: the counts, ``base_failed``, ``failed`` (the names of
    the rules not passed) and ``kept``.

    One projection: no shuffle, no user function, and time linear (repeats: n log n) in a text's length.
    Null and empty texts have no words, fail the base rule and are not kept; repeated rows are judged alike;
    columns of ``docs`` are kept whatever their names, except that one named ``quality`` is replaced; an empty
    table gives an empty result.
    """

    def verdict(m: Column) -> Column:
        count = lambda name: m[name]
        per = lambda a, b: F.when(count(b) > 0, count(a) / count(b)).otherwise(F.lit(0.0))
        values = {
            "mean_word_length": per("word_chars", "n_words"),
            "symbols_per_word": per("n_symbols", "n_words"),
            "shouts_per_word": per("n_shouts", "n_words"),
            "upper_share": per("n_upper", "word_chars"),
            "stop_word_share": per("n_stop_words", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_lines"),
            "letter_word_share": per("n_letter_words", "n_words"),
            "bullet_line_share": per("n_bullet_lines", "n_lines"),
            "ellipsis_line_share": per("n_ellipsis_lines", "n_lines"),
        }
        base = (count("n_words") < min_words) | (100 * count("n_repeat_words") > max_repeat_percent * count("n_words"))
        failed = F.filter(F.array(*[F.when(~r.passes(values), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
        return let(failed, lambda f: F.struct(*[count(n).alias(n) for n in names], base.alias("base_failed"), f.alias("failed"), (~base & (F.size(f) == 0)).alias("kept")))

    return docs.withColumn("quality", let(measures(F.col(text)), verdict))
