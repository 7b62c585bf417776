"""Quality rules: a threshold table compiled into one projection of built-in functions.

`measures` gives the per-document counts as columns of one projection, `RULES` the thresholds on their ratios, and
`verdict` turns a table of rules into a single boolean column. Nothing is shuffled and no user function runs.

Results for odd inputs: a null text has no words and fails the base rule like an empty one; ratios of a text without words
are null and break no rule; repeated rows and null ids are judged row by row; other columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the four languages, in natural order.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et il la le les pas pour qui sur un une "
    "con del el ella en es las lo los más mi no para por que se su una y"
).split()

#: rule, ratio of `measures`, comparison that breaks the rule, threshold.
RULES: tuple[tuple[str, str, str, float], ...] = (
    ("short words", "mean_word_chars", "<", 2.0),
    ("long words", "mean_word_chars", ">", 16.0),
    ("symbols", "symbols_per_word", ">", 0.5),
    ("no stop words", "stop_word_share", "<=", 0.0),
    ("repeated lines", "dup_line_share", ">", 0.3),
    ("ellipsis lines", "ellipsis_line_share", ">", 0.3),
    ("bullet lines", "bullet_line_share", ">", 0.9),
)
BREAKS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, though `body` uses it in every step of a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of `window` words (a power of two) that the text has twice or more.

    Windows are compared by 64-bit hashes within one text.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(F.slice(starts, F.lit(1), F.size(starts) - 1), F.slice(starts, F.lit(2), F.size(starts) - 1), lambda a, b: F.least(F.lit(window), b - a))
        return F.aggregate(gaps, F.lit(window), lambda total, gap: total + gap)

    def pairs(h: Column, apart: int) -> Column:
        n = F.size(h) - apart
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))

    def doubled(h: Column, apart: int) -> Column:
        """Hashes of `2 * apart` words from hashes of `apart`, up to the window."""
        return h if apart == window else let(pairs(h, apart), lambda wider: doubled(wider, 2 * apart))

    def twice(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        starts = let(
            ordered,
            lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["at"])),
        )
        return let(starts, covered)

    def found(w: Column) -> Column:
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: doubled(h, 1))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(twice(h)))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(words, found))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract, and the ratios that the rules compare."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def counts(v: Column) -> Column:
        words, lines = v["words"], v["lines"]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            v["n_symbols"].cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(lines).alias("n_lines"),
            F.size(F.array_intersect(words, stops)).alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))).alias("n_ellipsis"),
            F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("n_bullets"),
        )

    whole = F.struct(
        word_array(text).alias("words"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    m = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(whole, counts).alias("m")).select("doc_id", "m.*")
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_stop_words") / words).alias("stop_word_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_ellipsis") / lines).alias("ellipsis_line_share"),
        (F.col("n_bullets") / lines).alias("bullet_line_share"),
    )


def broken(rules=RULES) -> Column:
    """The names of the rules that a row of `measures` breaks."""
    each = [F.when(F.coalesce(BREAKS[op](F.col(ratio), F.lit(bound)), F.lit(False)), F.lit(name)) for name, ratio, op, bound in rules]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Counts, ratios, `base_failed`, `broken_rules` and `kept` for every row of `docs`."""
    judged = measures(docs).withColumns({"base_failed": base_failed(), "broken_rules": broken(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def verdict_sql(rules=RULES) -> str:
    """The same rules as SQL over columns of the same names."""
    return reduce(lambda a, b: f"{a} AND {b}", [f"NOT coalesce({ratio} {op} {bound!r}, false)" for _, ratio, op, bound in rules], "NOT base_failed")
