"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``measures`` gives the counts and ratios of a text as columns, ``verdict`` compiles a rule table over them
into one boolean, and ``judge`` returns both for every row of a table.

Defined results: a null or empty text has no words, zero counts and ratios, and fails the base rule. Rows
are judged one by one, so repeated rows get equal verdicts; other columns of the input are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from or an not at which a",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur avec ce elle",
    "es": "de la que el en y a los del se las por un para con una su al lo como más o",
}


@dataclass(frozen=True)
class Rule:
    """Bounds of one measure; a text outside of them fails."""

    measure: str
    low: float | None = None
    high: float | None = None


# Production thresholds. They were set so that texts labelled good in the corpus pass.
RULES = (
    Rule("n_words", low=20, high=1_000_000),
    Rule("mean_word_chars", low=2.0, high=16.0),
    Rule("symbol_word_ratio", high=0.25),
    Rule("bang_word_ratio", high=0.5),
    Rule("upper_letter_ratio", high=0.7),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.6),
    Rule("repeat_word_ratio", high=0.3),
)
# The filter of a pipeline rejects no text by its length alone: ratios judge long ones.
FILTER_RULES = (Rule("n_words", low=20), *RULES[1:])


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words inside windows that occur at least twice, from the word hashes of one text.

    Windows are compared by a 64-bit hash of their eight word hashes. Only texts with a repeated window
    sort them: the sorted (hash, place) pairs give the places of repeats, and each repeat covers the words
    up to the next one, eight at most.
    """
    def window(i):
        return F.xxhash64(*[F.get(hashes, i + F.lit(j)) for j in range(WINDOW)])

    places = F.sequence(F.lit(0), n - WINDOW)
    windows = F.transform(places, window)

    def covered(found):
        return _let(F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_pairs)

    def of_pairs(pairs):
        last = F.size(pairs) - 1

        def repeated(pair, k):
            before = (k > 0) & (F.get(pairs, k - 1)["h"] == pair["h"])
            after = (k < last) & (F.get(pairs, k + 1)["h"] == pair["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return _let(F.array_sort(F.transform(F.filter(pairs, repeated), lambda p: p["i"])), summed)

    def summed(spots):
        end = F.size(spots) - 1
        steps = F.transform(
            spots, lambda s, k: F.when(k < end, F.least(F.get(spots, k + 1) - s, F.lit(WINDOW))).otherwise(F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def counted(found):
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))

    return F.when(n < WINDOW, F.lit(0)).otherwise(_let(windows, counted))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``: a one-element array bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _measure_struct(text: Column) -> Column:
    """All counts of a text as an array of one struct; exploding it keeps each array computed once per row."""
    return F.transform(F.array(F.coalesce(text, F.lit(""))), _measure_text)


def _measure_text(text: Column) -> Column:

    def of_words(w):
        n = F.size(w)
        stops = sorted({s for line in STOP_WORDS.values() for s in line.split()})
        bare = F.transform(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.size(F.filter(bare, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_symbol_words"),
            F.size(F.filter(w, lambda x: x.contains("!!"))).cast("long").alias("n_bang_words"),
            _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _repeat_words(h, n)).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines):
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.struct(
        _let(words(text), of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(text, BLANK + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        letters.cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def measures(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df`` and every measure a rule can name, one row per input row."""
    m = df.select(*[F.col(f"`{c}`") for c in keep], F.explode(_measure_struct(F.col(text))).alias("__m"))
    base = m.select(
        *[F.col(f"`{c}`") for c in keep],
        "__m.w.*",
        "__m.l.*",
        "__m.word_chars",
        "__m.n_symbols",
        "__m.n_letters",
        "__m.n_upper",
    )
    n = F.col("n_words")
    return base.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), n),
            "symbol_word_ratio": _ratio(F.col("n_symbol_words"), n),
            "bang_word_ratio": _ratio(F.col("n_bang_words"), n),
            "upper_letter_ratio": _ratio(F.col("n_upper"), F.col("n_letters")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), n),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_word_ratio": _ratio(F.col("n_repeat_words"), n),
        }
    )


def verdict(rules=RULES) -> Column:
    """The rule table as one boolean expression over the measures."""
    passed = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            passed = passed & (F.col(rule.measure) >= F.lit(rule.low))
        if rule.high is not None:
            passed = passed & (F.col(rule.measure) <= F.lit(rule.high))
    return passed


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(df: DataFrame, keep: list[str], text: str = "text", rules=RULES) -> DataFrame:
    """``keep``, the measures, ``base_failed`` and ``kept``: false if the base rule or a rule of the table fails."""
    out = measures(df, keep, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def passing(df: DataFrame, text: str = "text", rules=FILTER_RULES) -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    judged = judge(df.select(row, F.col(text).alias("__text")), ["__row"], "__text", rules)
    return judged.filter("kept").select("__row.*")
