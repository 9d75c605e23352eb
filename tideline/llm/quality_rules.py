"""Quality rules with adaptive thresholds, on DataFrame functions alone.

Signals of a text are counted inside its row (no shuffle, no Python). Fixed cutoffs are replaced by fences around
quantiles of each signal by language and source, over the different texts that pass the base rules (a text that a source repeats
counts once): approximate-percentile sketches, built in every task, merged by language and source, by language and over all.

1. The length of words is never zero: its fences are quartile -+ SPREAD * (interquartile range).
2. Symbols, repeated lines and repeated words are zero in most texts, where quartiles say nothing. Their fences come from the texts
   inside the first fences alone, junk being rarer there: TAIL quantile + SPREAD * (TAIL quantile - median).

A signal is out if it is beyond its fence by more than ERRORS standard errors, which its own counts give: one symbol in a short
text is no evidence, one in ten words of a long one is. No signal has a cutoff or a margin of its own. A group's quantiles
stand beside its parent's, which counts as many texts as leave BEYOND beyond the quantile: the fewer a group has, the nearer to its
parent's, without a size at which the rule changes. The fences, a row a language and source, are joined back and filter.

Texts are counted whole, whatever their length. Edge cases: a null text has no words, fails the base rules and is not kept. Null languages and sources are groups
like others. Repeated rows have one verdict. An empty table gives an empty result. Columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import small_or_shuffled, stored

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SPREAD = 3.0
#: Texts beyond a quantile that a parent counts for.
BEYOND = 25
#: The quantile of signals that are zero in most texts.
TAIL = 0.95
#: Sketches keep ranks to 1 / ACCURACY.
ACCURACY = 20_000
#: Signal: what is counted, over what, and if it is a share of that (at most 1).
SIGNALS = {
    "word_length": ("word_chars", "n_words", False),
    "symbol_ratio": ("n_symbols", "n_words", False),
    "dup_line_ratio": ("n_dup_lines", "n_lines_", True),
    "repeat_ratio": ("n_repeat_words", "n_words", True),
}
#: Standard errors that a signal may be beyond its fence. The length of words varies less than the Poisson error taken for it.
ERRORS = {"word_length": 1.0, "symbol_ratio": 3.0, "dup_line_ratio": 3.0, "repeat_ratio": 3.0}
FIRST = ("word_length",)
SECOND = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text has twice or more: windows sorted by hash, equal neighbours
    marked, and the marked positions' windows laid over each other."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def marked(s: Column) -> Column:
        same = lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h)
        return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x.i))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 4, 0).otherwise(bind(bind(F.array_sort(grams), marked), covered))


def signals(docs: DataFrame) -> DataFrame:
    """docs with the counts and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    parts = bind(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeats")))
    doubled = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    own = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "kept")]
    found = docs.select(F.struct(*own).alias("own"), parts.alias("parts"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), doubled.cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines_"))
    counts = {"n_words": F.col("parts.n"), "word_chars": F.col("parts.chars"), "n_repeat_words": F.col("parts.repeats")}
    found = found.select("own", *(counts.get(c, F.col(c)).cast("long").alias(c) for c in COUNTS), "n_lines_")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def ratio(signal: str) -> Column:
    count, total, _ = SIGNALS[signal]
    return F.col(count) / F.when(F.col(total) > 0, F.col(total))


def margin(signal: str) -> Column:
    """ERRORS standard errors of a text's signal: binomial for a share, else Poisson."""
    count, total, share = SIGNALS[signal]
    spread = F.col(count) * (F.lit(1.0) - ratio(signal)) if share else F.col(count).cast("double")
    return F.lit(ERRORS[signal]) * F.sqrt(spread) / F.when(F.col(total) > 0, F.col(total))


def inside(names: tuple[str, ...]) -> Column:
    """If none of the signals is out; a signal that a document lacks (no lines, no words) is not."""
    tests = [F.col(f"{s}_max") >= ratio(s) - margin(s) for s in names] + [F.col(f"{s}_min") <= ratio(s) + margin(s) for s in names if s in FIRST]
    whole = F.lit(True)
    for test in tests:
        whole = whole & F.coalesce(test, F.lit(True))
    return whole


def quantiles(rows: DataFrame, names: tuple[str, ...], low: float, high: float) -> DataFrame:
    """of_lang, of_source and the bottom and top of each signal: its quantiles low and high, beside the parents'."""
    parts = [F.percentile_approx(ratio(s), [low, high], ACCURACY).alias(s) for s in names]
    level = F.grouping_id("key_lang", "key_source").alias("level")
    merged = rows.groupingSets([["key_lang", "key_source"], ["key_lang"], []], "key_lang", "key_source").agg(level, F.count("*").alias("n"), *parts)
    merged = stored(merged, "sketches")
    every = merged.where("level = 3").first()  # one row, or none of an empty table
    prior = BEYOND / (1 - high)
    beside = lambda n, own, parent: (n * own + F.lit(prior) * parent) / (n + F.lit(prior))
    fine, lang = merged.where("level = 0").alias("fine"), merged.where("level = 1").alias("lang")
    both = fine.join(lang, F.col("fine.key_lang").eqNullSafe(F.col("lang.key_lang")), "left")
    out = []
    for s in names:
        for i, end in enumerate(("low", "high")):
            whole = F.lit(every[s][i] if every else None).cast("double")
            out.append(beside(F.col("fine.n"), F.col(f"fine.{s}")[i], beside(F.col("lang.n"), F.col(f"lang.{s}")[i], whole)).alias(f"{s}_{end}"))
    return both.select(F.col("fine.key_lang").alias("of_lang"), F.col("fine.key_source").alias("of_source"), *out)


def _at(rows: DataFrame, limits: DataFrame) -> DataFrame:
    same = F.col("key_lang").eqNullSafe(F.col("of_lang")) & F.col("key_source").eqNullSafe(F.col("of_source"))
    return rows.join(small_or_shuffled(limits), same, "left").drop("of_lang", "of_source")


def fences(rows: DataFrame) -> DataFrame:
    """of_lang, of_source and the signals' fences (_min, _max), over rows (key_lang, key_source, key_text and the counts) that
    passed the base rules."""
    rows = stored(rows.dropDuplicates(["key_lang", "key_source", "key_text"]), "texts")
    reach = lambda s: F.lit(SPREAD) * (F.col(f"{s}_high") - F.col(f"{s}_low"))
    ends = [x for s in FIRST for x in ((F.col(f"{s}_low") - reach(s)).alias(f"{s}_min"), (F.col(f"{s}_high") + reach(s)).alias(f"{s}_max"))]
    first = stored(quantiles(rows, FIRST, 0.25, 0.75).select("of_lang", "of_source", *ends), "first-fences")
    core = _at(rows, first).where(inside(FIRST))
    ends = [(F.col(f"{s}_high") + reach(s)).alias(f"{s}_max") for s in SECOND]
    second = quantiles(core, SECOND, 0.5, TAIL).select(F.col("of_lang").alias("lang_"), F.col("of_source").alias("source_"), *ends)
    same = F.col("of_lang").eqNullSafe(F.col("lang_")) & F.col("of_source").eqNullSafe(F.col("source_"))
    return first.join(second, same, "left").drop("lang_", "source_")


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, the counts, base_failed and kept."""
    found = signals(docs)
    kept = F.struct(*[F.col(f"own.{c}") for c in keep]).alias("own")
    keys = (F.col("own.lang").alias("key_lang"), F.col("own.source").alias("key_source"), F.xxhash64("own.text").alias("key_text"))
    rows = stored(found.select(kept, *keys, *COUNTS, "n_lines_", "base_failed"), "signals")
    limits = stored(fences(rows.where(~F.col("base_failed")).drop("own", "base_failed")), "fences")
    return _at(rows, limits).select("own.*", *COUNTS, "base_failed", (~F.col("base_failed") & inside(FIRST + SECOND)).alias("kept"))
