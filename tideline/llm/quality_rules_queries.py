"""Query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import table
from tideline.llm.quality_rules import BEYOND, COUNTS, ERRORS, FIRST, SECOND, SIGNALS, SPREAD, TAIL, judged


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"), ["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept")


def quality_sql(docs: str = "documents") -> str:
    """A query whose last WITH entry is verdicts: all columns of docs, the counts, base_failed and kept."""
    on = lambda x, y: f"{x}.lang IS NOT DISTINCT FROM {y}.lang AND {x}.source IS NOT DISTINCT FROM {y}.source"

    def quantiles(name: str, rows: str, names: tuple[str, ...], low: float, high: float) -> str:
        prior = f"{BEYOND / (1 - high)!r}::DOUBLE"
        beside = lambda n, own, parent: f"({n} * {own} + {prior} * {parent}) / ({n} + {prior})"
        parts = ", ".join(f"quantile_disc({s}, [{low}, {high}]) AS {s}" for s in names)
        pick = ", ".join(f"{beside('f.n', f'f.{s}[{i}]', '(' + beside('l.n', f'l.{s}[{i}]', f'w.{s}[{i}]') + ')')} AS {s}_{end}" for s in names for i, end in ((1, "low"), (2, "high")))
        return f"""{name}_fine AS (SELECT lang, source, count(*) AS n, {parts} FROM {rows} GROUP BY lang, source),
{name}_lang AS (SELECT lang, count(*) AS n, {parts} FROM {rows} GROUP BY lang),
{name}_whole AS (SELECT {parts} FROM {rows}),
{name} AS (SELECT f.lang, f.source, {pick} FROM {name}_fine f LEFT JOIN {name}_lang l ON f.lang IS NOT DISTINCT FROM l.lang CROSS JOIN {name}_whole w)"""

    def inside(names: tuple[str, ...]) -> str:
        tests = []
        for s in names:
            count, total, share = SIGNALS[s]
            spread = f"r.{count} * (1::DOUBLE - r.{s})" if share else f"r.{count}::DOUBLE"
            error = f"{ERRORS[s]}::DOUBLE * sqrt({spread}) / nullif(r.{total}, 0)"
            reach = f"{SPREAD}::DOUBLE * ({s}_high - {s}_low)"
            tests.append(f"coalesce({s}_high + {reach} >= r.{s} - {error}, true)")
            if s in FIRST:
                tests.append(f"coalesce({s}_low - {reach} <= r.{s} + {error}, true)")
        return " AND ".join(tests)

    return rf"""
WITH texts AS (
  SELECT *, row_number() OVER () AS row_, coalesce(text, '') AS text_ FROM {docs}),
split_ AS (
  SELECT *, regexp_extract_all(text_, '[^\x20\x09-\x0D]+') AS words_,
         list_filter(string_split(text_, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines_ FROM texts),
windows AS (
  SELECT row_, i, words_[i] || chr(10) || words_[i + 1] || chr(10) || words_[i + 2] AS gram
  FROM (SELECT row_, words_, unnest(range(1, len(words_) - 1)) AS i FROM split_ WHERE len(words_) > 2)),
marked AS (SELECT row_, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_, gram) > 1),
repeats AS (SELECT row_, count(DISTINCT at_) AS n FROM (SELECT row_, unnest([i, i + 1, i + 2]) AS at_ FROM marked) GROUP BY row_),
counted AS (
  SELECT s.* EXCLUDE (words_, lines_), CAST(len(words_) AS BIGINT) AS n_words, CAST(length(array_to_string(words_, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text_, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines_) - len(list_distinct(lines_)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines_) AS n_lines_
  FROM split_ s LEFT JOIN repeats r USING (row_)),
ratios AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols::DOUBLE / nullif(n_words, 0) AS symbol_ratio,
         n_dup_lines::DOUBLE / nullif(n_lines_, 0) AS dup_line_ratio, n_repeat_words::DOUBLE / nullif(n_words, 0) AS repeat_ratio,
         word_chars::DOUBLE / nullif(n_words, 0) AS word_length FROM counted),
passed AS (
  SELECT lang, source, text_, any_value(n_words) AS n_words, any_value(n_lines_) AS n_lines_, {", ".join(f"any_value({x}) AS {x}" for x in dict.fromkeys([c for c, _, _ in SIGNALS.values()] + list(SIGNALS)))}
  FROM ratios WHERE NOT base_failed GROUP BY lang, source, text_),
{quantiles("first_", "passed", FIRST, 0.25, 0.75)},
core AS (SELECT r.* FROM passed r LEFT JOIN first_ p ON {on("r", "p")} WHERE {inside(FIRST)}),
{quantiles("second_", "core", SECOND, 0.5, TAIL)},
verdicts AS (
  SELECT r.* EXCLUDE (text_), NOT r.base_failed AND {inside(FIRST + SECOND)} AS kept
  FROM ratios r LEFT JOIN first_ p ON {on("r", "p")} LEFT JOIN second_ q ON {on("r", "q")})"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": quality_sql() + f"\nSELECT doc_id, {', '.join(COUNTS)}, base_failed, kept FROM verdicts"}
