"""Query of the benchmark decontamination, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import table
from tideline.llm.decontaminate import contamination


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contamination_sql(docs: str = "documents") -> str:
    """A query whose last WITH entry is found: row_, doc_id, n_words, n_hit, items (sorted) of every row of docs."""
    words = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH doc_words AS (SELECT *, row_number() OVER () AS row_, {words("text")} AS w FROM {docs}),
item_words AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words("text")} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_windows AS (
  SELECT row_, i, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS win
  FROM (SELECT row_, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, (SELECT DISTINCT width FROM item_windows) WHERE len(w) >= width)),
hits AS (SELECT d.row_, d.i, d.width, m.item FROM doc_windows d JOIN item_windows m USING (win, width)),
places AS (SELECT row_, count(DISTINCT at_) AS n_hit FROM (SELECT row_, unnest(range(i, i + width)) AS at_ FROM hits) GROUP BY row_),
named AS (SELECT row_, list_sort(list_distinct(list(item))) AS items FROM hits GROUP BY row_),
found AS (
  SELECT d.row_, d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, coalesce(n.items, []) AS items
  FROM doc_words d LEFT JOIN places p USING (row_) LEFT JOIN named n USING (row_))"""


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES = {
    "op4_decontamination": contamination_sql()
    + "\nSELECT doc_id, n_words, n_hit, CAST(len(items) AS BIGINT) AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AS contaminated FROM found"
}
