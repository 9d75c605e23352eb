"""Query of the substring deduplication. All 400-byte strings of a table are beyond SQL; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import table
from tideline.llm.suffix_dedup import deduplicate


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = deduplicate(table(spark, folder, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"), "n_passage_words")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
