"""Query of the SimHash near-duplicates. Components of fingerprints are beyond a quick SQL; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import table
from tideline.llm.simhash import near_duplicates


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
