"""Query of the secret scan. SQL has no offsets of matches; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import table
from tideline.llm.secret_scan import scan


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES: dict[str, str] = {}
