"""Query of the URL filter. A character model in SQL is too slow on whole tables; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import table
from tideline.llm.url_filter import judge


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES: dict[str, str] = {}
