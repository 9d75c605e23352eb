"""Query of the HTML extraction. SQL cannot parse HTML; tests hold it against pages of known text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import table
from tideline.llm.html_extract import extract


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLES: dict[str, str] = {}
