"""Query of the ranked search, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import table
from tideline.llm.ranked_search import rank


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank(table(spark, folder, "documents"), table(spark, folder, "benchmark")).withColumn("rank", F.col("rank").cast("int"))


def _terms(rows: str) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT *, {words} AS w FROM {rows}"


SEARCH_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row_, doc_id, w, len(w) AS n FROM ({_terms("documents")})),
stats AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs WHERE n > 0),
postings AS (SELECT row_, term, count(*) AS tf FROM (SELECT row_, unnest(w) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(w) AS term FROM ({_terms("benchmark")})),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM postings, stats WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
lengths AS (SELECT row_, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM docs, stats WHERE n > 0),
scores AS (
  SELECT item_id, row_, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (row_) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50"""


QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": SEARCH_SQL}
