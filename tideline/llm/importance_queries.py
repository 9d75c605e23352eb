"""Query of the importance resampling, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import table
from tideline.llm.importance import resample


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _features(name: str, rows: str) -> str:
    """name: a row for each feature of rows (text), by the row's number."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
{name}_words AS MATERIALIZED (SELECT *, {words} AS w FROM (SELECT *, row_number() OVER () AS row_ FROM {rows})),
{name} AS MATERIALIZED (
  SELECT row_, unnest(w) AS f FROM {name}_words
  UNION ALL SELECT row_, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words)"""


#: CRC-32: the table of what a byte does to the register, then byte after byte of every distinct feature.
IMPORTANCE_SQL = f"""
WITH RECURSIVE {_features("ours", "documents")},{_features("theirs", "benchmark")},
bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
bytes_ AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM ours UNION SELECT f FROM theirs)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM names, bytes_),
s AS (SELECT bucket, count(*) AS n FROM ours JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM theirs JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weighed AS (
  SELECT d.row_, d.doc_id, len(d.w) AS n_words, count(o.f) AS n_features, CAST(coalesce(floor(sum(g.gain)::DOUBLE / count(o.f)), 0) AS BIGINT) AS weight
  FROM ours_words d LEFT JOIN ours o USING (row_) LEFT JOIN hashed USING (f) LEFT JOIN gain g USING (bucket) GROUP BY ALL),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM weighed),
ranked AS (SELECT row_, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row_)"""


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLES = {"op13_importance_resampling": IMPORTANCE_SQL}
