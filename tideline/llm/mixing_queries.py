"""Query of the mixing operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import table
from tideline.llm.mixing import mix


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(docs: str = "documents") -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS u_key
  FROM {docs}),
drawn AS (
  SELECT *, (CAST(('0x' || substr(u_key, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
         CASE WHEN size > 0 THEN length(ltrim(bin(size), '0')) ELSE 0 END AS b FROM sized),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight
  FROM drawn GROUP BY source),
breaks AS (
  SELECT *, sum(2.0::DOUBLE * source_size) OVER o AS held, sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS free,
         lead(2.0::DOUBLE * source_size / weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS next
  FROM totals WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT (1.5::DOUBLE * sum(source_size) - 0) / sum(weight) AS level, min(2.0::DOUBLE * source_size / weight) AS next FROM totals
  UNION ALL SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - held) / free, next FROM breaks WHERE free > 0),
level AS (SELECT coalesce(max(level) FILTER (level <= next), 0) AS level FROM levels),
goals AS (
  SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target FROM totals, level),
parts AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM goals),
rests AS (SELECT *, target - whole * source_size AS rest FROM parts),
classes AS (
  SELECT source, b, sum(size) AS words FROM drawn WHERE b > 0 GROUP BY source, b),
solved AS (
  SELECT c.source, c.b, (r.rest - (r.source_size - sum(c.words) OVER w)) / (sum(c.b * c.words) OVER w)::DOUBLE AS c
  FROM classes c JOIN rests r ON c.source IS NOT DISTINCT FROM r.source
  WINDOW w AS (PARTITION BY c.source ORDER BY c.b ROWS UNBOUNDED PRECEDING)),
plan AS (
  SELECT r.*, coalesce(s.c, 0) AS c FROM rests r
  LEFT JOIN (SELECT source, max_by(c, b) AS c FROM solved WHERE c * b <= 1 GROUP BY source) s ON r.source IS NOT DISTINCT FROM s.source),
chances AS (
  SELECT d.doc_id, d.source, d.size, d.u, d.u_key, p.source_size, p.target, p.whole, p.rest, least(p.c * d.b, 1.0::DOUBLE) AS p
  FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
ranks AS (
  SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM chances),
sums AS (
  SELECT *, sum(size) OVER (PARTITION BY source, q, u_key) AS unit,
         sum(size) OVER (PARTITION BY source ORDER BY q, u_key RANGE UNBOUNDED PRECEDING) AS upto
  FROM ranks WHERE q IS NOT NULL AND rest > 0)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.whole + CASE WHEN r.q IS NOT NULL AND r.rest > 0 AND EXISTS (
         SELECT 1 FROM sums s WHERE s.source IS NOT DISTINCT FROM r.source AND s.u_key = r.u_key AND s.q = r.q
           AND s.upto - s.unit + s.unit / 2.0::DOUBLE <= s.rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranks r"""


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": mixing_sql()}
