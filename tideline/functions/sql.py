"""The scores as SQL functions of a session, for those who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tideline.functions import text as T

TAGGED = r"(?imdU)\\[?" + T.quoted(T.TAG.strip("[]")).replace("\\", "\\\\") + r"\\]?\\s*$"
FUNCTIONS = {
    "tag_score(t STRING)": f"CAST(coalesce(t RLIKE '{TAGGED}', false) AS INT) * 1.0D",
    "bullet_score(t STRING, least INT)": r"least(coalesce(regexp_count(t, '(?mdU)^\\s*\\d+[.)\\]]\\s+'), 0), least) / CAST(least AS DOUBLE)",
    "forbidden_score(t STRING)": r"1.0D - CAST(coalesce(t RLIKE '(?iU)\\bhowever\\b', false) AS INT)",
    "counter_score(t STRING, turn BIGINT)": r"CAST(coalesce(try_cast(regexp_extract(t, '(?idU)^\\s*\\[Turn:\\s*(\\d+)\\]', 1) AS BIGINT) = turn, false) AS INT) * 1.0D",
}


def register(spark: SparkSession) -> list[str]:
    """Temporary functions tag_score, bullet_score, forbidden_score and counter_score."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
