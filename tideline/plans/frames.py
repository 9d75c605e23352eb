"""Inputs of the registered queries, made from the driver's tables by expressions that Spark and DuckDB both read.

The conversations have no marks, so assistant texts get some by arithmetic on their numbers; long curves come from the events
of a user, in order of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKED = """
CASE WHEN role = 'assistant' THEN
  CASE WHEN (conv_id * 7 + msg_idx) % 5 <> 0 THEN '[Turn: ' || CAST(ord + CASE WHEN (conv_id + msg_idx) % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) || '] ' ELSE '' END
  || CASE WHEN (conv_id + 3 * msg_idx) % 6 = 0 THEN 'The key is to ' ELSE '' END
  || text
  || CASE WHEN (conv_id * 5 + msg_idx) % 6 = 0 THEN ' However, not so.' ELSE '' END
  || CASE (conv_id + 3 * msg_idx) % 4 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '1. only point' ELSE chr(10) || '1. first point' || chr(10) || '2. second point' END
  || CASE (conv_id + msg_idx) % 5 WHEN 0 THEN '' WHEN 1 THEN ' According to the Bureau, so.' WHEN 2 THEN ' (see 2021 note)' ELSE ' [Source: Almanac ' || CAST(conv_id % 3 AS VARCHAR(9)) || ']' END
  || CASE WHEN (conv_id + 2 * msg_idx) % 7 <> 0 THEN chr(10) || '[SYS_ACK: ACTIVE]' ELSE '' END
WHEN (conv_id + msg_idx) % 9 = 0 THEN 'Moving on. ' || text || ' You mentioned the golden harvester, right?'
ELSE text END"""
LANG = "CASE {0} % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'it' WHEN 2 THEN 'es' WHEN 3 THEN 'fr' ELSE 'de' END"
MODEL = "CASE {0} % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END"
TIER = "CASE {0} % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END"

MESSAGES_SQL = f"""
numbered AS (
  SELECT conv_id, turn AS msg_idx, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ord FROM conversations),
messages AS (
  SELECT conv_id, msg_idx, role, ord, {MARKED} AS text, {LANG.format("conv_id")} AS lang FROM numbered)"""

#: Levels of an event: they fall off as the curve goes on; users whose number ends in 3 never fail.
FALL = "((event_id * {0} + user_id * 7) % 13) + CASE WHEN turn > 12 THEN 2 ELSE 0 END"
LEVEL_SQL = {
    "l1": f"CASE WHEN user_id % 10 = 3 OR {FALL.format(31)} < 12 THEN 1.0 ELSE 0.0 END",
    "l2": f"CASE WHEN user_id % 10 = 3 OR {FALL.format(37)} < 9 THEN 1.0 WHEN {FALL.format(37)} < 12 THEN 0.5 ELSE 0.0 END",
    "l3": f"CASE WHEN user_id % 10 = 3 OR {FALL.format(41)} < 11 THEN 1.0 ELSE 0.0 END",
    "l4": f"CASE WHEN user_id % 10 = 3 OR {FALL.format(43)} < 10 THEN 1.0 ELSE 0.0 END",
    "l5": f"CASE WHEN user_id % 10 = 3 OR {FALL.format(47)} < 12 THEN 1.0 ELSE 0.0 END",
}
DDM_SQL = "CAST(0.2 AS DOUBLE) * l1 + CAST(0.2 AS DOUBLE) * l2 + CAST(0.2 AS DOUBLE) * l3 + CAST(0.2 AS DOUBLE) * l4 + CAST(0.2 AS DOUBLE) * l5"
SCORES_SQL = f"""
placed AS (
  SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
leveled AS (
  SELECT user_id AS conv_id, turn, value, event_id, {MODEL.format("user_id")} AS model, {TIER.format("user_id")} AS tier, {LANG.format("user_id")} AS lang,
         90 * turn + event_id % 50 AS context_tokens, {", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in LEVEL_SQL.items())} FROM placed),
scores AS (SELECT *, CASE WHEN (event_id * 53 + conv_id) % 29 = 0 AND conv_id % 10 <> 3 THEN CAST(0.0 AS DOUBLE) ELSE {DDM_SQL} END AS ddm FROM leveled)"""
KEY = ("model", "tier", "lang", "conv_id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("msg_idx"), "role", "text")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("msg_idx")))
    return rows.select("conv_id", "msg_idx", "role", F.expr(MARKED).alias("text"), F.expr(LANG.format("conv_id")).alias("lang"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "user_id", "value", "ts")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    rows = rows.select(
        F.col("user_id").alias("conv_id"), "turn", "value", "event_id", *(F.expr(x.format("user_id")).alias(n) for n, x in (("model", MODEL), ("tier", TIER), ("lang", LANG))),
        F.expr("90 * turn + event_id % 50").alias("context_tokens"), *(F.expr(x).cast("double").alias(n) for n, x in LEVEL_SQL.items()))
    low = F.expr("(event_id * 53 + conv_id) % 29 = 0 AND conv_id % 10 <> 3")
    return rows.withColumn("ddm", F.when(low, F.lit(0.0)).otherwise(F.expr(DDM_SQL)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits: results are compared without these. Counts as longs."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, digits) + 0.0).alias(name) if kind in ("double", "float") else c.cast("long").alias(name) if kind in ("int", "bigint", "smallint", "tinyint") else c.alias(name))
    return df.select(*out)


def unsigned_zero(sql: str, *columns: str) -> str:
    """SQL whose rounded columns hold no negative zero."""
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE {c} END AS {c}' for c in columns)}) FROM ({sql})"
