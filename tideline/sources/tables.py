"""Readers of conversation corpora and run outputs, and their writers. Paths may be of any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("content", T.StringType())])
MASTER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("num_turns", T.IntegerType()),
    T.StructField("conversations", T.MapType(T.StringType(), T.ArrayType(MESSAGE))), T.StructField("messages", T.ArrayType(MESSAGE)),
])
TURN_SCORES = "conversation_id string, language string, model string, turn int, l1_format double, l2_structure double, l3_lexical double, l4_citation double, l5_dynamic double, ddm_score double"
SUMMARY = "conversation_id string, language string, model string, total_turns int, mean_ddm double, std_ddm double, auc double, drift_onset int, sustained_dop int, total_collapse int, half_life int, recovery_rate double, recovery_events int"


def said(message) -> F.Column:
    return F.coalesce(message["text"], message["content"], F.lit(""))


def read_conversations(spark: SparkSession, pattern: str) -> DataFrame:
    """JSONL conversations, a file each: tier and lang from the folders, conv_id from the name, msg_idx the line. A file is read
    whole, as lines have no number and a split would lose their order; files are small, and many."""
    files = spark.read.text(pattern, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    lines = files.select("path", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("msg_idx", "line"))
    message = F.from_json("line", MESSAGE)
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    tier = F.when(part(3) == "parallel", part(4)).otherwise(F.lit(None).cast("string"))
    return lines.select(tier.alias("tier"), part(2).alias("lang"), F.regexp_replace(part(1), r"\.jsonl$", "").alias("conv_id"), "msg_idx", F.coalesce(message["role"], F.lit("user")).alias("role"), said(message).alias("text"))


def read_masters(spark: SparkSession, pattern: str) -> DataFrame:
    """Nested documents, one a file: a row for each message of each language; plain `messages` are English."""
    docs = spark.read.schema(MASTER).json(pattern, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    docs = docs.where(~F.col("path").contains("summary"))
    both = F.coalesce("conversations", F.map_from_arrays(F.array(F.lit("en")), F.array("messages")))
    rows = docs.select(F.col("id").alias("conv_id"), "domain", F.explode(both).alias("lang", "messages"))
    rows = rows.select("conv_id", "domain", "lang", F.posexplode("messages").alias("msg_idx", "m"))
    return rows.select("conv_id", "domain", "lang", "msg_idx", F.coalesce(F.col("m.role"), F.lit("user")).alias("role"), said(F.col("m")).alias("text"))


def either(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the first source, and those of the second whose conversation the first lacks."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def languages(messages: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    found = messages.select("lang").distinct()
    return found.where(F.col("lang").isin(allowed)) if allowed else found


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(TURN_SCORES).csv(path, header=True)


def read_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(SUMMARY).csv(path, header=True)


def read_keyed_json(spark: SparkSession, path: str, value: str = "array<int>") -> DataFrame:
    """A JSON object of `model|lang|conversation` keys: model, lang, conv_id and the value."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    parts = F.split("key", r"\|", 3)
    return whole.select(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("lang"), F.get(parts, F.lit(2)).alias("conv_id"), "value")


def context_lengths(keyed: DataFrame) -> DataFrame:
    return keyed.select("model", "lang", "conv_id", F.posexplode("value").alias("at", "context_tokens")).select("model", "lang", "conv_id", (F.col("at") + 1).alias("turn"), "context_tokens")


def first_file_per_domain(files: DataFrame) -> DataFrame:
    """path and domain of the first file of each domain, by path."""
    return files.groupBy("domain").agg(F.min("path").alias("path"))


# --- sinks


def write_bundle(scores: DataFrame, summary: DataFrame, groups: DataFrame, intervals: DataFrame, folder: str, form: str = "parquet") -> None:
    for name, rows in (("drift_results", scores), ("drift_summary", summary), ("drift_aggregated", groups), ("drift_ci95", intervals)):
        writer = rows.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}") if form == "csv" else writer.parquet(f"{folder}/{name}")


def write_level_decay(decay: DataFrame, folder: str) -> None:
    decay.write.mode("overwrite").json(f"{folder}/per_level_decay")


def write_partitioned(messages: DataFrame, folder: str, by: tuple[str, ...] = ("tier", "lang"), form: str = "json") -> None:
    """A folder for each value; a conversation's lines in order."""
    messages.sortWithinPartitions(*by, "conv_id", "msg_idx").write.mode("overwrite").partitionBy(*by).format(form).save(folder)


def write_profiles(profiles: DataFrame, folder: str, by: tuple[str, ...] = ("model", "lang"), order: tuple[str, ...] = ("conv_id", "turn")) -> None:
    """Attention profiles: a folder for each model and language, its conversations' turns in order."""
    profiles.repartition(*by, order[0]).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).json(folder)


def write_masters(messages: DataFrame, folder: str) -> None:
    """A document a conversation, with its languages' messages nested."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "role", "text"))), lambda m: F.struct(m.role.alias("role"), m.text.alias("content")))
    langs = messages.groupBy("conv_id", "lang").agg(one.alias("messages"))
    docs = langs.groupBy(F.col("conv_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "messages"))).alias("conversations"))
    docs.write.mode("overwrite").json(folder)


def write_annotations(rows: DataFrame, folder: str) -> None:
    """Append; readers take the last of each key."""
    rows.write.mode("append").parquet(folder)


def read_annotations(spark: SparkSession, folder: str, key: tuple[str, ...] = ("annotator", "conv_idx")) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("saved_at").desc()))
    return spark.read.parquet(folder).withColumn("at_", at).where("at_ = 1").drop("at_")
