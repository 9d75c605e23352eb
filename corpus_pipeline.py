"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, and the mix of sources.

Every stage takes the documents that the one before it kept, whole, and returns the columns of documents; the last
returns the mix, with the size, the source's size and target, and the words taken of each document.

Edge cases: a document without text, or with under 50 words, fails the quality rules and goes. Null languages and sources
are groups like others, and the null source comes last in the mix. Documents with a null id stay documents of their own: of
near-copies that with the least id stays, without ids that with the least hash of its text. Rows of equal id and text
are one after the second stage; equal ids with different texts both stay. Of ties the operators' docstrings say which comes
first. Texts of any length pass whole. An empty table gives an empty mix. Extra columns pass all stages, whatever their
names, but for those that the mix adds (size, source_size, target, taken), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, mixing, quality_rules, secret_scan, simhash
from tideline.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejected documents go."""
    whole = docs.select(F.struct("*").alias("document"), "text", "lang", "source")  # columns named like the counts pass inside
    return quality_rules.judged(whole, ["document"]).where("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the mix takes, once or twice."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mix", mix)]

#: Fingerprint components and offsets of secrets are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
