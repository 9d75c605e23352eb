"""Query of the token files. The library's tokenizer is beyond SQL: tests hold the query against encoding text by text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import token_files
from tideline.llm.common import shared_folder, table

TOKENIZER = "word_bpe_49k.json"


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.digests(token_files.read_tokens(spark, path))


QUERIES = {"op12_token_files": op12_token_files}
ORACLES = {}
