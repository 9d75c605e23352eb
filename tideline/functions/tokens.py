"""Token counters as columns, a slot for a tokenizer of one's own, and what parallel texts make of them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import words

COUNTERS: dict[str, Callable[[Column], Column]] = {
    "whitespace": lambda text: F.size(words(text)),
    "char": F.length,
    "utf8_bytes": F.octet_length,
    "word_punct": lambda text: F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")),
}


def count_tokens(text: Column, counter: str | Callable[[pd.Series], pd.Series] = "whitespace") -> Column:
    """By name, or by a function of a batch of texts (a model's tokenizer), which runs vectorised on the executors."""
    if callable(counter):
        return F.pandas_udf(counter, "long")(text)
    return COUNTERS[counter](text).cast("long")
