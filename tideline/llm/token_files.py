"""Token ids in Parquet files that can be read in part.

Documents are range-sorted by id, encoded where they land, and written once; a row of the files is a document:

    part int        the writing task; parts are in the order of ids
    doc_id long
    at long         ids of the part before this document
    n_tokens int    with the end id
    ids array<int>

and `manifest` beside the files has a row for each part: its documents, its tokens and the tokens before it, so a document's place in the
whole stream is the part's plus its own, and no pass over the ids is needed to number them.

Encoding: version 2 pages. doc_id, at and n_tokens are delta-coded (no dictionary), ids go through a dictionary, which a
vocabulary of 50,000 ids fits (beyond DICTIONARY_BYTES Parquet falls back to deltas). Row groups of GROUP_BYTES and pages of
PAGE_ROWS documents bound what a selective read fetches: as parts and pages are sorted by id and by place, a filter on
either passes over row groups by their statistics and over pages by the page index, and a reader of metadata never touches the ids' pages.

The tokenizer is the given file of the tokenizers library, and a text's ids are those of encode() of the whole text. As its
white space is dropped and no rule of it reaches over an ASCII space, or from an ASCII letter to a full stop, comma, colon, semicolon, question or
exclamation mark, a batch's distinct words between such places are encoded once each (in one case, if it folds case), and a
worker keeps up to KNOWN_WORDS of them (what is kept changes work, not results). `whole=True` encodes text by text, for tokenizers of which that does not hold.

Edge cases: a null or empty text is the end id alone. Null ids come first; rows of equal id follow each other, in any order.
Strings of special tokens in a text are encoded as the library does by default (as that token). Texts of any length are one row. An empty table gives files
without rows and an empty manifest. Only doc_id (a whole number) and text are read; other columns can have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import small_batches, small_or_shuffled

END_ID = 1
GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
DICTIONARY_BYTES = 1 << 20
#: 120 MB.
KNOWN_WORDS = 600_000
#: Longer words are encoded, but not kept.
KEPT_BYTES = 64
#: Words encoded in one go.
CHUNK_WORDS = 20_000

SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
MARK = np.isin(np.arange(256), list(b".,;:!?"))
LETTER = np.isin(np.arange(256) | 32, range(ord("a"), ord("z") + 1)) & (np.arange(256) < 128)
#: A-Z to a-z.
FOLDED = np.where(LETTER, np.arange(256) | 32, np.arange(256)).astype(np.uint8)


class Encoder:
    """Ids of texts, by the tokenizers library."""

    def __init__(self, vocabulary: str, end_id: int = END_ID, whole: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.whole = Tokenizer.from_file(vocabulary), end_id, whole
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them are each text's, its end id included."""
        if self.whole:
            found = [self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
            n, ids = np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in found)])
        else:
            n, ids = self._by_words(texts)
        out = np.full(len(ids) + len(texts), self.end_id, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)] = ids
        return out, n + 1

    def _by_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(texts)
        data = np.frombuffer(joined, np.uint8)
        if self.folds and not any(x in joined.lower() for x in self.special):  # else a string could turn into a special token's
            data = FOLDED[data]
        inside = ~SPACE[data]
        begins = inside & np.append(True, ~inside[:-1] | (MARK[data[1:]] & LETTER[data[:-1]])) if len(data) else inside
        first = np.flatnonzero(begins)
        text = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), first, "right") - 1
        held = data[inside]
        ends = np.append((np.cumsum(inside) - 1)[first], len(held)).astype("<i8")
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(held)]).dictionary_encode()
        of, names = words.indices.to_numpy(), words.dictionary.to_pylist()
        if len(self.known) + len(names) > KNOWN_WORDS:
            self._forget()
        place = np.fromiter((self.known.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        place[new] = len(self.count) + np.arange(len(new))
        counts, flat = [self.count], [self.flat]
        for at in range(0, len(new), CHUNK_WORDS):
            found = self._encoded([names[k].decode() for k in new[at : at + CHUNK_WORDS]])
            counts.append(found[0]), flat.append(found[1])
        count, flat = np.concatenate(counts), np.concatenate(flat)
        self.known.update((names[k], int(place[k])) for k in new if len(names[k]) <= KEPT_BYTES)
        self.count, self.flat = count, flat
        n, start = count[place][of], (np.cumsum(count) - count)[place][of]
        ids = flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64), ids

    def _forget(self) -> None:
        """known: each word's place in count, the number of ids of each word; flat: all their ids."""
        self.known: dict[bytes, int] = {}
        self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids, from one text that has them all: an id is the word's in which it begins."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
        after = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
        return np.diff(np.searchsorted(begins, after), prepend=0), np.array(found.ids, np.int32)


@lru_cache(maxsize=1)
def encoder(vocabulary: str, end_id: int, whole: bool) -> Encoder:
    """One for all tasks of a worker, as the words of one task are most of the next's."""
    return Encoder(vocabulary, end_id, whole)


TOKENS = "part int, doc_id long, at long, n_tokens int, ids array<int>"


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, whole: bool) -> Iterator[pa.RecordBatch]:
    encode, part, at = encoder(vocabulary, end_id, whole), TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, n = encode([x.as_py() or b"" for x in batch.column(1)])
        ends = np.cumsum(n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(at + ends - n), pa.array(n.astype(np.int32)), lists], names=["part", "doc_id", "at", "n_tokens", "ids"])
        at += int(n.sum())


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, whole: bool = False, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode docs (doc_id, text) into path, which must not exist, in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id").drop("tie")
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "at", "n_tokens")}
    sizes = {"parquet.block.size": group_bytes, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": page_rows, "parquet.dictionary.page.size": DICTIONARY_BYTES}
    encoded = ordered.mapInArrow(partial(_encoded, vocabulary=vocabulary, end_id=end_id, whole=whole), TOKENS)
    encoded.write.options(**{"parquet.writer.version": "v2", "parquet.enable.dictionary": "true"} | plain | sizes).parquet(f"{path}/tokens")
    parts = spark.read.schema(TOKENS).parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")  # a row a part
    parts.select("part", "documents", "tokens", before.alias("start")).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, documents, tokens, start: the tokens before it."""
    return spark.read.schema("part int, documents long, tokens long, start long").parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; where: a condition on doc_id, at, n_tokens or part, which reaches the files' statistics and page
    indexes. Columns that are not used are not read: without ids this reads metadata alone."""
    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    rows = rows if where is None else rows.where(where)
    parts = small_or_shuffled(manifest(spark, path).select(F.col("part").alias("of"), F.col("start").alias("part_start")))
    return rows.join(parts, F.col("part") == F.col("of")).select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """The ids from place first up to end of the whole stream: start, ids of each document that has some, cut at both ends."""
    rows = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    parts = manifest(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("tokens") > first))
    inside = None
    for part, start in parts.select("part", "start").orderBy("part").limit(2).collect():  # the ends of the first part say what its pages hold
        inside = F.col("part") >= part if inside is None else inside
        if start <= first:
            inside &= (F.col("part") > part) | (F.col("at") + F.col("n_tokens") > first - start)
    if inside is None:
        return rows.select(F.col("at").alias("start"), "ids").limit(0)
    hint = small_or_shuffled(parts.select(F.col("part").alias("of"), F.col("start").alias("part_start")))
    start = F.col("part_start") + F.col("at")
    found = rows.where(inside).join(hint, F.col("part") == F.col("of")).select(start.alias("start"), "n_tokens", "ids").where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > first))
    skipped = F.greatest(first - F.col("start"), F.lit(0))
    return found.select((F.col("start") + skipped).alias("start"), F.slice("ids", (skipped + 1).cast("int"), (F.least(end - F.col("start"), F.col("n_tokens")) - skipped).cast("int")).alias("ids"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.num_columns - 1)
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, and the CRC-32 of each document's ids as little-endian 32-bit numbers."""
    rows = tokens.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    return rows.mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
