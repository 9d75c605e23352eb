"""Target-distribution importance resampling over hashed word features.

Features are runs of 1 to WIDTH consecutive words, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo
`buckets`. The document-by-bucket counts are stored once, as CSR blocks: a row of a table in the shared folder for each
BLOCK_BYTES of text, with row starts, sorted buckets of 16 bits (32 beyond 65,536 buckets) and counts. Everything after that reads the
blocks, never the texts:

* column sums of the documents' blocks and of the target's give the two distributions. A task sums its blocks into one vector and
  hands on a row for each bucket, so that a shuffle of at most tasks x buckets rows adds them up;
* a bucket's gain is the logarithm of its smoothed shares' ratio, in thousandths. The gains are a vector of `buckets` numbers
  (80 KB as queried), which is all that the driver holds;
* the product of each block and the gains, over the documents' features, is the weight. With Gumbel noise from a hash of the
  id, the highest scores are a sample without replacement in proportion to exp(weight / 1000). One range sort numbers the rows.

Edge cases: a null text has no words, nor has one without any; no features weigh 0, and such rows are never drawn. Ties go to
the smaller doc_id, null ids last; equal rows are ranked one after the other. A null id takes its noise from `7:null`. Texts of
any length count whole: a text longer than a block is a block. An empty table gives an empty result; an empty target has gains of the
smoothing alone. Only doc_id (a whole number) and text are read; other columns can have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import stored
from tideline.llm.decontaminate import LOWER

BUCKETS = 10_000
WIDTH = 2
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
#: Text that a block holds, about. Its arrays take some forty times as much in the task.
BLOCK_BYTES = 2 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32 register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()
ALL = np.uint32(0xFFFFFFFF)


def _after(crc: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of what crc stands for, followed by data[first : first + size]. All words take their k-th byte at once."""
    order = np.argsort(-size, kind="stable")
    state, at = (crc ^ ALL)[order], first[order]
    long = int(np.searchsorted(-size[order], -LONG_WORD))
    for k in range(int(min(size.max(initial=0), LONG_WORD))):
        n = int(np.searchsorted(-size[order], -k))
        here = state[long:n]
        state[long:n] = CRC[(here ^ data[at[long:n] + k]) & 255] ^ (here >> 8)
    out = np.empty_like(state)
    out[order] = state ^ ALL
    for i in order[:long]:
        out[i] = zlib.crc32(data[first[i] : first[i] + size[i]], int(crc[i]))
    return out


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all features: the text's number, and the bucket; and each text's words."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    edge = np.flatnonzero(np.diff(data != 0, prepend=False, append=False))
    first, size = edge[0::2], edge[1::2] - edge[0::2]
    text = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), first, "right") - 1
    begin, crc = np.arange(len(first)), _after(np.zeros(len(first), np.uint32), data, first, size)
    of, found = [text], [crc]
    for k in range(1, width):
        more = begin + k < len(first)
        more[more] = text[begin[more] + k] == text[begin[more]]
        begin, crc = begin[more], crc[more] ^ ALL
        crc = _after(CRC[(crc ^ np.uint32(0x20)) & 255] ^ (crc >> 8) ^ ALL, data, first[begin + k], size[begin + k])
        of.append(text[begin])
        found.append(crc)
    return np.concatenate(of), np.concatenate(found).astype(np.int64) % buckets, np.bincount(text, minlength=len(texts))


MATRIX = "doc_id array<long>, n_words array<long>, row_from binary, bucket binary, n binary"


def _block(ids: list, texts: list[bytes], buckets: int, width: int) -> pa.RecordBatch:
    text, bucket, n_words = feature_buckets(texts, buckets, width)
    cell, n = np.unique(text * buckets + bucket, return_counts=True)
    row_from = np.searchsorted(cell, np.arange(len(texts) + 1) * buckets)
    arrays = [pa.array([ids], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64()))]
    arrays += [pa.array([x.tobytes()], pa.binary()) for x in (row_from.astype("<i8"), (cell % buckets).astype(_narrow(buckets)), n.astype("<u4"))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "row_from", "bucket", "n"])


def _narrow(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _counted(batches: Iterator[pa.RecordBatch], buckets: int, width: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or b""
            if texts and held + len(text) > block_bytes:
                yield _block(ids, texts, buckets, width)
                ids, texts, held = [], [], 0
            ids.append(i), texts.append(text)
            held += len(text) + 1
    if texts:
        yield _block(ids, texts, buckets, width)


def count_matrix(docs: DataFrame, name: str = "doc_id", buckets: int = BUCKETS, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The document-by-bucket counts of docs (name, text) as CSR blocks, a table in the shared folder."""
    rows = docs.select(F.col(name).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(partial(_counted, buckets=buckets, width=width, block_bytes=block_bytes), MATRIX), "buckets")


def _cells(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of batches, a row each: batch, row, row starts, buckets, counts."""
    for batch in batches:
        own = {c: batch.column(c) for c in batch.schema.names}
        for row in range(batch.num_rows):
            of = lambda c, kind: np.frombuffer(own[c][row].as_buffer(), kind)  # noqa: B023, E731
            yield batch, row, of("row_from", "<i8") if "row_from" in own else None, of("bucket", _narrow(buckets)), of("n", "<u4").astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for _, _, _, bucket, n in _cells(batches, buckets):
        total += np.bincount(bucket, weights=n, minlength=buckets).astype(np.int64)  # a block's sums are exact in doubles
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all rows of the matrix in each bucket that has any."""
    return matrix.select("bucket", "n").mapInArrow(partial(_sums, buckets=buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of its smoothed share of the target's features over its share of our own, floored."""
    both = np.zeros((2, buckets))
    for k, sums in enumerate((own, target)):
        for bucket, n in sums.collect():  # as many rows as buckets at most
            both[k, bucket] = n
    (s, t), (all_s, all_t) = both, both.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, row, row_from, bucket, n in _cells(batches, len(gain)):
        summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[row_from])  # noqa: B023, E731
        features, total = summed(n), summed(n * gain[bucket])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row].values, batch.column("n_words")[row].values, pa.array(features), pa.array(total // np.maximum(features, 1))], names=["doc_id", "n_words", "n_features", "weight"])


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""
    return matrix.mapInArrow(partial(_weighed, gain=gain), WEIGHTS)


def noise(seed: int = SEED) -> Column:
    """A thousand times a Gumbel variable from the id's hash, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, target_name: str = "item_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of docs: `percent` of those with
    `least_words` words are drawn, so that what is drawn is distributed as the target is."""
    matrix = count_matrix(docs, "doc_id", buckets, width)
    wanted = column_sums(count_matrix(target, target_name, buckets, width), buckets)
    rows = weights(matrix, gains(column_sums(matrix, buckets), wanted, buckets)).withColumn("score", F.col("weight") + noise(seed))
    fit = F.col("n_words") >= least_words
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "weights")
    most = rows.where(fit).count() * percent // 100
    order = (fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at"))
    ranged = stored(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part")).count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a partition
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(before), part == F.col("part")).select("doc_id", "n_words", "n_features", "weight", "score", F.when(fit & (rank <= most), rank).alias("rank"))
