"""Token files against encoding text by text; range and metadata reads; edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import DOCS, words
from tideline.llm import token_files, token_files_queries

VOCABULARY = public_tokenizers.path(token_files_queries.TOKENIZER)
PARTS = [*"aBcÉéñ.,;:!?'’<>|-_ \n\t\x85\xa0̊́İſK…1２ßΣσ中文가\U0001f600\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "n't", "...", "don't"]


def plain(rows):
    """doc_id, start, n_tokens, CRC of each row, and all ids, by the library alone."""
    tokenizer, at, out, every = Tokenizer.from_file(VOCABULARY), 0, [], []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at, every = at + len(ids), every + ids
    return out, every


def test_words_encode_as_whole_texts():
    r = random.Random(1)
    by_words, whole = token_files.Encoder(VOCABULARY), token_files.Encoder(VOCABULARY, whole=True)
    for _ in range(600):
        texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))).encode() for _ in range(r.randint(1, 4))]
        for a, b in zip(by_words(texts), whole(texts), strict=True):
            assert a.tolist() == b.tolist()


def test_forgotten_words_change_nothing(monkeypatch):
    texts = [words(300, k).encode() for k in range(4)]
    want = token_files.Encoder(VOCABULARY)(texts)
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 50)
    monkeypatch.setattr(token_files, "CHUNK_WORDS", 7)
    encode = token_files.Encoder(VOCABULARY)
    got = [encode([t]) for t in texts]
    assert np.concatenate([g[0] for g in got]).tolist() == want[0].tolist() and [int(g[1][0]) for g in got] == want[1].tolist()


def test_query_against_the_library(spark, sf):
    want, _ = plain(sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, token_files_queries.op12_token_files(spark, sf).collect())) == want


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(i, words(5 + i % 40, i)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path_factory.mktemp('tokens')}/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(docs, path, VOCABULARY, page_rows=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, rows


def test_parts_and_ranges(spark, written):
    path, rows = written
    want, every = plain(rows)
    assert token_files.manifest(spark, path).count() > 1
    assert sorted(map(tuple, token_files.digests(token_files.read_tokens(spark, path)).collect())) == want
    r = random.Random(3)
    for first, end in [(0, len(every)), (0, 1), (len(every) - 1, len(every) + 9), (len(every), len(every) + 5), *(sorted(r.sample(range(len(every)), 2)) for _ in range(4))]:
        got = sorted(token_files.read_range(spark, path, first, end).collect())
        assert [x for row in got for x in row.ids] == every[first:end] and (not got or got[0].start == first)


def test_metadata_reads_leave_the_ids_alone(spark, written):
    path, rows = written
    some = token_files.read_tokens(spark, path, F.col("doc_id").between(100, 120)).select("doc_id", "start")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids:" not in plan and "GreaterThanOrEqual(doc_id,100)" in plan and some.count() == 21
    import pyarrow.parquet as pq

    file = next(f for f in spark.read.parquet(f"{path}/tokens").inputFiles())
    group = pq.ParquetFile(file.removeprefix("file://")).metadata.row_group(0)
    of = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert of["doc_id"].encodings == ("DELTA_BINARY_PACKED",) and "RLE_DICTIONARY" in of["ids.list.element"].encodings and all(c.has_offset_index for c in of.values())


def test_edges(spark, tmp_path):
    long = words(30_000, 5) + "中" * 50_000
    rows = [(None, "alone", 1), (5, None, 2), (5, None, 2), (3, "", 3), (4, long, 4), (-2, " \t\n", 5), (None, "alone", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("part", F.lit("clash"))
    path = f"file://{tmp_path}/odd"
    token_files.write_tokens(docs, path, VOCABULARY)
    order = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_files.digests(token_files.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == plain(order)[0]
    token_files.write_tokens(spark.createDataFrame([], DOCS), f"{path}-none", VOCABULARY)
    assert token_files.read_tokens(spark, f"{path}-none").count() == 0 and token_files.read_range(spark, f"{path}-none", 0, 9).count() == 0
