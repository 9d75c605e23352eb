"""Importance resampling against plain counting and the contract's arithmetic; edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, words
from tideline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, width=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def plain(docs, items, buckets, width=2, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x, width)[1]) for rows in (docs, items))
    total = lambda c: sum(c.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total(s) + buckets) / ((s[b] + 1) * (total(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = features(x, width)
        weight = sum(gain[bucket(k)] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: len(able) * percent // 100]


@pytest.mark.parametrize(("buckets", "width"), [(10_000, 2), (37, 3), (70_000, 1)])
def test_against_plain_counting(spark, buckets, width):
    r = random.Random(buckets)
    docs = [(i, None if i % 17 == 0 else words(r.randint(0, 60), i, 9) + r.choice(["", " É中文 x_y", "\tA-b " + "q" * 300])) for i in range(120)] + [(None, words(30, 1)), (7, words(30, 2))]
    items = [(i, words(30, 1000 + i, 9)) for i in range(9)] + [(None, None)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), buckets=buckets, width=width)
    rows = got.collect()
    want, drawn = plain(docs, items, buckets, width)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    assert [tuple(r)[:5] for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, len(drawn) + 1))


def test_blocks_change_nothing(spark):
    docs = spark.createDataFrame([(i, words(40, i)) for i in range(60)], "doc_id long, text string")
    sums = [sorted(map(tuple, importance.column_sums(importance.count_matrix(docs, block_bytes=n)).collect())) for n in (1, 1000, 1 << 20)]
    assert sums[0] == sums[1] == sums[2]


def test_draws_towards_the_target(spark):
    docs = spark.createDataFrame([(i, ("red green blue " if i % 4 == 0 else "one two three ") * 20) for i in range(400)], "doc_id long, text string")
    drawn = importance.resample(docs, spark.createDataFrame([(1, "red green blue " * 400)], "item_id long, text string")).where("rank is not null")
    assert drawn.count() == 100 and drawn.where("doc_id % 4 = 0").count() > 90


def test_edges(spark):
    long = words(30_000, 5)
    rows = [(0, None, 1), (1, "", 2), (2, " .,", 3), (3, long, 4), (3, long, 4), (4, "x" * 100_000 + " " + words(40, 3), 5), (None, words(25, 4), 6), (None, words(25, 4), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").withColumns({"weight": F.lit("clash"), "at": F.lit(None), "n": F.lit(1)})
    items = spark.createDataFrame([(1, words(30, 5))], "item_id long, text string")
    got = importance.resample(docs, items).collect()
    want, drawn = plain([(i, t) for i, t, _ in rows], [(1, words(30, 5))], importance.BUCKETS)
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want)) and sum(r["rank"] is not None for r in got) == len(drawn) == 1
    assert importance.resample(spark.createDataFrame([], DOCS), items).count() == 0
    none = importance.resample(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(rows) and all(r.weight == 0 for r in none if not r.n_features)
