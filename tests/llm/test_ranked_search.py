"""Ranked search against scoring every document; blocks against all ways of cutting; edge cases."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, words
from tideline.llm import ranked_search as R

TERMS = re.compile(R.TERM)


def terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, limit=50):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in wanted}
        scores = []
        for doc, w in held:
            m = 50 + 50 * len(w) * n // length
            score = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in wanted if t in w)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores)[:limit], 1)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def zipf(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(n))


@pytest.mark.parametrize(("segment", "most", "limit"), [(400, 2, 5), (20_000, 256, 50), (1 << 20, 3, 7)])
def test_against_scoring_everything(spark, segment, most, limit):
    docs = [(i, zipf(5 + i % 60, i % 150)) for i in range(300)]
    items = [(i, zipf(12, 900 + i)) for i in range(9)] + [(None, "w1 w2 É"), (3, "w7 w9"), (20, None), (21, "nothing here")]
    index, n = R.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), segment)
    got = R.search(index, n, spark.createDataFrame(items, "item_id long, text string"), limit, most)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, items, limit), key=key)


def test_blocks_have_the_least_error():
    r = random.Random(4)
    for longest in (3, 64):
        count = np.array([r.randint(1, 9) for _ in range(40)] + [20, 1])
        impact = np.array([r.randint(0, 9) * 100 for _ in range(int(count.sum()))])
        opens, blocks = R.cut_lists(impact, count, 150, longest)
        assert blocks.sum() == len(opens)
        cost = lambda x, cuts: sum(150 + max(x[a:b]) * (b - a) - sum(x[a:b]) for a, b in itertools.pairwise(cuts))
        at = k = 0
        for n, b in zip(count, blocks, strict=True):
            x, cuts = impact[at : at + n].tolist(), [*(opens[k : k + b] - at).tolist(), int(n)]
            assert cuts[0] == 0 and all(0 < q - p <= longest for p, q in itertools.pairwise(cuts))
            if n <= 9:
                ways = ([0, *(i for i in range(1, n) if m >> (i - 1) & 1), int(n)] for m in range(1 << (n - 1)))
                assert cost(x, cuts) == min(cost(x, c) for c in ways if all(q - p <= longest for p, q in itertools.pairwise(c)))
            at, k = at + n, k + b


def test_blocks_are_skipped():
    r = random.Random(5)
    n = 20_000
    lists = R.Lists()
    for share in (0.5, 0.1, 0.02):
        place = np.array(sorted(r.sample(range(n), int(n * share))))
        impact = np.array([900_000 if 5000 < p < 5100 else r.randint(100, 1000) for p in place])
        opens, _ = R.cut_lists(impact, np.array([len(place)]))
        lists.add(place, impact, opens[1:], np.maximum.reduceat(impact, opens))
    asked, best, ids = [(0, 3), (1, 8), (2, 20)], R.Best(20), np.arange(n)
    scored = R.search_shard(lists, asked, ids, n, best)
    every = np.zeros(n, np.int64)
    for k, w in asked:
        every[lists.place[k]] += w * lists.impact[k]
    order = np.lexsort((ids, -every))[:20]
    assert best.score.tolist() == every[order].tolist() and best.id.tolist() == order.tolist() and scored < n // 4
    low = R.Lists()
    low.add(np.arange(10), np.full(10, 5), np.zeros(0, int), np.array([5]))
    assert R.search_shard(low, [(0, 1)], ids, n, best) == 0  # whole lists below the threshold: the shard is not opened


def test_edges(spark):
    long = words(30_000, 5)
    rows = [(0, None), (1, ""), (2, long), (2, long), (3, "same words here"), (4, "same words here"), (None, "same words here"), (5, "A-B a_b \x85É"), (6, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"term": F.lit("clash"), "segment": F.lit(1), "item_id": F.lit(2)})
    items = [(1, "SAME words"), (2, "a b é É \x85É"), (None, "here"), (3, long[:50]), (4, ""), (5, None)]
    got = R.rank(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, items), key=key)
    assert R.rank(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert R.rank(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_shuffled_sides_agree(spark, monkeypatch):
    docs = [(i, zipf(20, i)) for i in range(80)]
    items = [(i, zipf(8, 900 + i)) for i in range(4)]
    monkeypatch.setattr("tideline.llm.common.BROADCAST_ROWS", 1)
    got = R.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs, items))
