"""The pipeline's near-copies against brute-force Jaccard similarity of five-word shingles."""

import random
from math import comb

import numpy as np
import pytest

from tests.llm.test_operators import docs, words
from tideline.llm import simhash


def brute_kept(rows):
    """Rows (doc_id, text) with distinct ids: the smallest id of each group of Jaccard >= 0.8."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}


def test_near_copies_by_jaccard(spark):
    r = random.Random(3)
    texts = []
    for i in range(12):
        base = words(r.randint(60, 200), i, 400).split()
        texts.append(" ".join(base))
        for n in (1, 2, 3, 5):  # words changed: five shingles each
            own = list(base)
            for at in r.sample(range(len(own)), n):
                own[at] = f"new{i}x{n}y{at}"
            texts.append(" ".join(own))
    texts += [" ".join([*t.split()[:50], *words(300, 900 + i, 400).split()]) for i, t in enumerate(texts[:20])]
    want = brute_kept(list(enumerate(texts)))
    assert 12 < len(want) < len(texts)
    assert {x.doc_id for x in simhash.keep_one(docs(spark, texts)).collect()} == want


def test_near_copies_of_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("size(split(text, ' ')) >= 50")
    held = [(x.doc_id, x.text) for x in rows.orderBy("doc_id").collect()]
    got = {x.doc_id for x in simhash.keep_one(rows).collect()}
    assert got == brute_kept(held) and not {255, 991} <= got and not {709, 944} <= got


def test_repeated_ids_with_different_texts_stay(spark):
    a, b = words(80, 1), words(80, 2)
    table = spark.createDataFrame([(1, a), (1, a), (1, b), (None, words(80, 3)), (None, words(80, 4))], "doc_id long, text string")
    assert sorted(x.text for x in simhash.keep_one(table).collect()) == sorted([a, b, words(80, 3), words(80, 4)])


def test_hot_passage_and_hot_copies(spark, monkeypatch):
    """A passage that many different texts share, and a large group of near-copies, over units of few rows."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "GATHER", 50)
    shared = words(40, 77, 400)
    base = words(150, 5, 400).split()
    texts = [" ".join([shared, words(60, 200 + i, 400)]) for i in range(60)]
    for i in range(70):
        own = list(base)
        own[i] = f"new{i}"
        texts.append(" ".join(own))
    texts += [words(60, 500 + i // 2, 400) + (" end" if i % 2 else "") for i in range(40)]
    assert {x.doc_id for x in simhash.keep_one(docs(spark, texts)).collect()} == brute_kept(list(enumerate(texts)))


@pytest.mark.parametrize("chunk", [40, 2048])
def test_pairs_of_a_large_group_are_not_rows(spark, monkeypatch, chunk):
    """A group of near-copies that only some links connect: its pairs meet in memory, whole or in chunks, and no link is lost."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    base, texts = words(150, 9, 400).split(), []
    r = random.Random(4)
    for i in range(300):
        own = list(base)
        for at in r.sample(range(150), r.choice((1, 2, 3, 4))):
            own[at] = f"new{i}x{at}"
        texts.append(" ".join(own))
    texts += [words(40, 700 + i // 2, 400) + (" end" if i % 2 else "") for i in range(20)]
    pairs, confirmed = [], simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda p, sets, docs_: pairs.append(p.count()) or confirmed(p, sets, docs_))
    want = brute_kept(list(enumerate(texts)))
    assert 12 < len(want) < 310
    assert {x.doc_id for x in simhash.keep_one(docs(spark, texts)).collect()} == want
    assert max(pairs) < 20 * len(texts)


def test_similar_sets_of_a_crowd(monkeypatch):
    """Sides meet only each other, sets of one label are connected already, and each link joins two groups."""
    r = np.random.default_rng(8)
    base = r.integers(-(2**63), 2**63, 60)
    sets = [np.unique(np.concatenate((base[n:], r.integers(-(2**63), 2**63, n)))) for n in (0, 1, 2, 3, 9, 12, 14, 20, 30)]
    prints = np.array([simhash.majority(s.view(np.uint64)) for s in sets], np.uint64)
    near = {(i, j) for i in range(9) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    for side, labels in ((np.zeros(9), np.arange(9)), (np.arange(9) // 5, np.arange(9)), (np.zeros(9), np.arange(9) % 4)):
        got, want = simhash.Forest(9), simhash.Forest(9)
        for forest in (got, want):
            forest.join(np.arange(9), np.array([labels.tolist().index(x) for x in labels]))
        links = [(int(u), int(v)) for u, v in simhash.similar(side, labels, prints, sets, simhash.COPY_RADIUS)]
        assert {(max(x), min(x)) for x in links} <= near and len(links) < 9
        met = [(i, j) for i, j in near if len(set(side)) == 1 or side[i] != side[j]]
        for forest, pairs in ((got, links), (want, met)):
            forest.join(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))
        assert got.root.tolist() == want.root.tolist()


def chance_beyond(common, left, right, radius):
    """The chance that fingerprints of two sets are farther apart than the radius, bits of shingles' hashes being fair coins."""
    more = lambda n, need: sum(comb(n, k) for k in range(max(need, 0), n + 1)) / 2**n
    bit = 0.0
    for k in range(common + 1):
        a, b = more(left, (common + left) // 2 + 1 - k), more(right, (common + right) // 2 + 1 - k)
        bit += comb(common, k) / 2**common * (a * (1 - b) + b * (1 - a))
    return sum(comb(64, k) * bit**k * (1 - bit) ** (64 - k) for k in range(radius + 1, 65))


@pytest.mark.parametrize(("union", "most"), [(5, 1 / 75_000), (15, 1e-6), (50, 2e-7), (100, 2e-7), (400, 2e-7)])
def test_links_beyond_the_radius_are_rare(union, most):
    common = union * 4 // 5
    assert max(chance_beyond(common, n, union - common - n, simhash.COPY_RADIUS) for n in range(union - common + 1)) <= most


def test_fingerprints_differ_as_the_sum_says():
    r = np.random.default_rng(5)
    apart = []
    for _ in range(2000):
        h = r.integers(0, 2**64, 50, dtype=np.uint64)
        a, b = simhash.majority(h[:45]), simhash.majority(np.concatenate((h[:40], h[45:])))
        apart.append(bin(int(a) ^ int(b)).count("1"))
    for radius in (8, 10, 12):
        assert abs(np.mean(np.array(apart) > radius) - chance_beyond(40, 5, 5, radius)) < 0.04
    assert max(apart) <= simhash.COPY_RADIUS
