"""Substring deduplication: ids of any type, ranges of strings, and passages of words, each against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import brute_cut, docs, words
from tideline.llm import suffix_dedup


def brute_passages(rows, width):
    """n_passage_words of rows (id, text): rows of equal id and text are one document."""
    of = defaultdict(set)
    each = [(i, (t or "").encode().split()) for i, t in rows]
    for (_, t), (i, w) in zip(rows, each, strict=True):
        for k in range(len(w) - width + 1):
            of[tuple(w[k : k + width])].add((i, t))
    out = []
    for _, w in each:
        hit = {j for k in range(len(w) - width + 1) if len(of[tuple(w[k : k + width])]) > 1 for j in range(k, k + width)}
        out.append(len(hit))
    return out


def mixed(seed, n=50):
    r = random.Random(seed)
    base = [words(90, 50 + i, 400) for i in range(8)]
    texts = [None, "", "a " * 70, "a " * 200, "\t\n " + base[0], base[0], base[0], base[0].upper()]
    for i in range(n):
        a = r.choice(base).split()
        k = r.randrange(60)
        texts.append(" ".join([words(r.randrange(30), 900 + i), *a[k : k + r.randrange(60)], words(r.randrange(1, 30), 1900 + i)]))
    return texts


@pytest.mark.parametrize("width", [5, 12, 30])
def test_passages(spark, width):
    texts = mixed(width)
    got = {x.doc_id: x.n_passage_words for x in suffix_dedup.deduplicate(docs(spark, texts), passage=width).collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(list(enumerate(texts)), width)
    assert 0 < sum(n > 0 for n in got.values()) < len(texts)


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "decimal(20,0)"])
def test_ids_of_any_type(spark, kind):
    texts = mixed(1, 20)
    table = docs(spark, texts).selectExpr(f"cast(case when doc_id % 7 < 6 then doc_id end as {kind}) as doc_id", "text", "1 as key", "'x' as places", "2 as n_passage_words")
    got = sorted((x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.deduplicate(table, 60).collect())
    assert got == sorted(brute_cut(texts, 60)) and sum(x[1] for x in got) > 0


def test_ranges_of_strings(spark, monkeypatch):
    """Many small ranges, and one beginning that more strings have than a range holds."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRINGS", 7)
    monkeypatch.setattr(suffix_dedup, "HEAD_SAMPLE", 1)
    r = random.Random(2)
    texts = mixed(2, 40) + ["samesame " + words(12, i % 5) + words(3, i) for i in range(40)]
    r.shuffle(texts)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.deduplicate(docs(spark, texts), 40).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_cut(texts, 40))]
    ranges = suffix_dedup.Ranges([5, 5, 5, 9], 5)
    assert ranges.size == [1, 3, 1] and ranges.first == [0, 1, 4]
    assert {ranges.bucket(bytes([0, 0, 0, 0, 0, 5, k])) for k in range(60)} == {1, 2, 3} and ranges.bucket(b"\0\0\0\0\0\x04zz") == 0 and ranges.bucket(b"zzzzzz") == 4


def test_verdicts_from_common_prefixes():
    """Neighbours that agree in `length` bytes or more have that many windows repeated, without being equal."""
    strings = sorted([b"abcdefgh", b"abcdefxx", b"abcd", b"zzzzzz"])
    row = dict(zip([c.split()[0] for c in suffix_dedup.RUNS.split(", ")], suffix_dedup._run("r", 0, {s: [False, [(k, 0, 0)]] for k, s in enumerate(strings)}), strict=True))
    out = suffix_dedup._verdicts([row], 4)
    assert np.frombuffer(out.column(2)[0].as_py(), "<i4").tolist() == [1, 3, 3, 0]


def test_words_of_pieces(monkeypatch):
    text = b" ab  c\n" + b"x" * 50 + b" tail " * 9
    whole = suffix_dedup.word_hashes(text)
    monkeypatch.setattr(suffix_dedup, "PIECE", 8)
    for a, b in zip(suffix_dedup.word_hashes(text), whole, strict=True):
        assert a.tolist() == b.tolist()
    assert len(whole[0]) == len(text.split())
