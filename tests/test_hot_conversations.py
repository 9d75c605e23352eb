"""One conversation with very many messages: slices, classes and first occurrences against every pair."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.operators import validate

SCHEMA = "conv_id long, msg_idx long, role string, text string"


def grams(text, n):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def talk(spark):
    r = random.Random(2)
    some = [" ".join(r.choice("abcdefghij") * 3 for _ in range(9)) for _ in range(12)]
    texts = [r.choice(some) + r.choice(["", "", " extra words at the end " + str(k)]) for k in range(160)]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, i, "user", texts[0]) for i in range(4)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [4, 7, 512])
def test_slices_see_all_neighbours(talk, monkeypatch, size):
    rows, df = talk
    monkeypatch.setattr(validate, "SLICE", size)
    said = [grams(t, 3) for c, i, role, t in rows if role == "assistant"]
    want = {(i, j) for i, a in enumerate(said) for j, b in list(enumerate(said))[i + 1 : i + 5] if len(a & b) / len(a | b) > 0.6}
    got = [(x.i, x.j) for x in validate.near_repeats(df).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("block", [2, 256])
def test_classes_against_every_pair(talk, monkeypatch, block):
    rows, df = talk
    monkeypatch.setattr(validate, "BLOCK", block)
    sets = [grams(t, 5) for c, i, role, t in rows if role == "user" and c == 1]
    rep = [next(k for k, other in enumerate(sets) if other == s) for s in sets]
    want = Counter()
    for i, a in enumerate(sets):
        for j in range(i + 5, len(sets)):
            b = sets[j]
            if len(a & b) / min(len(a), len(b)) > 0.5:
                x, y = sorted((i, j), key=lambda k: rep[k])
                want[rep[x], rep[y], len(a & b), len(sets[x]), len(sets[y])] += 1
    pairs, belong = validate.verbatim_classes(df)
    got = [(x.a, x.b, x.shared, x.n_a, x.n_b, x.n_pairs) for x in pairs.collect()]
    assert sorted(got) == sorted((*k, n) for k, n in want.items())
    assert sorted((x.rep, x.ord) for x in belong.collect()) == sorted(zip(rep, range(len(sets)), strict=True))
    rows_of = {(x.i, x.j): (x.shared, x.n_i, x.n_j) for x in validate.of_rows(pairs, belong, 5).collect()}
    assert len(rows_of) == sum(want.values()) and all(v == (len(sets[i] & sets[j]), len(sets[i]), len(sets[j])) and j - i >= 5 for (i, j), v in rows_of.items())


@pytest.mark.parametrize("query, gap", [("far_overlap_pairs", 5), ("topic_repeat_pairs", 10)])
def test_pairs_of_rows_follow_from_the_query(spark, query, gap):
    """Classes' pairs come with who is in which class: every pair of rows can be had from the result alone."""
    from tideline.plans.rule_queries import QUERIES

    got = QUERIES[query](spark, "/root/testdata/sf0.01").collect()
    held = {}
    for x in got:
        if x.kind == "member":
            held.setdefault((x.conv_id, x.a), []).append(x.b)
    assert held and len({(c, k) for (c, _), ks in held.items() for k in ks}) == sum(map(len, held.values()))
    for x in got:
        if x.kind == "pair":
            both = {tuple(sorted((i, j))) for i in held[x.conv_id, x.a] for j in held[x.conv_id, x.b] if abs(i - j) >= gap}
            assert len(both) == x.n_pairs > 0


@pytest.mark.parametrize("held", [3, 1 << 22])
def test_pairs_are_not_shuffled(talk, monkeypatch, held):
    """A conversation that shares every word: no more rows meet than classes in each block, at any size of block."""
    monkeypatch.setattr(validate, "HELD", held)
    monkeypatch.setattr(validate, "AT_ONCE", held)
    df = talk[1].sparkSession.createDataFrame([(1, "u", k, sorted({*(f"w{(k * m) % 17}" for m in (1, 2, 3)), "all", f"own{k}"})) for k in range(12)], "conv_id long, role string, ord long, members array<string>")
    classes, belong = validate.set_classes(df.select("conv_id", "ord", "members"), "members")
    found = validate.class_pairs(classes, lambda n, small, large: n / small > 0.3)
    sets = {x.ord: set(x.members) for x in df.collect()}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) > 0.3}
    got = [(x.a, x.b, x.shared, x.n_a, x.n_b) for x in found.collect()]
    assert want and sorted(got) == sorted(want) and belong.count() == 12


def test_a_passage_in_all_messages_is_one_class(spark):
    text = "the same nine words that all of them hold"
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("msg_idx"), F.lit("user").alias("role"), F.lit(text).alias("text"))
    pairs, belong = validate.verbatim_classes(df)
    got = pairs.collect()
    assert len(got) == 1 and got[0].n_pairs == sum(3000 - 5 - i for i in range(2995)) and belong.count() == 3000


@pytest.mark.parametrize("terms", [1, 256])
def test_phantoms_against_every_reply(spark, monkeypatch, terms):
    monkeypatch.setattr(validate, "TERMS", terms)
    r = random.Random(6)
    words = ["garden", "kettle", "window", "marble", "ladder", "violin"]
    rows = []
    for c in range(6):
        for i in range(30):
            role = "user" if i % 2 == 0 else "assistant"
            rows.append((c, i, role, f"You mentioned the {r.choice(words)} and {r.choice(words)}, yes?" if role == "user" else f"Some{r.choice(words)}s here" if i > 3 * c else "nothing"))
    rows.append((9, 0, "user", "You said something about the garden, no?"))
    df = spark.createDataFrame(rows, SCHEMA)
    from tideline.functions import text as T

    asked = df.where("role = 'user'").select("conv_id", "msg_idx", F.explode(T.references(F.col("text"))).alias("x")).collect()
    want = set()
    for c, at, x in asked:
        before = [t.lower() for k, i, role, t in rows if k == c and role == "assistant" and i < at]
        named = [w for w in x.replace(",", " ").split() if len(w) >= 5]
        if before and named and not any(w in t for w in named for t in before):
            want.add((c, at, x))
    assert want and {tuple(x) for x in validate.phantoms(df).collect()} == want
