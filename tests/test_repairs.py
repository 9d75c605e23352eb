"""What has no SQL of its own: repairs, summaries, rotations, statistics by another way."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import cohorts, repair, scoring, statistics, translation


def talk(spark, *turns):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, msg_idx long, role string, text string")


def test_older_summary(spark):
    rows = talk(
        spark, ("user", "Hello, this is Anna from New York City. I like Ikea and Bob."), ("assistant", "1. Sleep well\n2) Eat\n3 Walk [Source: Mayo Clinic] Ask Peter"),
        ("user", "My Plan? I'm Carl"), ("assistant", "- no\n 4. " + "x" * 150), ("user", "Last"), ("assistant", "1. unseen"))
    got = scoring.older_summary(rows, 2).first()
    assert got.user_name == "Anna" and got["items"] == ["Anna", "Carl", "Hello", "Ikea", "Mayo Clinic", "My Plan", "New York City"]
    assert got.advice == ["Sleep well", "Eat", "Walk [Source: Mayo Clinic] Ask Peter", "x" * 100]


def test_rotation(spark):
    got = [r.s for r in spark.range(300).orderBy("id").select(cohorts.rotation(F.col("id"), 7).alias("s")).collect()]
    for k in range(0, 300, 10):
        assert sorted(got[k : k + 10]) == list(range(10))
    assert all(got[i] not in got[i - 2 : i] for i in range(2, 300)) and len({tuple(got[k : k + 10]) for k in range(0, 300, 10)}) > 20


def test_friction(spark):
    rolls = [(1, 0.0), (3, 0.0), (3, 0.2), (3, 0.3), (3, 0.4), (3, 0.9)]
    rows = spark.createDataFrame(rolls, "t long, r double").select(cohorts.friction(F.col("t"), F.col("r")).alias("m"))
    assert [x.m for x in rows.collect()] == ["none", "pushback", "confusion", "tangent", "impatience", "none"]


def test_audit_loop(spark):
    good = f"[Turn: 1] fine\n1. a\n2. b [Source: x]\n{T.TAG}"
    rows = talk(spark, ("user", "q"), ("assistant", good), ("user", "q"), ("assistant", "However, no"), ("user", "q"), ("assistant", "bad"))
    better = lambda some: some.where("msg_idx = 3").withColumn("text", F.lit(f"[Turn: 2] now\n1. a\n2. b [Source: y]\n{T.TAG}"))
    got = {r.msg_idx: r for r in repair.audited(rows, better).collect()}
    assert got[1].text == good and got[1].fixed is None and got[0].fixed is None
    assert got[3].fixed == "rewritten" and got[3].text.startswith("[Turn: 2] now") and got[5].fixed == "forced" and T.TAG in got[5].text and got[5].text.startswith("[Turn: 3]")
    assert {r.msg_idx: r.fixed for r in repair.audited(rows).collect()} == {0: None, 1: None, 2: None, 3: "forced", 4: None, 5: "forced"}


def test_safety_net_and_thoughts(spark):
    rows = talk(spark, *[(r, t) for k in range(5) for r, t in (("user", "q"), ("assistant", f"[Turn: {k + 1}] The key is to rest{k}. However, no."))])
    got = [r.fixed for r in repair.safety_net(rows).orderBy("msg_idx").collect()]
    assert all(T.TAG in t and "[Source:" in t and "owever" not in t and t.startswith(f"[Turn: {k + 1}]") for k, t in enumerate(got))
    assert "Rest2" in got[2] and "key" not in got[2] + got[4]
    two = scoring.thought_and_action(talk(spark, ("assistant", f"<think>append the tag</think>[Turn: 1] ok\n{T.TAG}"), ("assistant", "plain"))).orderBy("turn").collect()
    assert two[0].has_thought and two[0].aware_l1 and two[0].output_ddm == pytest.approx(0.6) and two[0].dissonance < 0 and not two[1].has_thought and two[1].dissonance == 0


def test_quick_check(spark):
    source = f"1. a\n2. b [Source: x] [Source: y]\n{T.TAG}"
    rows = spark.createDataFrame([(source, source), (source, "1. a [Source: x] [Source: y]"), (source, f"a [Source: x]\n{T.TAG}"), ("", "")], "s string, t string")
    assert [x[0] for x in rows.select(translation.quick_check(F.col("s"), F.col("t"))).collect()] == [[], ["FMT_SYS_ACK"], ["FMT_SOURCE", "FMT_BULLETS"], []]


@pytest.mark.parametrize("ties", [3, 1000])
def test_ranks_and_kendall_by_pairs(spark, ties):
    r = random.Random(ties)
    table = [(j, i, float(r.randint(0, ties))) for j in "abc" for i in range(200) if r.random() < 0.9]
    df = spark.createDataFrame(table, "judge string, item int, v double")
    got = {(x.judge, x.item): x.rank_ for x in statistics.ranks(df, "v", ["judge"]).collect()}
    for j in "abc":
        own = [v for k, _, v in table if k == j]
        for k, i, v in table:
            if k == j:
                assert got[j, i] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2
    every = [v for *_, v in table]
    for x in statistics.ranks(df, "v").collect():
        assert x.rank_ == sum(v < x.v for v in every) + (sum(v == x.v for v in every) + 1) / 2
    values = {(j, i): v for j, i, v in table}
    for x in statistics.kendall_tau(df, "judge", "item", "v").collect():
        both = [(values[x.a, i], values[x.b, i]) for i in range(200) if (x.a, i) in values and (x.b, i) in values]
        sign = lambda a, b: (a > b) - (a < b)
        pairs = [(sign(p[0], q[0]), sign(p[1], q[1])) for k, p in enumerate(both) for q in both[:k]]
        n, tx, ty = len(pairs), sum(a == 0 for a, _ in pairs), sum(b == 0 for _, b in pairs)
        assert x["items"] == len(both) and x.discordant == sum(a * b < 0 for a, b in pairs) and x.ties == (tx + ty > 0)
        assert x.tau == pytest.approx(sum(a * b for a, b in pairs) / ((n - tx) * (n - ty)) ** 0.5)


@pytest.mark.parametrize("sides", [2, 4])
def test_chi_square_with_empty_cells(spark, sides):
    rows = [(a, b) for a in range(sides) for b in range(sides) for _ in range((a * 5 + b * 3) % 4 * 3 + (a == b))]
    got = statistics.chi_square(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    n = len(rows)
    e = {(a, b): sum(x == a for x, _ in rows) * sum(y == b for _, y in rows) / n for a in {x for x, _ in rows} for b in {y for _, y in rows}}
    d = {k: abs(rows.count(k) - v) for k, v in e.items()}
    d = {k: v - min(0.5, v) if sides == 2 else v for k, v in d.items()}
    assert got.chi2 == pytest.approx(sum(d[k] ** 2 / e[k] for k in e)) and got.df == (sides - 1) ** 2
