"""Distribution tails against tables, tests against plain formulas, streams against batches."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tests import plain_distributions as D
from tideline.functions import distributions
from tideline.operators import statistics as S
from tideline.streaming.live import advance


def test_tails():
    assert D.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and D.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and D.t_two_sided(0, 5) == pytest.approx(1)
    assert D.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6) and D.f_tail(2.978237, 10, 10) == pytest.approx(0.05, abs=1e-5)
    assert D.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert D.t_two_sided(None, 3) is None and D.t_two_sided(math.inf, 3) == 0 and D.chi2_tail(1.0, 0) is None


def test_column_tails_agree(spark):
    r = random.Random(3)
    sizes = [1, 2, 3, 10, 150, 60_000]
    rows = [(r.choice([0.0, 1e-9, r.random(), r.uniform(1, 4), r.uniform(0, 300)]), r.choice(sizes), r.choice(sizes)) for _ in range(300)] + [(None, 3, 4), (math.inf, 3, 4), (1.0, 0, 4), (1.0, 3, 0)]
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "x double, a long, b long")
    got = df.select(distributions.t_two_sided(x, a), distributions.f_tail(x, a, b), distributions.chi2_tail(x, a), distributions.normal_two_sided(x)).collect()
    for (v, p, q), row in zip(rows, got, strict=True):
        want = (D.t_two_sided(v, p), D.f_tail(v, p, q), D.chi2_tail(v, p), D.normal_two_sided(v)) if v != math.inf else (0.0, 0.0, None, None)
        for w, g in zip(want, row, strict=True):
            assert v == math.inf and w is None or g == (w if w is None else pytest.approx(w, abs=1e-9, rel=1e-7))
    pairs = [(d, n) for n in (2, 3, 5, 12, 33) for d in {0, 1, n, n * (n - 1) // 4, n * (n - 1) // 2} if d <= n * (n - 1) // 2]
    got = spark.createDataFrame(pairs, "d long, n long").select(distributions.kendall_two_sided(F.col("d"), F.col("n"))).collect()
    assert [g[0] for g in got] == [pytest.approx(D.kendall_two_sided(d, n)) for d, n in pairs]


def test_kendall_exact():
    assert D.kendall_two_sided(0, 4) == pytest.approx(2 / 24) and D.kendall_two_sided(3, 4) == 1.0 and D.kendall_two_sided(10, 5) == pytest.approx(2 / 120)


def test_ranks_average_ties(spark):
    got = S.ranks(spark.createDataFrame([(x,) for x in (3, 1, 3, 2, 3)], "v int"), "v").collect()
    assert sorted((r.v, r.rank_) for r in got) == [(1, 1.0), (2, 2.0), (3, 4.0), (3, 4.0), (3, 4.0)]


def test_kruskal(spark):
    rows = [("a", v) for v in (1, 2, 3)] + [("b", v) for v in (4, 5, 6)] + [("c", None)]
    r = S.kruskal(spark.createDataFrame(rows, "g string, v int"), "g", "v").first()
    assert r.h_stat == pytest.approx(12 / (6 * 7) * (36 / 3 + 225 / 3) - 21) and spark.createDataFrame([r]).select(S.p_value("kruskal")).first()[0] == pytest.approx(0.0495, abs=1e-3)


def test_undefined_statistics(spark):
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 1.0, 2.0)], "g string, x double, y double")
    assert flat.agg(S.pearson("x", "y")).first()[0] is None
    assert S.ols(flat.limit(2), "x", "y").first().slope is None
    assert S.kruskal(flat, "g", "x").first().h_stat is None and S.anova(flat, "g", "x").first().f_stat is None
    t = flat.agg(*(c.alias(n) for n, c in S.t_test(flat.x, flat.y > 1).items())).first()
    assert t.t_stat is None


def test_bootstrap_is_repeatable(spark):
    r = random.Random(2)
    rows = [(i, "g", r.random()) for i in range(40)] + [(99, "empty", None)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    a, b = (sorted(map(tuple, S.bootstrap(x, ["g"], "v", "i", 200).collect())) for x in (df, df.repartition(5)))
    assert a == b and a[0] == ("empty", 0, 0.0, 0.0, 0.0) and a[1][3] < a[1][2] < a[1][4]


def test_state_follows_the_batch():
    state = (0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0)
    for t, s in enumerate((1, 0.8, 0.8, 1, 0.6, 0.6, 0.6), 1):
        state = advance(state, t, s)
    n, total, first, last, dop, run, sdop, half, zero, back = state
    assert (n, dop, sdop, half, zero, back, run) == (7, 2, 5, 0, 0, 1, 3) and (total - (first + last) / 2) / (n - 1) == pytest.approx(23 / 30)


def test_values_that_differ_when_computed_again(spark):
    """Means of doubles depend on the order of their sums; ranks must not lose a row by it."""
    shaken = F.udf(lambda x: x + os.urandom(1)[0] * 1e-9, "double").asNondeterministic()
    rows = [(j, i, float((i * (3 if j == "x" else 7)) % 11)) for j in "xyz" for i in range(11)]
    table = spark.createDataFrame(rows, "judge string, item int, m double").select("judge", "item", shaken("m").alias("m"))
    for found in (S.spearman(table, "judge", "item", "m"), S.kendall_tau(table, "judge", "item", "m"), S.kendall_w(table, "judge", "item", "m")):
        assert "<lambda>" not in found._jdf.queryExecution().optimizedPlan().toString()  # the values are read, not made again
    assert [(r.a, r.b, r["items"]) for r in S.spearman(table, "judge", "item", "m").orderBy("a", "b").collect()] == [("x", "y", 11), ("x", "z", 11), ("y", "z", 11)]
    tau = S.kendall_tau(table, "judge", "item", "m").orderBy("a", "b").collect()
    assert [r["items"] for r in tau] == [11] * 3 and tau[2].tau == 1.0
    assert S.kendall_w(table, "judge", "item", "m").first()["items"] == 11
