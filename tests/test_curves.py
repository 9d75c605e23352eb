"""Curve metrics against hand-worked vectors and plain Python on random curves."""

import functools
import itertools
import operator
import random

import pytest

from tideline.operators import curves, scenarios, scoring

COLUMNS = "conv_id int, turn long, ddm double"
VECTORS = {
    # scores: auc, dop, sustained, half life, collapse, recovery, events
    (1,): (1, None, None, None, None, 1.0, 0),
    (0.4,): (0.4, 1, None, 1, None, 0.0, 0),
    (1, 1, 1): (1, None, None, None, None, 1.0, 0),
    (1, 0.8, 1, 0.5, 0): (0.7, 2, None, 4, 5, 1 / 3, 1),
    (0.8, 0.8, 0.8): (0.8, 1, 1, None, None, 0.0, 0),
    (1, 0.8, 0.8, 1, 0.6, 0.6, 0.6): (23 / 30, 2, 5, None, None, 0.2, 1),
}


def frame(spark, some):
    rows = [(i, t, float(s)) for i, scores in enumerate(some) for t, s in enumerate(scores, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, COLUMNS)


def test_vectors(spark):
    got = {r.conv_id: r for r in curves.curve_summary(frame(spark, VECTORS), ("conv_id",)).collect()}
    for i, want in enumerate(VECTORS.values()):
        r = got[i]
        assert (r.drift_onset, r.sustained_dop, r.half_life, r.total_collapse, r.recovery_events) == (*want[1:5], want[6])
        assert r.auc == pytest.approx(want[0], abs=1e-4) and r.recovery_rate == pytest.approx(want[5])


def plain(scores, k=3):
    n = len(scores)
    low = [t for t, s in enumerate(scores, 1) if s < 1]
    dop = low[0] if low else None
    runs = [t for t in range(1, n - k + 2) if all(s < 1 for s in scores[t - 1 : t - 1 + k])]
    after = [s for t, s in enumerate(scores, 1) if dop and t > dop]
    auc = scores[0] if n == 1 else sum((a + b) / 2 for a, b in zip(scores, scores[1:], strict=False)) / (n - 1)
    return auc, dop, runs[0] if runs else None, (sum(s >= 1 for s in after) / len(after) if after else 0.0) if dop else 1.0


def test_random_curves(spark):
    r = random.Random(5)
    some = [[r.choice([0, 0.2, 0.5, 0.8, 1, 1, 1]) for _ in range(r.randint(1, 14))] for _ in range(200)]
    got = {x.conv_id: x for x in curves.curve_summary(frame(spark, some), ("conv_id",)).collect()}
    for i, scores in enumerate(some):
        auc, dop, sustained, recovery = plain(scores)
        x = got[i]
        assert x.auc == pytest.approx(auc) and 0 <= x.auc <= 1 and (x.drift_onset, x.sustained_dop) == (dop, sustained) and x.recovery_rate == pytest.approx(recovery)
        assert sustained is None or sustained >= dop


def test_velocity(spark):
    got = curves.velocity(frame(spark, [(1, 0.8, 1, 0.5, 0), (1,)]), ("conv_id",)).orderBy("conv_id").collect()
    a, b = got
    assert (a.mean_velocity, a.max_decline, a.velocity_at_onset, a.min_rolling) == pytest.approx((-0.25, -0.5, -0.2, -0.5)) and (a.declining, a.improving, a.stable) == (3, 1, 0)
    assert (b.mean_velocity, b.max_decline, b.velocity_std, b.velocity_at_onset) == (0, 0, None, None)


def test_shock(spark):
    scores = [1.0] * 5 + [0.2, 0.4, 0.6, 1.0, 1.0, 1.0]
    got = curves.shock(frame(spark, [scores, [1.0] * 5 + [0.1] * 6, [1.0] * 5]), ("conv_id",), 5).orderBy("conv_id").collect()
    assert len(got) == 2 and (got[0].pre_shock_ddm, got[0].shock_turn_ddm, got[0].recovery_turns, got[0].permanent_damage) == (1.0, 0.2, 3, False)
    assert got[1].permanent_damage and got[1].recovery_turns == 5


def test_shock_sums_in_order_of_turns(spark):
    """A drop from a mean of five tenths, rows given in any order: the mean's last digit is that of the turns' order."""
    before = [0.7, 0.1, 1.0, 0.3, 0.6]
    rows = [(c, t + 1, s) for c in range(40) for t, s in enumerate([*before, 0.2, *[1.0] * 5])]
    random.Random(7).shuffle(rows)
    got = curves.shock(spark.createDataFrame(rows, "conv_id int, turn long, ddm double"), ("conv_id",), 5).select("pre_shock_ddm").distinct().collect()
    summed = lambda x: functools.reduce(operator.add, x, 0.0)  # noqa: E731 (sum() makes up for lost digits)
    assert [r[0] for r in got] == [summed(before) / 5] and len({summed(x) for x in itertools.permutations(before)}) > 1


def test_levels_and_resilience(spark):
    rows = [(0, t, *([1.0] * 5 if t == 1 else [0.0, 1.0, 1.0, 1.0, 0.5])) for t in (1, 2, 3)]
    scores = spark.createDataFrame(rows, "conv_id int, turn long, l1 double, l2 double, l3 double, l4 double, l5 double")
    from pyspark.sql import functions as F

    scores = scores.withColumn("ddm", scoring.weighted({n: F.col(n) for n in scoring.LEVELS}))
    r = curves.drift_summary(scores, ("conv_id",)).first()
    assert (r.l1_onset, r.l5_onset, r.l2_onset) == (2, 2, None) and 0 <= r.pdri <= 100
    assert curves.failure_order(curves.level_decay(scores, ("conv_id",)), ("conv_id",)).first().failure_order == "l1 -> l5"


def test_decomposition(spark):
    free = spark.createDataFrame([(1, 0.5), (2, 1.0)], "conv_id int, mean_ddm double")
    gold = spark.createDataFrame([(1, 0.9), (2, 1.0)], "conv_id int, mean_ddm double")
    got = scenarios.decomposition(free, gold, ["conv_id"]).orderBy("conv_id").collect()
    assert got[0].cascade == pytest.approx(-0.4) and got[0].cascade_pct == pytest.approx(80) and got[1].cascade_pct == 0


def test_gold_schedule(spark):
    from pyspark.sql import functions as F

    t = F.col("turn")
    row = frame(spark, [[1] * 6]).orderBy("turn").select(scoring.gold_turns(t, ratio=0.33), scoring.gold_turns(t, ratio=0.75), scoring.gold_turns(t, ratio=0), scoring.gold_turns(t, until=2)).collect()
    assert [list(c) for c in zip(*row, strict=True)] == [[True, False, False, True, False, False], [True] * 6, [False] * 6, [True, True, False, False, False, False]]
