"""Bootstraps over blocks of values."""

import inspect

import numpy as np
import pytest

from tideline.operators import statistics as S
from tideline.plans import stat_queries


def test_registered_resamples():
    assert "resamples=10_000" in inspect.getsource(stat_queries.bootstrap_ci)


def test_blocks_give_the_interval_of_the_whole(spark, monkeypatch):
    r = np.random.RandomState(7)
    rows = [("a", i, float(v)) for i, v in enumerate(r.exponential(1, 2000))] + [(None, 1, None), ("c", 1, 3.0)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    whole = {x.g: x for x in S.bootstrap(df, ["g"], "v", "i", 2000).collect()}
    monkeypatch.setattr(S, "BLOCK", 300)
    parts = {x.g: x for x in S.bootstrap(df, ["g"], "v", "i", 2000).collect()}
    assert parts == {x.g: x for x in S.bootstrap(df.repartition(3), ["g"], "v", "i", 2000).collect()}
    for x in (whole, parts):
        assert x["a"].n == 2000 and tuple(x[None])[1:] == (0, 0.0, 0.0, 0.0) and tuple(x["c"])[1:] == (1, 3.0, 3.0, 3.0)
    assert parts["a"].lower == pytest.approx(whole["a"].lower, abs=0.006) and parts["a"].upper == pytest.approx(whole["a"].upper, abs=0.006)


def test_shares_of_blocks_add_up():
    sizes = [5, 1, 9, 3, 2]
    shares = np.array([S.block_shares(sizes, b, 4000, 42) for b in range(5)])
    assert (shares.sum(axis=0) == 20).all() and np.abs(shares.mean(axis=1) - sizes).max() < 0.2


def test_counted_draws_are_even():
    values = np.eye(7)[3]  # counts how often the fourth value is drawn
    got = S.counted_sums(values, np.full(5000, 7), 0, 42)
    assert abs(got.mean() - 1) < 0.05 and abs(got.var() - 6 / 7) < 0.06 and (S.counted_sums(values, np.full(5000, 7), 1, 42) != got).any()
    two = [S.counted_sums(np.eye(7)[k], np.full(5000, 7), 0, 42) for k in range(7)]
    assert (np.sum(two, axis=0) == 7).all()  # every draw takes one value


def test_pieces_of_draws_agree(monkeypatch):
    values, draws = np.arange(50.0), np.arange(30)
    whole = S.counted_sums(values, draws, 2, 1)
    monkeypatch.setattr(S, "DRAWS", 7)
    assert S.counted_sums(values, draws, 2, 1).tolist() == whole.tolist()
