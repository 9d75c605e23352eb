"""The URL models grow with their URLs, and contexts stay apart."""

import random

from tideline.llm import common, url_filter


def test_every_context_has_its_own_count(spark):
    urls = [f"http://h{i * 7919 % 100_003}.net/{i * 104_729 % 1_000_003}/{i:x}" for i in range(20_000)]
    model = url_filter.fit(spark.createDataFrame([(u, i % 2 == 0) for i, u in enumerate(urls)], "url string, blocked boolean"))
    want = {(k, max(0, k - i), u[max(0, i - k) : i]) for u in urls for i in range(len(u)) for k in range(url_filter.ORDER + 1)}
    grams = {(u[max(0, i - k) : i + 1], k, max(0, k - i)) for u in urls for i in range(len(u)) for k in range(url_filter.ORDER + 1)}
    assert model.count() == len(want)
    assert model.selectExpr("sum(size(hits)) as n").first().n == len(grams)
    assert model.where("context = 0").first().allow == sum(len(u) for u in urls[1::2])


def test_context_never_seen_leaves_the_estimate(spark):
    model = url_filter.fit(spark.createDataFrame([("ab", False), ("ab", True)], "url string, blocked boolean"))
    assert list(url_filter.log_ratio([b"zzzz", b"ab", b""], model)) == [0.0, 0.0, 0.0]


def test_threshold_against_every_cut(spark):
    """The calibrated cut has as few balanced errors as any cut between scores."""
    r = random.Random(3)
    rows = [(r.gauss(1.5 if good else -0.5, 1.0), not good) for good in (r.random() < 0.3 for _ in range(800))]
    cut = url_filter.threshold(spark.createDataFrame(rows, "score double, blocked boolean"))

    def wrong(at):
        lost = [s < at for s, blocked in rows if not blocked]
        let = [s >= at for s, blocked in rows if blocked]
        return sum(lost) / len(lost) + sum(let) / len(let)

    assert wrong(cut) <= min(wrong(s) for s, _ in rows) + 0.02
    assert url_filter.threshold(spark.createDataFrame([(1.0, True)], "score double, blocked boolean")) == 0.0


def test_verdicts_follow_the_threshold(spark):
    """Undecided URLs: allowed from the cut on; very long URLs and clashing names."""
    rows = [(i, f"http://good{i}.org/story/{i}/reading") for i in range(60)] + [(100 + i, f"http://casino{i}.com/de/win{i}/bonus") for i in range(60)]
    rows += [(200, "http://good77.net/story/77/reading"), (201, "http://casino77.net/de/win77/bonus"), (202, "http://x.net/" + "a" * 50_000)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as context", "2 as gram", "3 as times", "4 as rule", "5 as url_key")
    got = {x.page_id: x for x in url_filter.judge(table).collect()}
    assert len(got) == len(rows) and got[200].rule is None and got[200].verdict == "allow" and got[201].verdict == "block" and got[202].verdict in ("allow", "block")
    assert got[200].score > got[201].score


def test_shuffled_as_broadcast(spark, monkeypatch):
    """Sides beyond BROADCAST_ROWS are shuffled, contexts of no and one character never; scores are the same to the last bit."""
    rows = [(i, f"http://good{i}.org/story/{i % 7}/reading") for i in range(80)] + [(100 + i, f"http://casino{i}.com/de/win{i}/bonus") for i in range(80)] + [(300 + i, f"http://other{i}.net/{'win' if i % 2 else 'story'}/{i}") for i in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string")
    result = lambda: sorted((x.page_id, x.score, x.verdict) for x in url_filter.judge(table).collect())
    whole = result()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert result() == whole
    model = url_filter.fit(spark.createDataFrame([(u, i < 80) for i, u in rows], "url string, blocked boolean"))
    some = spark.createDataFrame([(1,), (2,)], "gram long")
    plan = url_filter._ratios(some, model, 2.0)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
