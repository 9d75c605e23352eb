"""Plans, requests, accounts of calls, expansion by name, and the audit's rounds."""

import os
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tideline.functions import external
from tideline.functions import text as T
from tideline.operators import expansion, generation, repair
from tideline.sources.shared import place, stored

PLAN = "conv_id string, num_turns int, arc array<string>, topics array<string>, twists array<struct<turn:int,twist:string>>, callbacks array<int>"


def test_turns_of_a_plan(spark):
    plans = [("a", 12, ["calm", "cross"], ["x", "y"], [(3, "late"), (3, "later")], [0, 11, 40]), ("b", 2, None, [], None, None), ("c", 0, [], [], [], []), ("d", None, [], [], [], [])]
    rows = generation.planned_turns(spark.createDataFrame(plans, PLAN)).orderBy("conv_id", "turn").collect()
    a = [r for r in rows if r.conv_id == "a"]
    assert [r.emotion for r in a] == ["calm"] * 5 + ["cross"] * 7 and [r.topic for r in a] == ["x"] + ["y"] * 11
    assert [r.twist for r in a] == [None] * 3 + ["later"] + [None] * 8 and [r.turn for r in a if r.callback] == [0, 11] and {r.batch for r in a} == {0}
    assert [(r.conv_id, r.emotion, r.topic) for r in rows if r.conv_id != "a"] == [("b", "neutral", "general")] * 2
    assert a[3].spec.startswith("[MSG 4] y | calm | ") and "event: later" in a[3].spec and a[0].spec.endswith("callback") and all(r.mood == "none" for r in a[:3])


def test_wrong_plans_fail_before_they_run(spark):
    bad = spark.createDataFrame([("a", "x", ["y"], ["z"], [], [])], PLAN.replace("num_turns int", "num_turns string"))
    with pytest.raises(AnalysisException, match="whole number"):
        generation.planned_turns(bad)


def test_requests_tell_what_was_said(spark):
    rows = [("c", t, t // 2, f"spec {t}", m) for t, m in enumerate(["Hello " + "x" * 200, "I finally fixed it", None, "The desk is clean", "that plan worked", "So?", None])]
    turns = spark.createDataFrame([*rows, ("d", 0, 0, "spec", None)], "conv_id string, turn int, batch int, spec string, message string").repartition(3)
    got = {(r.conv_id, r.batch): r for r in generation.batch_requests(turns).collect()}
    assert got["c", 0].specs == "spec 0\nspec 1" and got["c", 0].recent == got["c", 0].solved == got["d", 0].recent == ""
    assert got["c", 1].recent == "[MSG 1] Hello " + "x" * 94 + "\n[MSG 2] I finally fixed it" and got["c", 1].solved == "I finally fixed it"
    assert got["c", 3].recent == "[MSG 4] The desk is clean\n[MSG 5] that plan worked\n[MSG 6] So?" and got["c", 3].solved.split("\n") == ["I finally fixed it", "The desk is clean", "that plan worked"]
    assert (got["c", 3].first_turn, got["c", 3].n, len(got)) == (6, 1, 5)


def test_plans_of_one_file_are_dealt_out(spark):
    """Turns are made by expressions, in as many tasks as the session shuffles to, though one task could read all plans."""
    plans = spark.createDataFrame([(str(i), 40, ["calm"], ["x"], [], []) for i in range(64)], PLAN).coalesce(1)
    rows = generation.planned_turns(plans)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    for df in (rows, generation.batch_requests(rows.withColumn("message", F.lit(None).cast("string")))):
        assert "UDTF" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_requests_after_batches_that_say_nothing(spark):
    """The last notes come from as many batches as it takes, and from no more than are told."""
    said = {t: f"I finally fixed {t}" for t in (0, 1, 2, 9, 20, 21, *range(40, 52))}
    rows = [("c", t, t // 2, f"s{t}", said.get(t)) for t in range(60)]
    got = {r.batch: r for r in generation.batch_requests(spark.createDataFrame(rows, "conv_id string, turn int, batch int, spec string, message string").repartition(3)).collect()}
    for batch in range(30):
        before = [t for t in sorted(said) if t < 2 * batch]
        assert got[batch].recent == "\n".join(f"[MSG {t + 1}] {said[t]}" for t in before[-3:]) and got[batch].solved == "\n".join(said[t] for t in before[-10:])


def test_one_client_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: texts

    rows = spark.range(40).select(F.col("id").cast("string").alias("text")).repartition(12)
    assert external.respond(rows, "text", factory).where("response = text").count() == 40
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(workers) == len(set(workers)) >= 1


def test_a_bad_text_costs_only_itself(spark):
    def factory():
        def call(texts):
            if "bad" in texts:
                raise ValueError("down")
            return [external.Reply(t.upper(), 2, 3) for t in texts]

        return call

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}", "a" if i % 2 else "b", "p") for i in range(6)], "id int, text string, agent string, phase string").coalesce(1)
    counted, seen = external.observed(external.respond(rows, "text", factory, attempts=3, wait=0.0), ["a", "b", "none"], ["p", "q"])
    got = {r.id: r for r in stored(counted, place(spark, "t")).collect()}
    assert [r.response for r in got.values() if r.id != 3] == [f"T{i}" for i in (0, 1, 2, 4, 5)] or {r.response for r in got.values()} == {None, "T0", "T1", "T2", "T4", "T5"}
    assert (got[3].response, got[3].error, got[3].retries, got[0].retries) == (None, "ValueError: down", 3, 0)
    assert external.accounts(seen, ["a", "b", "none"], ["p", "q"]) == [("a", "p", 2, 4, 6, 1, 3), ("b", "p", 3, 6, 9, 0, 0)]


def test_fillers_reach_the_target(spark):
    fillers = ("In short, ", "As I said before, ")
    rows = [("A b. C d! E f?", 4), ("A b. C d! E f?", 13), ("alone here", 9), ("", 5), (None, 5), ("a b", 10_000)]
    got = [r.x for r in spark.createDataFrame(rows, "t string, n int").coalesce(1).select(expansion.filled(F.col("t"), F.col("n"), fillers).alias("x")).collect()]
    assert got[0] == rows[0][0] and 13 <= len(got[1].split()) <= 16 and got[1].startswith("A b. ") and got[1].replace("In short, ", "").replace("As I said before, ", "") == rows[1][0]
    assert got[2] == "alone here In short, alone here As I said before, In short, alone here"[: len(got[2])] or got[2].split()[:2] == ["alone", "here"]
    assert 9 <= len(got[2].split()) <= 12 and len(got[3].split()) >= 5 and got[4] is None
    assert got[5].count("In short, ") + got[5].count("As I said before, ") == expansion.MOST


def test_strategies_by_name(spark):
    rows = spark.createDataFrame([(1, "one two", 5), (2, "one two three four five six", 5), (3, "stuck", 5)], "id int, text string, target int")
    grow = lambda: lambda texts: [t if "stuck" in t else t + " more" for t in texts]
    got = {r.id: r for r in expansion.expander("bte", grow)(rows).collect()}
    assert (got[1].expanded, got[1].success) == ("one two more more more", True) and got[2].expanded == rows.collect()[1].text and (got[3].expanded, got[3].success) == ("stuck", False)
    asked = lambda: lambda texts: ["w " * (6 if "one" in t else 3) + t.split(" ")[10][:0] for t in texts]
    got = {r.id: r for r in expansion.expander("cpi", asked, attempts=2, similarity=lambda a, b: F.when(F.length(a) < 6, 0.5).otherwise(0.95))(rows).collect()}
    assert got[1].success and got[1].expanded_words == 6 and got[2].success and not got[3].success and got[3].expanded_words == 3 and got[1].words == 2
    assert {r.strategy for r in expansion.expander("cri")(rows).where("success").collect()} == {"cri"}
    for bad in (("none", grow), ("bte", None)):
        with pytest.raises(ValueError):
            expansion.expander(*bad)


def test_failed_calls_keep_the_text(spark):
    def broken():
        def call(texts):
            raise OSError("down")

        return call

    got = expansion.expander("bte", broken, rounds=2)(spark.createDataFrame([("one two", 5)], "text string, target int")).first()
    assert (got.expanded, got.success) == ("one two", False)


def test_audit_reads_only_what_still_fails(spark):
    good = f"[Turn: {{}}] fine\n1. a\n2. b [Source: x]\n{T.TAG}"
    said = [good.format(1), f"[Turn: 2] However\n1. a\n2. b [Source: x]\n{T.TAG}", "However", "bad"]
    rows = spark.createDataFrame([(1, 2 * k + j, r, t) for k, text in enumerate(said) for j, (r, t) in enumerate((("user", "q"), ("assistant", text)))], "conv_id long, msg_idx long, role string, text string")
    seen = []

    def rewrite(left):
        seen.append(sorted(r.msg_idx for r in left.collect()))
        return left.withColumn("text", F.when(F.col("text").contains("However"), F.regexp_replace("text", "However", "Still")).otherwise(F.format_string(good.replace("{}", "%d"), "turn")))

    got = {r.msg_idx: r for r in repair.audited(rows, rewrite, 5).collect()}
    assert seen == [[3, 5, 7], [5]] and [(got[i].fixed, got[i].fixed_round) for i in (1, 3, 5, 7)] == [(None, None), ("rewritten", 1), ("rewritten", 2), ("rewritten", 1)]
    plans = [repair.audited(rows, rewrite, n)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (1, 5)]
    assert plans[0] == plans[1]  # the plan does not grow with the rounds
    assert [r.fixed for r in repair.audited(rows, force=False).where("role = 'assistant'").collect()] == [None] * 4
