"""Phases in the order of their needs, kept by a second run; shards merged; late replies of a stream."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tideline.operators import scoring, study
from tideline.streaming import live


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(f"m{c % 2}", ("short", "medium")[c % 2], lang, c, i, role, f"[Turn: {i // 2 + 1}] word {lang * (c % 3)} {i}") for lang in ("en", "it", "de") for c in range(6) for i, role in enumerate(("user", "assistant") * 3)]
    return spark.createDataFrame(rows, "model string, tier string, lang string, conv_id long, msg_idx long, role string, text string")


def test_order_of_phases():
    order = study.in_order()
    assert sorted(order) == sorted(study.PHASES) and all(order.index(n) < order.index(k) for k, p in study.PHASES.items() for n in p.needs if n != "messages")
    assert study.in_order(["tiers", "order"]) == ["turns", "summary", "tiers", "decay", "order"] == study.in_order(["order", "tiers"])
    with pytest.raises(ValueError, match="no such"):
        study.in_order(["nothing"])
    with pytest.raises(ValueError, match="each other"):
        study.in_order(phases={"a": study.Phase(("b",), None), "b": study.Phase(("a",), None)})


def test_scored_once_and_resumed(spark, messages, tmp_path):
    out = f"file://{tmp_path}/study"
    seen = spark.sparkContext.accumulator(0)

    def once(x):
        seen.add(1)
        return x

    counted = messages.withColumn("text", F.udf(once, "string").asNondeterministic()("text"))
    phases = {k: study.PHASES[k] for k in ("turns", "summary", "decay", "velocity", "groups", "tiers", "order")}
    assert study.run(counted, out, ["summary"], phases) == [("turns", "ran"), ("summary", "ran")]
    assert study.run(counted, out, None, phases) == [(k, "kept" if k in ("turns", "summary") else "ran") for k in study.in_order(None, phases)]
    assert set(study.run(counted, out, None, phases)) == {(k, "kept") for k in phases} and seen.value == messages.count()
    (tmp_path / "study" / "order" / "_SUCCESS").unlink()  # a phase that was left in part
    assert dict(study.run(counted, out, None, phases))["order"] == "ran" and seen.value == messages.count()


def test_shards_are_the_whole(spark, messages, tmp_path):
    out = f"file://{tmp_path}/shards"
    assert study.score_shard(messages, out, 0, 2) and not study.score_shard(messages, out, 0, 2)
    with pytest.raises(ValueError, match=r"\[1\]"):
        study.merge_shards(spark, out, 2)
    study.score_shard(messages, out, 1, 2)
    manifest = study.merge_shards(spark, out, 2).collect()
    assert sum(r.curves for r in manifest) == 18 and sum(r.turns for r in manifest) == 54
    assert study.run(messages, out, ["summary"]) == [("turns", "kept"), ("summary", "ran")]
    want = scoring.score_turns(messages, study.KEY)
    assert sorted(map(str, spark.read.parquet(f"{out}/turns").select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_late_replies_are_numbered_in_their_order(spark, tmp_path):
    day = lambda d: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=d)
    batches = [[(1, 3, day(3)), (2, 1, day(1))], [(1, 1, day(1)), (1, 2, day(1)), (2, 9, day(9))], [(1, 4, day(4)), (9, 0, day(60))], [(9, 2, day(61))], [(1, 0, day(0)), (9, 1, day(300))]]
    at = f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame([(c, i, t, f"{c}-{i}") for c, i, t in rows], "conv_id long, msg_idx long, at timestamp, text string").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("conv_id long, msg_idx long, at timestamp, text string").option("maxFilesPerTrigger", 1).parquet(at)
    got = live.with_rocks(spark, lambda: live.run_available(live.number_turns(stream, "10 days"), f"n{uuid.uuid4().hex}", f"{tmp_path}/state"))
    rows = sorted((r.conv_id, r.turn, r.text) for r in got.where("conv_id < 9").collect())
    assert rows == [(1, 1, "1-1"), (1, 2, "1-2"), (1, 3, "1-3"), (1, 4, "1-4"), (2, 1, "2-1"), (2, 2, "2-9")]  # 1-0 came after the watermark
