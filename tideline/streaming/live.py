"""Scores and curve metrics over streams: an addition, as batches need none of it.

Scores of a turn need no state, if the turn is known; else a conversation's replies wait until the watermark has passed them, and
are numbered in the order of their time. A curve's metrics need a little, which grows with nothing: counts, sums, the first and last
score, and the onsets so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tideline.operators.scoring import LEVELS, Scoring, level_scores, weighted

STATE = "n long, total double, first double, last double, dop long, run long, sdop long, half long, zero long, back long"
CURVE = "conv_id long, n long, mean double, auc double, dop long, sdop long, half_life long, collapse long, recoveries long"


def stream_scores(replies: DataFrame, rules: Scoring = Scoring()) -> DataFrame:
    """Scores of a stream of replies (conv_id, turn, text), turn by turn."""
    levels = level_scores(F.col("text"), F.col("turn"), F.lit("en"), rules)
    return replies.select("conv_id", "turn", *(c.alias(n) for n, c in levels.items())).withColumn("ddm", weighted({n: F.col(n) for n in LEVELS}, rules))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "conv_id long, msg_idx long, turn long, text string"


class Numbering(StatefulProcessor):
    """The replies of a conversation that still wait, and how many were numbered. A conversation has one timer, for the first reply that
    waits; when it fires, all replies are numbered that the watermark has passed, so that none before them can come any more, and the
    timer goes to the next one. Replies of one time go by msg_idx."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, msg_idx long, text string")
        self.numbered = handle.getValueState("numbered", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for some in rows:
            at = (some["at"].astype("datetime64[us, UTC]" if some["at"].dt.tz else "datetime64[us]").astype("int64") // 1000).tolist()
            self.waiting.appendList(list(zip(at, some["msg_idx"].tolist(), some["text"].tolist(), strict=True)))
            first.append(min(at))
        self.wait_for(min(first))
        return iter([])

    def wait_for(self, at: int) -> None:
        """The timer fires at this time, or before it if it is set so."""
        now = self.timer.get()
        if now is None or at < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.timer.clear()
        if rest:
            self.wait_for(rest[0][0])
        n = (self.numbered.get() or (0,))[0]
        self.numbered.update((n + len(due),))
        yield pd.DataFrame({"conv_id": [key[0]] * len(due), "msg_idx": [r[1] for r in due], "turn": range(n + 1, n + len(due) + 1), "text": [r[2] for r in due]})

    def close(self) -> None:
        pass


def number_turns(replies: DataFrame, late: str) -> DataFrame:
    """conv_id, msg_idx, turn, text of a stream of replies (conv_id, msg_idx, at, text) that come in any order, at most `late` behind: what
    comes later still is dropped. State is kept by RocksDB, which the session must name as its store (ROCKS)."""
    timed = replies.select("conv_id", "msg_idx", "at", "text").withWatermark("at", late)
    return timed.groupBy("conv_id").transformWithStateInPandas(Numbering(), NUMBERED, "Append", "EventTime")


def advance(state: tuple, turn: int, score: float, k: int = 3) -> tuple:
    n, total, first, last, dop, run, sdop, half, zero, back = state
    first = score if n == 0 else first
    back += dop > 0 and score >= 1
    dop = dop or (turn if score < 1 else 0)
    run = run + 1 if score < 1 else 0
    sdop = sdop or (turn - k + 1 if run == k else 0)
    return n + 1, total + score, first, score, dop, run, sdop, half or (turn if score <= 0.5 else 0), zero or (turn if score == 0 else 0), back


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0)
    for turn, score in pd.concat(batches).sort_values("turn")[["turn", "ddm"]].itertuples(index=False):
        now = advance(now, int(turn), float(score))
    state.update(now)
    n, total, first, last, dop, _, sdop, half, zero, back = now
    auc = total if n == 1 else (total - (first + last) / 2) / (n - 1)
    none = lambda x: x or None
    yield pd.DataFrame([[key[0], n, total / n, auc, none(dop), none(sdop), none(half), none(zero), back]], columns=[c.split()[0] for c in CURVE.split(", ")])


def stream_curves(scores: DataFrame) -> DataFrame:
    """The metrics so far of every curve that a batch touches; turns of a curve must come in order from batch to batch."""
    return scores.groupBy("conv_id").applyInPandasWithState(_update, CURVE, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts and sums of value by window and event_type; late events within the watermark still count."""
    rows = events.withColumn("at", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    window = F.window("at", size, slide) if slide else F.window("at", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Sessions of users parted by a gap: start, end, events."""
    rows = events.withColumn("at", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "n")


def with_rocks(spark, run):
    """run(), in a session that keeps state by RocksDB meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_available(stream: DataFrame, name: str, folder: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream says of all that is there now, as a table beside the checkpoint in folder: every row (append), the
    last batch's (complete), or the last of every key (update). Executors write it; nothing is gathered in the driver."""
    spark, at = stream.sparkSession, f"{folder}-out"
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/batch={batch}")  # a batch that runs again replaces itself

    query = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(at)
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    if mode == "update":
        last = out.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last"))
        return last.select("last.*")
    return out.drop("batch")
