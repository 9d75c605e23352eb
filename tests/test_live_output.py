"""A stream's output goes to shared storage, not to the driver."""

import inspect
import uuid
from types import SimpleNamespace

import pandas as pd

from tideline.plans import stat_queries
from tideline.streaming import live


def test_output_is_written_and_the_last_version_read(spark, tmp_path):
    rows = [(c, t, 1.0 - 0.2 * (t % 3)) for c in range(3) for t in range(1, 8)]
    at = f"{tmp_path}/in"
    for i, part in enumerate(([r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4])):
        spark.createDataFrame(part, "conv_id long, turn long, ddm double").coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema("conv_id long, turn long, ddm double").parquet(at)
        got = live.run_available(live.stream_curves(stream), f"t{uuid.uuid4().hex}", f"{tmp_path}/{i}", "update", ("conv_id",))
        assert {(r.conv_id, r.n) for r in got.collect()} == {(c, 3 if i == 0 else 7) for c in range(3)}
    assert len(got.inputFiles()) > 0 and got.columns == [c.split()[0] for c in live.CURVE.split(", ")]


def test_curves_are_not_written_by_one_task():
    assert "coalesce(1)" not in inspect.getsource(stat_queries.stream_curve_state) and "memory" not in inspect.getsource(live.run_available).split('"""')[2]


class Held:
    """State and timers of one conversation, and how many timers were set."""

    def __init__(self):
        self.rows, self.timers, self.set_timers = [], set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return SimpleNamespace(appendList=self.rows.extend, get=lambda: iter(list(self.rows)), put=lambda rows: self.rows.__setitem__(slice(None), rows), clear=self.rows.clear)

    def getValueState(self, name, schema):  # noqa: N802
        held = []
        return SimpleNamespace(exists=lambda: bool(held), get=lambda: held[0] if held else None, update=lambda x: held.__setitem__(slice(None), [x]), clear=held.clear)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.set_timers += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_a_conversation_has_one_timer():
    """Its replies are numbered at once when the watermark has passed them, not by a call for each; the timer goes to the next that waits."""
    handle, numbering = Held(), live.Numbering()
    numbering.init(handle)
    start = 1_700_000_000_000
    for part in (range(50, 100), range(50), range(100, 150)):
        rows = pd.DataFrame({"at": pd.to_datetime([start + 1000 * i for i in part], unit="ms"), "msg_idx": list(part), "text": [str(i) for i in part]})
        assert sum(len(x) for x in numbering.handleInputRows((7,), iter([rows]), None)) == 0
        assert len(handle.timers) == 1
    assert handle.timers == {start} and handle.set_timers == 2
    got = []
    for passed in (120, 400):
        watermark, calls = start + 1000 * passed, 0
        while due := [t for t in handle.timers if t < watermark]:
            for found in numbering.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: due[0])):
                got += found[["conv_id", "msg_idx", "turn", "text"]].values.tolist()
            handle.deleteTimer(due[0])
            calls += 1
        assert calls == 1 and len(got) == min(passed, 150)
    assert got == [[7, i, i + 1, str(i)] for i in range(150)] and not handle.rows and not handle.timers
