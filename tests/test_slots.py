"""External calls, SQL functions, command line."""

import json

import pytest

from tideline.__main__ import main
from tideline.functions import external, sql


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT tag_score('x [SYS_ACK: ACTIVE]'), tag_score('x'), bullet_score('1. a', 2), forbidden_score('However'), counter_score('[Turn: 3] x', 3), counter_score(NULL, 1)").first()
    assert tuple(row) == (1.0, 0.0, 0.5, 0.0, 1.0, 0.0)


def test_external_call_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    got = external.respond(rows, "text", lambda: lambda texts: [t.upper() for t in texts]).orderBy("id").collect()
    assert [(r.id, r.response, r.error) for r in got] == [(1, "A", None), (2, "", None)]

    def broken():
        def call(texts):
            raise ValueError("down")

        return call

    assert [r.error for r in external.respond(rows, "text", broken).collect()] == ["ValueError: down"] * 2


def test_retries():
    waits, left = [], [2]

    def call(texts):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return texts

    assert external.with_retries(call, sleep=waits.append)(["x"]) == ["x"] and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        external.with_retries(lambda t: (_ for _ in ()).throw(OSError()), sleep=waits.append)(["x"])


def test_command_line(spark, capsys):
    assert main(["list"]) == 0 and "drift_summary" in capsys.readouterr().out
    assert main(["run", "no_such", "x"]) == 2 and main(["sample"]) == 0


def test_verbs_over_conversations(spark, tmp_path):
    rows = [("short", lang, c, i, r, f"[Turn: {i // 2 + 1}] say {lang} {c} {i} twice over" if r == "assistant" else f"ask {c} {i}") for lang in ("en", "it") for c in (1, 2, 3) for i, r in enumerate(("user", "assistant") * 3)]
    table = spark.createDataFrame(rows, "tier string, lang string, conv_id long, msg_idx long, role string, text string")
    for lang in ("en", "it"):
        for c in (1, 2, 3):
            folder = tmp_path / "in" / "short" / "parallel" / lang
            folder.mkdir(parents=True, exist_ok=True)
            said = [r for r in rows if r[1] == lang and r[2] == c]
            (folder / f"conv_{c:04d}.jsonl").write_text("".join(json.dumps({"role": r[4], "content": r[5]}) + "\n" for r in said))
    place = [f"file://{tmp_path}/in/*/parallel/*/*.jsonl", f"file://{tmp_path}/out"]
    assert main(["drift", *place]) == 0 and spark.read.parquet(f"{place[1]}/turns").count() == 18 and spark.read.parquet(f"{place[1]}/summary").count() == 6
    assert main(["drift", *place, "--dry-run", "--langs", "it"]) == 0 and spark.read.parquet(f"{place[1]}/summary").count() == 2
    assert main(["validate", *place, "--max-convs", "1"]) == 0 and spark.read.parquet(f"{place[1]}/report").count() == 2
    assert main(["fertility", *place]) == 0 and [(r.lang, r.tfr) for r in spark.read.parquet(f"{place[1]}/fertility").collect()] == [("it", 1.0)]
    assert main(["expand", *place]) == 0 and spark.read.parquet(f"{place[1]}/expanded").count() == table.count()
    assert main(["study", *place, "--phases", "order", "summary"]) == 0 and main(["study", *place, "--phases", "tiers"]) == 0
    assert spark.read.parquet(f"{place[1]}/study/summary").count() == 6 and spark.read.parquet(f"{place[1]}/study/order").count() == 6
    assert main(["drift", place[0]]) == 2
