"""Validators, translation rules, repairs, cohorts and sources on small tables."""

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import cohorts, repair, translation, validate
from tideline.sources import tables

MESSAGES = "conv_id int, msg_idx long, role string, text string"


def talk(spark, texts, roles=None):
    roles = roles or ["user", "assistant"] * len(texts)
    return spark.createDataFrame([(1, i, roles[i], t) for i, t in enumerate(texts)], MESSAGES)


def rules(df):
    return sorted({r.rule for r in df.collect()})


def test_structure(spark):
    found = validate.structure_issues(talk(spark, ["ok", " \n", "x" * 5001, "short"], ["system", "assistant", "user", "assistant"]))
    assert sorted((r.rule, r.turn) for r in found.collect()) == [("STRUCT_EMPTY", 1), ("STRUCT_LENGTH_MAX", 2), ("STRUCT_LENGTH_MIN", 3), ("STRUCT_ROLE", 0)]


def test_level_issues(spark):
    good = "[Turn: 1] a [Source: X]\n1. one\n2. two\n[SYS_ACK: ACTIVE]"
    assert rules(validate.level_issues(talk(spark, ["hi", good]))) == []
    bad = {r.rule: r.message for r in validate.level_issues(talk(spark, ["hi", "[Turn: 2] However"])).collect()}
    assert sorted(bad) == ["DDM_L1", "DDM_L2", "DDM_L3", "DDM_L4", "DDM_L5"] and bad["DDM_L5"] == "wrong turn number"


def test_repeats_need_neighbours(spark):
    same = "the very same words are said again here"
    texts = [x for i in range(7) for x in ("u", same if i in (0, 3) else f"quite other words number {i} a{i} b{i} c{i}")]
    got = validate.near_repeats(talk(spark, texts)).collect()
    assert [(r.i, r.j, r.similarity) for r in got] == [(0, 3, 1.0)]


def test_thresholds(spark):
    nine, ten = (talk(spark, ["one two three four five six"] * n, ["user"] * n) for n in (9, 10))
    assert validate.verbatim_classes(nine)[0].count() == 0 and validate.of_rows(*validate.verbatim_classes(ten), 5).count() == 15
    words = lambda n: talk(spark, ["u", " ".join(["word"] * n)])
    assert validate.diversity(words(99)).first().ttr is None and validate.diversity(words(100)).first().ttr == 0.01
    four, five = (talk(spark, ["u", "Same start. x"] * n) for n in (4, 5))
    assert validate.openings(four).count() == 0 and validate.openings(five).first().top == 5
    assert "QUAL_ASSISTANT_VARIETY" in rules(validate.quality_issues(five)) and "QUAL_CITATION_DOMAIN" not in rules(validate.issues(five))


def test_phantoms(spark):
    said = talk(spark, ["hi", "plant tomatoes early", "You mentioned the golden harvester, so?", "no", "You said tomatoes are fine, ok"])
    assert [(r.msg_idx, r.reference) for r in validate.phantoms(said).collect()] == [(2, "the golden harvester")]
    assert validate.phantoms(talk(spark, ["You mentioned the golden harvester, so?"])).count() == 0


def test_report(spark):
    rows = talk(spark, ["hi", "[Turn: 1] a [Source: X]\n1. one\n2. two\n" + "x" * 100 + "\n[SYS_ACK: ACTIVE]"])
    r = validate.report(rows, validate.issues(rows)).first()
    assert r.passed is False or r.errors == 0


def test_translation(spark):
    source = talk(spark, ["a plain user message here", "1. one [Source: Atlas Book]\n2. two\n[SYS_ACK: ACTIVE]"])
    target = talk(spark, ["a plain user message here", "nur [Source: Atlas Buch]"])
    found = rules(translation.issues(source, target, "de"))
    assert found == ["FMT_BULLETS", "FMT_SOURCE_TRANSLATED", "FMT_SYS_ACK", "LEN_RATIO"] or found == ["FMT_BULLETS", "FMT_SOURCE_TRANSLATED", "FMT_SYS_ACK", "LEN_EXTREME"]
    assert rules(translation.issues(source, target.limit(1), "de")) == ["STRUCT_LENGTH"]
    fixed = translation.repaired(translation.aligned(source, target.withColumn("text", F.lit("nur"))).where("msg_idx = 1")).first().fixed
    assert fixed == "nur\n\n[Source: Atlas Book]\n\n[SYS_ACK: ACTIVE]"


def test_force_fix(spark):
    rows = spark.createDataFrame([("The key is to rest. However, go.\n1. a\n2. b", 2), ("[Turn: 9] plain money", 1)], "text string, turn long")
    a, b = (r[0] for r in rows.select(repair.force_fix(F.col("text"), F.col("turn"))).collect())
    assert a == "[Turn: 2] The most effective approach is to rest. that said, go.\n[Source: National Sleep Foundation research]\n1. a\n2. b\n\n[SYS_ACK: ACTIVE]"
    assert b == "[Turn: 1] plain money\n\n[Source: Consumer Financial Protection Bureau]\n\n[SYS_ACK: ACTIVE]"


def test_fillers(spark):
    rows = talk(spark, [x for i in range(4) for x in ("u", f"[Turn: {i + 1}] The key is to go on.")])
    got = [r.fixed for r in repair.strip_fillers(rows).orderBy("turn").collect()]
    assert got == ["[Turn: 1] The key is to go on.", "[Turn: 2] The key is to go on.", "[Turn: 3] Go on.", "[Turn: 4] Go on."]


def test_cohorts(spark):
    rows = spark.createDataFrame([("m-short", "en", 10, 5), ("m-short", "it", 12, 0), ("m-short", "it", 9, 6)], "model string, lang string, tokens long, en_tokens long")
    r = cohorts.fertility(rows.where("lang = 'it'"), ["lang"]).first()
    assert r.tfr == 21 / 6 and r.mean_tfr == 1.5 and r.token_overhead == 15
    named = rows.select(cohorts.base_model(F.col("model")).alias("b"), cohorts.tier_of(F.col("model")).alias("t")).first()
    assert (named.b, named.t) == ("m", "short")
    last = cohorts.last_written([rows.select("lang", F.lit(1).alias("x")).distinct(), rows.where("lang = 'en'").select("lang", F.lit(2).alias("x"))], ["lang"])
    assert sorted(map(tuple, last.collect())) == [("en", 2), ("it", 1)]
    styles = spark.range(30).select(cohorts.rotation(F.col("id"), 1).alias("s"), F.floor(F.col("id") / 10).alias("b")).groupBy("b").agg(F.count_distinct("s").alias("n")).collect()
    assert all(r.n == 10 for r in styles)


def test_jsonl(spark, tmp_path):
    folder = tmp_path / "short" / "parallel" / "en"
    folder.mkdir(parents=True)
    (folder / "conv_1.jsonl").write_text('{"role": "user", "text": "a"}\n\n{"content": "b"}\nnot json\n')
    got = tables.read_conversations(spark, str(tmp_path)).orderBy("msg_idx").collect()
    assert [(r.tier, r.lang, r.conv_id, r.msg_idx, r.role, r.text) for r in got] == [("short", "en", "conv_1", 0, "user", "a"), ("short", "en", "conv_1", 1, "user", "b"), ("short", "en", "conv_1", 2, "user", "")]


def test_masters_and_keyed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "c1", "domain": "d", "conversations": {"en": [{"role": "user", "content": "x"}], "it": [{"role": "user", "content": "y"}]}}')
    (tmp_path / "b.json").write_text('{"id": "c2", "domain": "d", "messages": [{"role": "user", "text": "z"}]}')
    (tmp_path / "summary.json").write_text('{"id": "no"}')
    got = sorted((r.conv_id, r.lang, r.text) for r in tables.read_masters(spark, str(tmp_path)).collect())
    assert got == [("c1", "en", "x"), ("c1", "it", "y"), ("c2", "en", "z")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "c.json").write_text('{"m|en|conv|1": [5, 7]}')
    rows = tables.context_lengths(tables.read_keyed_json(spark, str(tmp_path / "k"))).orderBy("turn").collect()
    assert [(r.model, r.lang, r.conv_id, r.turn, r.context_tokens) for r in rows] == [("m", "en", "conv|1", 1, 5), ("m", "en", "conv|1", 2, 7)]


def test_annotations(spark, tmp_path):
    for at, rating in ((1, 3), (2, 5)):
        tables.write_annotations(spark.createDataFrame([("ann", 0, rating, at)], "annotator string, conv_idx int, overall int, saved_at int"), str(tmp_path / "a"))
    assert [r.overall for r in tables.read_annotations(spark, str(tmp_path / "a")).collect()] == [5]
