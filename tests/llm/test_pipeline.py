"""The pipeline's stages, one after the other, against a plain version of each."""

import hashlib

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import DOCS, brute_contamination, brute_quality, words
from tideline.llm import secret_scan


def test_stages(spark, sf):
    kept = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        out[name] = {r.doc_id: r for r in rows}
        assert len(out[name]) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "mix":
            assert docs.columns == columns

    def fails(text):
        n, _, _, _, repeats = brute_quality(text)
        return n < 50 or 100 * repeats > 50 * n

    good = out["quality"]
    assert good and not any(fails(r.text) for r in good.values())
    assert all(r.text.count("&&&") + r.text.count("%%%") < 5 for r in good.values())
    assert set(out["near_duplicates"]) == brute_kept([(i, good[i].text) for i in sorted(good)])
    clean = {i for i, r in out["near_duplicates"].items() if not brute_contamination(r.text, items)[1]}
    assert set(out["decontamination"]) == clean and all(out["decontamination"][i].text == kept[i].text for i in clean)
    for i, r in out["secrets"].items():
        assert r.text == secret_scan.masked(kept[i].text) and r.n_chars == (len(r.text) if r.text != kept[i].text else kept[i].n_chars)
    assert set(out["secrets"]) == clean
    assert set(out["mix"]) <= clean and all(r.taken in (r.size, 2 * r.size) for r in out["mix"].values())
    assert hashlib.md5(str(sorted(out["mix"])).encode()).hexdigest()
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out["mix"].values())


def test_edges(spark, sf):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an empty table, clashing names."""
    long, a, b, c = words(20_000, 5), words(90, 1), words(90, 2), words(90, 3)
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", "a", 3), (3, long, "en", "a", len(long)), (3, long, "en", "a", len(long)), (4, a, None, None, None), (5, a, "fr", "b", 1),
        (6, b, "en", "b", 2), (6, c, "en", "b", 2), (None, words(90, 4), "en", None, 9), (None, words(90, 6), "de", "b", 9), (7, words(60, 8) + " password: x9#Kq2!vLm7@ " + words(20, 9), "en", "a", 5), (8, "é " * 700, "fr", "b", 7),
    ]
    names = {"size": 1, "key": 2, "mark": 3, "gram": 4, "unit": 5, "hard": 6, "id": 7, "own": 8, "kept": 9, "n_words": 10, "print": 11, "words": 12}
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"{v} as {k}" for k, v in names.items()))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs.limit(0), sf).schema)
        if name != "mix":
            assert docs.columns == columns
    got = docs.collect()
    texts = [x.text for x in got]
    assert len(texts) == len(set(texts)) and set(texts) <= {long, a, b, c, words(90, 4), words(90, 6), words(60, 8) + " password: [REDACTED] " + words(20, 9)}
    assert {x.doc_id for x in got if x.text == a} <= {4} and all(x.gram == 4 and x.taken in (x.size, 2 * x.size) for x in got)
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
