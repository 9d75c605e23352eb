"""The fences of the quality rules follow the sources: all four signals, copies, small groups."""

import random

import pytest

from tests.llm.test_operators import DOCS, words
from tideline.llm import quality_rules


def text(seed, size, long=0.0, symbols=0.0, lines=0, repeats=0):
    r = random.Random(seed)
    held = words(size, seed, 5000).split()
    held = [w + "ation" if r.random() < long else w for w in held]
    held = [w + "#" if r.random() < symbols else w for w in held]
    own = [" ".join(held[i : i + 12]) for i in range(0, len(held), 12)]
    own += [" ".join(held[:12])] * lines
    return "\n".join(own) + "\n" + " ".join(held[20 : 24 + repeats] * (2 if repeats else 0))


#: A signal, what gives much of it, and a plain text's.
NOISES = {"word_length": {"long": 0.9}, "symbol_ratio": {"symbols": 0.3}, "dup_line_ratio": {"lines": 8}, "repeat_ratio": {"repeats": 25}}


@pytest.fixture(scope="module")
def sources(spark):
    """A quiet source, and for each signal a source an eighth of whose texts are noisy (of word lengths all)."""
    rows, n = [], 0
    for source, noise in (("quiet", {}), *NOISES.items()):
        for i in range(1500 if source == "quiet" else 700):
            noisy = noise if i % 8 == 0 or source == "word_length" else {}
            rows.append((n, text(n, 200 + i % 90, **noisy), "en", source, 0))
            n += 1
    for source in ("quiet", *NOISES):
        for signal, noise in NOISES.items():
            rows.append((n, text(n, 240, **noise), "en", source, {"quiet": 1}.get(source, 2 if source == signal else 3)))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_noise_is_judged_by_its_source(spark, sources):
    got = quality_rules.judged(sources, ["doc_id", "source", "n_chars"]).collect()
    by = {kind: [x for x in got if x.n_chars == kind] for kind in (0, 1, 2)}
    assert not any(x.base_failed for x in got)
    assert sum(not x.kept for x in by[0]) <= len(by[0]) // 200
    assert len(by[1]) == 4 and not any(x.kept for x in by[1])  # noise in the quiet source
    assert len(by[2]) == 4 and all(x.kept for x in by[2])  # the same noise in a source that is used to it


def test_fences_differ_between_sources(spark, sources):
    found = quality_rules.signals(sources).selectExpr("own.lang as key_lang", "own.source as key_source", "own.doc_id as key_text", *quality_rules.COUNTS, "n_lines_")
    at = {x.of_source: x for x in quality_rules.fences(found).collect()}
    for signal in NOISES:
        assert at[signal][f"{signal}_max"] > at["quiet"][f"{signal}_max"] + 0.05, signal


def test_copies_count_once(spark):
    """A text that fills nine tenths of a source does not narrow its fences; one without a source or in one alone is no outlier."""
    same = words(120, 1, 5000)
    rows = [(i, same, "en", "hot", 0) for i in range(3000)] + [(5000 + i, words(60 + i % 200, 50 + i, 5000), "en", "hot", 0) for i in range(300)]
    rows += [(9000, words(90, 7777, 5000), "en", "alone", 0), (9001, words(90, 7778, 5000), None, None, 0)]
    got = quality_rules.judged(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()
    assert len(got) == 3302 and all(x.kept for x in got)
