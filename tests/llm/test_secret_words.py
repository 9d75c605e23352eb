"""Words of the documents are no secrets, and long values are costed whole."""

import random
import time

from tests.llm.test_operators import docs
from tideline.llm import secret_scan


def test_words_of_the_documents_are_known(spark):
    texts = ["the secret is understanding", "password is automatically reset", "understanding comes automatically", "passphrase is xkqzjwvbnmtr", "password: Tr0ub4dor&3zQ!x"]
    got = {x.doc_id: x for x in secret_scan.scan(docs(spark, texts)).collect()}
    assert [got[i].n_guess for i in range(5)] == [0, 0, 0, 1, 1]
    clean = {x.doc_id: x.text for x in secret_scan.redact(docs(spark, texts)).collect()}
    assert all(clean[i] == texts[i] for i in range(3)) and clean[3] == "passphrase is [REDACTED]"


def test_long_values_are_costed_whole():
    cost = secret_scan.log_guesses
    r = random.Random(1)
    assert cost("abc" * 50) < 6 and cost("x" * 5000) < 6 and cost("password" * 40) < 10
    assert cost("".join(r.choice("ab") for _ in range(140))) >= 10
    start = time.monotonic()
    cost("ab" * 10_000), cost("qw" * 10_000), cost("".join(r.choice("abcdef09") for _ in range(20_000)))
    assert time.monotonic() - start < 60


def test_a_value_of_a_megabyte_goes_in_slices():
    import pyarrow as pa

    value = "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([value])], names=["name", "value"])
    sizes, words = [], set()
    for out in secret_scan._wanted([batch]):
        sizes.append(out.num_rows)
        words.update(out.column(1).to_pylist())
    assert max(sizes) < secret_scan.WANTED + secret_scan.LONGEST_WORD and words == {value[i:j] for i in range(len(value)) for j in range(i + 3, min(len(value), i + secret_scan.LONGEST_WORD) + 1)}
    assert "".join(set(batch.column(1)[0].as_py())) and sum(sizes) < 64 * len(value)


def test_a_long_value_in_spark(spark):
    value = "".join(random.Random(4).choice("abcdefghijklmnop") for _ in range(100_000))
    got = secret_scan.scan(docs(spark, [f"token: {value}!", "plain words stay"])).collect()
    assert [r.spans for r in sorted(got, key=lambda r: r.doc_id)][1] == "" and got[0].doc_id in (0, 1)
