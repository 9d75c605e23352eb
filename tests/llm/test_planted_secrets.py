"""Secret scans: base spans and guess costs against other ways, planted credentials, ordinary prose."""

import itertools
import math
import random
import re

import pytest

from tests.llm.test_operators import docs, words
from tideline.llm import secret_scan

PROSE = [
    "The secret is determination and little else.", "password is documented. See the manual.", "The secret is international cooperation", "the secret is understanding", "password is automatically reset",
    "Your token: required for admission", "passphrase is documented",
]
PLANTED = ["x9#Kq2!vLm7@", "Tr0ub4dor&3zQ!x", "gH7$kP2!nB5^wR", "Zx8-qW3-pL6-vT1", "b7Qp!zRk93#x"]


def test_prose_stays_and_planted_credentials_go(spark):
    filler = ["determination documented international cooperation understanding automatically reset required admission manual little else " * 3 + words(40, i) for i in range(30)]
    texts = PROSE + [f"{words(20, i)} password: {s} {words(9, i)}" for i, s in enumerate(PLANTED)] + filler
    table = docs(spark, texts)
    got = {x.doc_id: x for x in secret_scan.scan(table).collect()}
    assert [got[i].spans for i in range(len(PROSE))] == [""] * len(PROSE)
    for k, s in enumerate(PLANTED):
        i = len(PROSE) + k
        assert any(texts[i][slice(*map(int, x.split(":")[1:]))] in (s, f"password: {s}") for x in got[i].spans.split(",") if x), got[i]
    clean = {x.doc_id: x.text for x in secret_scan.redact(table).collect()}
    assert all(clean[i] == t for i, t in enumerate(PROSE)) and not any(s in clean[len(PROSE) + k] for k, s in enumerate(PLANTED))


def brute_base(text):
    """The contract's patterns, as they stand."""
    kinds = [("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, fits) in enumerate(kinds) for m in re.finditer(p, text) if fits(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_base_spans_against_the_patterns():
    r = random.Random(4)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", "é", "/+_.", "x", "KEY", "\n", "A" * 15]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        got = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, _ in secret_scan.spans(text) if k < 3]
        assert got == brute_base(text), text


def brute_cost(value, ranks):
    """Every segmentation, one after the other."""
    def part(s):
        costs = [float(len(s))]
        if len(s) >= 3 and (c := secret_scan._word_cost(s, ranks)) is not None:
            costs.append(c)
        if len(s) >= 4 and secret_scan.DATE.fullmatch(s):
            costs.append(math.log10(120 if len(s) == 4 else 120 * 365))
        low = s.lower()
        if len(s) >= 3 and all((a, b) in secret_scan.NEXT for a, b in zip(low, low[1:], strict=False)):
            costs.append(math.log10(47 * 2 * len(s)))
        for w in range(1, len(s) // 2 + 1):
            if len(s) >= 3 and len(s) % w == 0 and s[:w] * (len(s) // w) == s:
                costs.append(w + math.log10(len(s) // w))
        return min(costs)

    n, best = len(value), math.inf
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            ends = (0, *cuts, n)
            best = min(best, sum(part(value[a:b]) for a, b in zip(ends, ends[1:], strict=False)) + secret_scan.LOG_ORDERS[min(k + 1, len(secret_scan.LOG_ORDERS) - 1)])
    return best


@pytest.mark.parametrize("seed", range(4))
def test_costs_against_every_segmentation(seed):
    r = random.Random(seed)
    ranks = secret_scan.RANK | {"cooperation": 500, "abc": 90}
    parts = ["password", "P@ss", "abc", "qwe", "asdf", "aaa", "1999", "2024-01-31", "x", "9", "Q", "zz", "!"]
    for _ in range(60):
        value = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))[:12]
        want, got = brute_cost(value, ranks), secret_scan.log_guesses(value, ranks)
        assert got == pytest.approx(want, abs=1e-6) if want < secret_scan.MIN_LOG_GUESSES else got == math.inf, value
