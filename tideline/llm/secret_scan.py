"""Secret scans: fixed patterns, and password guess costs for values in credential contexts.

Base spans (fixed): `assign` (a credential word, : or =, and a value of 12 or more), `access` (AKIA keys of 18 or more),
`hex` (runs of 16 or more hex digits), leftmost and non-overlapping per kind. Further values that stand after a credential
word (`password: Tr0ub4dor&3`, `passphrase is ...`) are costed: the cheapest way to cut the value into words, dates,
repeats, keyboard walks and brute-force spans, by dynamic programming over its ends; the product of the parts' guesses
times the orders of the parts is what an attacker needs. From MIN_LOG_GUESSES on the value is a span of kind `guess`;
below it is a word such as `required` or `changeme`. Values that overlap a base span stay with that.

Texts are scanned row by row where Spark reads them; only words and values are shuffled. Offsets are code points, ends exclusive.

Words are ranked: COMMON_WORDS, then by how often they stand in all documents outside of such values (a secret does not make
itself a word). Spark joins what could be a word inside a value to the counts, each distinct value is costed once with its
own few ranks, and the verdicts go back to the documents that hold such values: no dictionary is sent around.

Edge cases: an empty table gives an empty result. redact() returns the columns of docs, whatever their names; scan() reads doc_id (a
whole number) and text alone. A null text is empty and holds nothing. A null doc_id and repeated rows are rows like others. A value of any
length is costed whole: states at the threshold are dropped, so work grows with its length.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import small_or_shuffled, stored

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|auth)\b["']?[\x20\t]*(?:[:=]|=>|\bis\b)[\x20\t]*["']?([^\s"'`<>,;]{6,})""", re.I | re.A)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "key", "auth")
MIN_LOG_GUESSES = 10.0
#: Shorter values are not costed.
LEAST_VALUE = 6
#: log10 of the orders of so many parts; from the last on they alone reach the threshold.
LOG_ORDERS = [math.log10(math.factorial(k)) for k in range(15)]
#: Longer runs of letters are no words.
LONGEST_WORD = 64

# Words that attackers try first, in order of rank.
COMMON_WORDS = (
    "password", "qwerty", "admin", "welcome", "letmein", "login", "secret", "changeme", "master", "monkey", "dragon", "football",
    "baseball", "iloveyou", "sunshine", "princess", "shadow", "superman", "michael", "jordan", "hunter", "ranger", "summer", "winter",
    "spring", "autumn", "hello", "freedom", "whatever", "trustno", "guest", "root", "user", "test", "default", "example", "sample",
    "required", "optional", "none", "null", "true", "false", "string", "value", "token", "key", "pass", "word", "your", "here", "enter",
    "account", "email", "name", "the", "and", "for", "must", "contain", "reset", "forgot", "invalid", "expired", "incorrect", "correct",
    "horse", "battery", "staple", "love", "money", "system", "server", "public", "private", "access", "company", "house", "computer",
)
RANK = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
LEET = str.maketrans("@4310$57!", "aaeiosstl")
#: Neighbours on a keyboard, row by row, and the alphabet.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]} | {
    (a, b) for upper, lower in zip(ROWS[:3], ROWS[1:4]) for i, a in enumerate(lower) for b in upper[i : i + 2] for a, b in ((a, b), (b, a))
}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/.]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d")


def _word_cost(part: str, ranks: dict[str, int] = RANK) -> float | None:
    plain = part.lower()
    rank = ranks.get(plain)
    changed = 1.0
    if rank is None:
        rank, changed = ranks.get(plain.translate(LEET)), 4.0
        if rank is None:
            return None
    if part != plain:
        changed *= 2.0 if part.istitle() or part.isupper() else 8.0
    return math.log10(rank * changed + 1)


def _runs(n: int, same) -> tuple[list[int], list[int]]:
    """For every place the start of the run that it lies in, and the run's end; same(j): whether j goes on from before."""
    first, last = list(range(n)), [n] * n
    for j in range(1, n):
        if same(j):
            first[j] = first[j - 1]
    for j in range(n - 2, -1, -1):
        last[j] = last[j + 1] if same(j + 1) else j + 1
    return first, last


def _parts(value: str, i: int, ranks: dict[str, int], walks, repeats) -> Iterator[tuple[int, float]]:
    """Spans from i on that are cheaper than brute force: end, log10 of the guesses.

    A walk or repeat that starts deep in a longer one goes LONGEST_WORD characters at most: for more, the longer one is cheaper.
    """
    n = len(value)
    for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
        if (cost := _word_cost(value[i:j], ranks)) is not None:
            yield j, cost
    for j in range(i + 4, min(n, i + 10) + 1):
        if DATE.fullmatch(value, i, j):
            yield j, math.log10(120 if j - i == 4 else 120 * 365)
    first, last = walks[0][i], walks[1][i]
    for j in range(i + 3, min(last, n if i - first <= LONGEST_WORD else i + LONGEST_WORD) + 1):
        yield j, math.log10(47 * 2 * (j - i))
    for width, (start, end) in enumerate(repeats, 1):  # wider ones cost MIN_LOG_GUESSES
        if i + width >= n or end[i] < i + width:
            continue
        most = end[i] if i - start[i] <= LONGEST_WORD + width else min(end[i], i + LONGEST_WORD)
        for j in range(i + 2 * width, most + 1, width):
            if j - i >= 3:
                yield j, width + math.log10((j - i) // width)


def _periods(value: str, width: int) -> tuple[list[int], list[int]]:
    """For every place the first and the last (exclusive) of the stretch of this period that holds it."""
    n = len(value)
    same = [False] * width + [value[j] == value[j - width] for j in range(width, n)]
    first, last = list(range(n)), [0] * n
    at = n
    for j in range(n - 1, -1, -1):  # the first place after j + width - 1 that does not go on
        if j + width < n and not same[j + width]:
            at = j + width
        last[j] = at if j + width < n else n
    for j in range(1, n):
        if j + width - 1 < n and same[j + width - 1]:
            first[j] = first[j - 1]
    return first, last


def log_guesses(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of a value; infinite if that is MIN_LOG_GUESSES or more."""
    n, low = len(value), value.lower()
    walks = _runs(n, lambda j: (low[j - 1], low[j]) in NEXT)
    repeats = [_periods(value, w) for w in range(1, min(int(MIN_LOG_GUESSES) - 1, n // 2) + 1)]
    # best[j]: number of parts -> cheapest cost of value[:j] in so many parts; brute: the same with a brute-force part last.
    best: list[dict[int, float]] = [{0: 0.0}, *({} for _ in range(n))]
    brute: list[dict[int, float]] = [{} for _ in range(n + 1)]

    def put(states: dict[int, float], k: int, c: float) -> None:
        if c + LOG_ORDERS[min(k, len(LOG_ORDERS) - 1)] < MIN_LOG_GUESSES and c < states.get(k, math.inf):
            states[k] = c

    for i in range(n):
        for k, c in brute[i].items():
            put(best[i], k, c)
            put(brute[i + 1], k, c + 1.0)  # ten guesses a character
        if not best[i]:
            continue
        for k, c in best[i].items():
            put(brute[i + 1], k + 1, c + 1.0)
        for j, cost in _parts(value, i, ranks, walks, repeats):
            for k, c in best[i].items():
                put(best[j], k + 1, c + cost)
    for k, c in brute[n].items():
        put(best[n], k, c)
    return min((c + LOG_ORDERS[k] for k, c in best[n].items()), default=math.inf)


def guessed(value: str) -> bool:
    """Whether a value is hard to guess, by COMMON_WORDS alone."""
    return log_guesses(value) >= MIN_LOG_GUESSES


def spans(text: str, hard: Callable[[str], bool] = guessed) -> list[tuple[int, int, int, int]]:
    """start, number of the kind, end, start of the value, in the order of the result. hard: whether a value is hard to guess."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    found.sort()
    starts = [a for a, *_ in found]
    upto = list(itertools.accumulate((b for _, _, b, _ in found), max))
    guesses = []
    for a, b in values(text, low):
        k = bisect_left(starts, b)  # base spans that begin before the value's end
        if b - a >= LEAST_VALUE and not (k and upto[k - 1] > a) and hard(text[a:b]):
            guesses.append((a, 3, b, a))
    return sorted(found + guesses)


def values(text: str, low: str) -> list[tuple[int, int]]:
    """Places of the values after credential words."""
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    return [(m.start(1), m.start(1) + len(m.group(1).rstrip(".:!?)]}"))) for m in CONTEXT.finditer(text)]


LETTERS = re.compile(r"[^\W\d_]{3,}")


#: Distinct words that a task counts before it hands them on: bounds its memory.
WORDS_HELD = 200_000


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words outside of values, and how often."""
    count: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        some = {w: n for w, n in count.items() if len(w) <= LONGEST_WORD}
        count.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for t in batch.column(0):
            text = t.as_py() or ""
            low = text.lower()
            at = 0
            for a, b in values(text, low) if len(low) == len(text) else [m.span(1) for m in CONTEXT.finditer(low)]:
                count.update(LETTERS.findall(low[at:a]))
                at = b
            count.update(LETTERS.findall(low[at:]))
            if len(count) > WORDS_HELD:
                yield counted()
    yield counted()


def name_of(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of each document that are no base spans: key, the value's name, value."""
    for batch in batches:
        rows = []
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = t.as_py() or ""
            some = {text[a:b] for a, kind, b, _ in spans(text, lambda _: True) if kind == 3}
            rows += [(key, name_of(v), v) for v in sorted(some)]
        keys, names, said = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(said, pa.string())], names=["key", "name", "value"])


#: Possible words that a task hands on in one go: bounds its memory, however long a value is.
WANTED = 20_000


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whatever could be a word inside a value: name, word. A word that stands in several slices of a value comes once for each."""
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low = value.lower()
            some: set[str] = set()
            for v in {low, low.translate(LEET)}:
                for m in LETTERS.finditer(v):
                    run = m.group()
                    for i in range(len(run) - 2):
                        some.update(run[i:j] for j in range(i + 3, min(len(run), i + LONGEST_WORD) + 1))
                        if len(some) >= WANTED:
                            yield _named(name, some)
                            some = set()
            yield _named(name, some)


def _named(name: int, some: set[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int64()), pa.array(sorted(some), pa.string())], names=["name", "word"])


def _costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the values that are hard to guess."""
    for batch in batches:
        hard = []
        for name, value, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ranks = {w["word"]: len(COMMON_WORDS) + 1 + w["above"] for w in words or ()} | RANK
            if log_guesses(value, ranks) >= MIN_LOG_GUESSES:
                hard.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(hard, pa.int64())], names=["name"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word, above: how many words are more frequent, over all documents; ties alike."""
    known = stored(texts.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    by_count = known.groupBy("n").agg(F.count("*").alias("words"))
    above = by_count.select("n", (F.sum("words").over(Window.orderBy(F.desc("n"))) - F.col("words")).alias("above"))  # distinct counts
    return known.join(small_or_shuffled(stored(above, "above")), "n").select("word", "above")


def hard_values(docs: DataFrame, key: str) -> DataFrame:
    """key, hard: of the documents that hold values which are hard to guess, the names of these."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    held = stored(docs.select(key, F.col("text").cast("string")).mapInArrow(_held, "key long, name long, value string"), "held")
    each = stored(held.groupBy("name").agg(F.min("value").alias("value")), "values")
    words = each.mapInArrow(_wanted, "name long, word string").join(word_counts(texts), "word")
    ranks = words.groupBy("name").agg(F.collect_set(F.struct("word", "above")).alias("words"))
    hard = stored(each.join(ranks, "name", "left").select("name", "value", "words").mapInArrow(_costed, "name long"), "hard")
    found = held.join(small_or_shuffled(hard), "name").groupBy("key").agg(F.collect_set("name").alias("hard"))
    return small_or_shuffled(stored(found, "held-hard"))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def _joined(found: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b, _ in found)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [spans(t.as_py() or "", _among(hard)) for t, hard in zip(batch.column(1), batch.column(2), strict=True)]
        counts = [pa.array([sum(s[1] == kind for s in r) for r in rows], pa.int64()) for kind in range(4)]
        base = [hashlib.sha256(_joined([s for s in r if s[1] < 3]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([_joined(r) for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])


def _among(hard: pa.Scalar) -> Callable[[str], bool]:
    known = set(hard.as_py() or ())
    return lambda value: name_of(value) in known


def scan(docs: DataFrame) -> DataFrame:
    """The secrets of docs (doc_id, text): counts by kind, a digest of the base spans, and all spans as kind:start:end."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", _key())
    return rows.join(hard_values(rows, "key"), "key", "left").select("doc_id", "text", "hard").mapInArrow(_scan, SCANNED)


MASK = "[REDACTED]"


def masked(text: str, hard: Callable[[str], bool] = guessed) -> str:
    """The text with the values of its secrets replaced, overlapping ones as one."""
    out, at = [], 0
    for a, b in sorted((value, b) for _, _, b, value in spans(text, hard)):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names[:-1]  # the last: names of hard values
        texts = [t.as_py() for t in batch.column("text")]
        clean = [t and masked(t, _among(hard)) for t, hard in zip(texts, batch.columns[-1], strict=True)]
        columns = dict(zip(names, batch.columns, strict=False))
        columns["text"] = pa.array(clean, batch.schema.field("text").type)
        if "n_chars" in columns:
            sizes = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, clean, strict=True)]
            columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked; n_chars, if there is one, follows where a text changed."""
    key, hard = (max(docs.columns, key=len) + end for end in ("_key", "_hard"))  # no column has these names
    rows = docs.withColumn(key, _key())
    found = hard_values(rows, key).withColumnsRenamed({"key": key, "hard": hard})
    return rows.join(found, key, "left").select(*docs.columns, hard).mapInArrow(_mask, docs.schema)
