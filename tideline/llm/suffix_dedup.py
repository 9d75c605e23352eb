"""Exact substring deduplication by a common-prefix-aware distributed merge sort.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting every suffix would move hundreds of
bytes for each byte of text, so strings of several neighbouring suffixes are sorted, level by level:

1. Anchors. Of the grams of `gram` bytes in a window of LENGTH bytes the one with the least hash is the window's anchor:
   equal windows have equal anchors, at equal places. Windows that follow each other with one anchor form a string.
2. Filter. Spark counts the anchors' hashes. Strings whose anchor occurs once hold no repeated window, and stay home.
3. Runs. The other strings are sorted in the tasks that hold their texts; equal ones collapse to one with its number of
   copies, and a run is front-coded: each string as its common prefix with the one before, and its rest.
4. Merge. Runs are exchanged by ranges of strings (quantiles of a sample's first bytes), and every range's runs go through a
   loser tree that knows for each string how much of it agrees with the last winner: a longer common prefix wins unseen, and
   equal ones are compared behind it only. The common prefixes of neighbours are the answer: a string with copies is repeated
   whole, another as far as it agrees with a neighbour, if that is LENGTH or more. The verdicts return to the runs, which know the places.
5. Strings with a common anchor that still differ may share windows further in. One of each goes to the next level as a
   text, with longer grams, so its strings have fewer windows; on the last level a gram is a whole window.

Every step deals by content, run or document: a passage in a third of all documents is one string a run, and its places
never leave their run but as one row each of spans. The hash filter can let a needless string pass, and drops none that repeats.

Beside the bytes removed, which follow LENGTH alone, n_passage_words tells how many words of a text stand in passages of PASSAGE or
more words that another document has too, as 50 short words can be under LENGTH. Windows of so many words have anchors as above;
windows whose anchors several documents have are compared by hashes, and exact copies are told by the text as a whole.

Edge cases: a null text is empty. Texts shorter than LENGTH, and empty tables, lose nothing. Rows with equal doc_id and text
are occurrences like others, and lose the same bytes; they are one document to n_passage_words. doc_id can be of any type,
and null. Matches never cross documents, as windows don't. Texts of any length are looked at whole, PIECE by PIECE. Only
doc_id and text are read, so other columns can have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, small_or_shuffled, stored

LENGTH = 400
#: Gram lengths of the levels, as shares of LENGTH.
LEVELS = (0.5, 0.8, 0.94, 1.0)
#: Bytes of a text that are looked at in one go, besides the overlap: bounds a task's memory.
PIECE = 1 << 20
#: Strings that meet in a bucket, about.
BUCKET_STRINGS = 20_000
#: Words of a passage, and of the grams that anchor its windows.
PASSAGE = 50
PASSAGE_GRAM = 26
#: Strings are dealt by their first HEAD bytes; of one anchor in so many the strings say where ranges end.
HEAD = 6
HEAD_SAMPLE = 64

WEIGHT = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
PLACE_BITS = np.uint64(24)


class Hashes:
    """64-bit hashes of any part of a sequence of 64-bit values, from its prefix sums."""

    power = power_back = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray) -> None:
        if len(Hashes.power) <= len(values):
            n = 2 * len(values) + 1
            Hashes.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))), dtype=np.uint64)
            Hashes.power_back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, INVERSE))), dtype=np.uint64)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values * Hashes.power[: len(values)], dtype=np.uint64)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * Hashes.power_back[a]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    k = len(x) - width + 1
    blocks = np.concatenate((x, np.full(-len(x) % width, NONE))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:k], ahead[width - 1 : width - 1 + k])


def anchored(texts: list[bytes], gram: int, length: int) -> tuple[np.ndarray, ...]:
    """The strings of texts: number of the text, first and last window (its start), hash of the anchor, hash of the string, its first
    bytes (-1 outside of the sample). Many short texts, or a part of a long one, are looked at together."""
    out, held, size = [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if held and size + len(part) > PIECE + length:
                out.append(_strings(held, gram, length))
                held, size = [], 0
            held.append((number, at, part))
            size += len(part)
    if held:
        out.append(_strings(held, gram, length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _strings(parts: list[tuple[int, int, bytes]], gram: int, length: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    hashes = Hashes(WEIGHT[data])
    i = np.arange(ends[-1] - gram + 1)
    h = hashes.of(i, i + gram)
    least = sliding_least((h >> PLACE_BITS << PLACE_BITS) | i.astype(np.uint64), length - gram + 1)
    within = np.repeat(ends, sizes)[: len(least)] >= np.arange(length, length + len(least))  # windows of one text
    goes_on = within & np.concatenate(([False], within[:-1] & (least[1:] == least[:-1])))
    first = np.flatnonzero(within & ~goes_on)
    last = np.flatnonzero(within & ~np.append(goes_on[1:], False))
    anchor = (least[first] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    of = np.searchsorted(ends, first, "right")
    shift = np.array([at for _, at, _ in parts])[of] - (ends - sizes)[of]
    number = np.array([n for n, _, _ in parts])[of]
    head = sum(data[first + k].astype(np.int64) << (8 * (HEAD - 1 - k)) for k in range(min(HEAD, length)))
    head = np.where(h[anchor] % np.uint64(HEAD_SAMPLE) == 0, head, -1)
    return number, first + shift, last + shift, h[anchor].view(np.int64), hashes.of(first, last + length).view(np.int64), head


ANCHORS = "key long, base int, spots array<struct<first:int,last:int,anchor:long,whole:long,head:long>>"


def _anchors(batches: Iterator[pa.RecordBatch], gram: int, length: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        number, *columns = anchored([t.as_buffer().to_pybytes() for t in batch.column(2)], gram, length)
        offsets = np.searchsorted(number, np.arange(batch.num_rows + 1))
        spots = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["first", "last", "anchor", "whole", "head"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spots)], names=["key", "base", "spots"])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to agree."""
    most = min(len(a), len(b))
    step = 8
    while known < most and a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    if known >= most:
        return most
    while step > 1:  # the first difference is within the next `step` bytes
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return min(known, most)


RUNS = "run string, bucket int, prefix binary, rest_size binary, rest binary, copies binary, next binary, key binary, base binary, ref_of binary, ref_key binary, ref_first binary, ref_last binary"


def _pack(values: list[int], kind: str) -> bytes:
    return np.array(values, kind).tobytes()


def _run(name: str, bucket: int, strings: dict[bytes, list]) -> list:
    """A row of RUNS: sorted, front-coded strings, and the places of each. strings: to [next level?, places]."""
    before, prefix, rest, copies, onward, keys, bases = b"", [], [], [], [], [], []
    refs: list[tuple[int, int, int, int]] = []
    for k, s in enumerate(sorted(strings)):
        more, places = strings[s]
        n = common_prefix(before, s)
        prefix.append(n), rest.append(s[n:]), copies.append(len(places)), onward.append(more)
        keys.append(places[0][0]), bases.append(places[0][1])
        refs += [(k, *p) for p in places]
        before = s
    of, key, first, last = zip(*refs, strict=True)
    return [
        name, bucket, _pack(prefix, "<i4"), _pack(list(map(len, rest)), "<i4"), b"".join(rest), _pack(copies, "<i4"), _pack(onward, "u1"),
        _pack(keys, "<i8"), _pack(bases, "<i4"), _pack(of, "<i4"), _pack(key, "<i8"), _pack(first, "<i4"), _pack(last, "<i4"),
    ]


class Ranges:
    """Ranges of strings by their first bytes. Bytes that so many strings begin with that they fill several ranges are one
    range, dealt into as many buckets by hash."""

    def __init__(self, ends: Sequence[int], buckets: int) -> None:
        values, times = np.unique(np.array(ends, np.int64), return_counts=True)
        self.ends = values.tolist()
        self.size = [1, *times.tolist()] if self.ends else [buckets]
        self.first = np.cumsum([0, *self.size[:-1]]).tolist()

    def bucket(self, string: bytes) -> int:
        k = bisect_right(self.ends, int.from_bytes(string[:HEAD], "big"))
        return self.first[k] + (xxhash.xxh64_intdigest(string) % self.size[k] if self.size[k] > 1 else 0)


def _runs(batches: Iterator[pa.RecordBatch], ranges: Ranges, length: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    kinds = (pa.string(), pa.int32(), *[pa.binary()] * 11)
    names = [c.split()[0] for c in RUNS.split(", ")]
    for number, batch in enumerate(batches):
        held: dict[int, dict[bytes, list]] = {}
        for key, base, text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            text = text.as_buffer().to_pybytes()
            for spot in spots:
                first, last = spot["first"], spot["last"]
                s = text[first : last + length]
                known = held.setdefault(ranges.bucket(s), {}).setdefault(s, [spot["more"], []])
                known[1].append((key, base + first, base + last))
        rows = [_run(f"{task}-{number}", bucket, strings) for bucket, strings in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 13, kinds, strict=True)], names=names)


class Run:
    """A sorted run as it comes: strings, and how much each agrees with the one before."""

    def __init__(self, prefix: np.ndarray, sizes: np.ndarray, rest: bytes) -> None:
        self.prefix = prefix.tolist()
        self.strings, before, at = [], b"", 0
        for n, size in zip(self.prefix, sizes.tolist(), strict=True):
            before = before[:n] + rest[at : at + size]
            at += size
            self.strings.append(before)


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, int, int]]:
    """All strings in order: string, its run, its number there, and the length of its common prefix with the one before.

    A tree of losers. agree[r] is how much run r's string agrees with the string that beat it last, which on the
    way of the winner is the winner itself: of two challengers the one that agrees with it longer is the smaller,
    and what is known to agree is not compared again.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    now: list[bytes | None] = [r.strings[0] if r.strings else None for r in runs] + [None] * (size - len(runs))
    agree = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if agree[a] != agree[b]:
            return (a, b) if agree[a] > agree[b] else (b, a)
        n = common_prefix(x, y, agree[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            agree[b] = n
            return a, b
        agree[a] = n
        return b, a

    def first(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    winner = first(1)
    while now[winner] is not None:
        yield now[winner], winner, at[winner], agree[winner]
        at[winner] += 1
        k, run = at[winner], runs[winner]
        if k < len(run.strings):
            now[winner], agree[winner] = run.strings[k], run.prefix[k]
        else:
            now[winner] = None
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


VERDICTS = "run string, bucket int, repeated binary, items array<struct<key:long,base:int,text:binary>>"


def _verdicts(rows: list[dict], length: int) -> pa.RecordBatch:
    """A bucket's runs merged: how many windows of each string, from its start, are repeated. An item goes on to the next
    level: one of each string that is marked so."""
    ints = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
    runs = [Run(p, s, r["rest"]) for p, s, r in zip(ints("prefix", "<i4"), ints("rest_size", "<i4"), rows, strict=True)]
    copies, onward, keys, bases = ints("copies", "<i4"), ints("next", "u1"), ints("key", "<i8"), ints("base", "<i4")
    repeated = [np.zeros(len(r.strings), "<i4") for r in runs]
    items: list[list[dict]] = [[] for _ in runs]
    same: list[tuple[int, int]] = []
    last = None

    def decide(agreed: int) -> None:
        if len(same) > 1 or same and copies[same[0][0]][same[0][1]] > 1:
            agreed = len(last)
        for run, k in same:
            repeated[run][k] = max(0, agreed - length + 1)
        if same and any(onward[run][k] for run, k in same):
            run, k = same[0]
            items[run].append({"key": int(keys[run][k]), "base": int(bases[run][k]), "text": last})

    before = 0
    for string, run, k, agree in merged(runs):
        if last is None or agree < len(string) or agree < len(last):
            decide(max(before, agree))
            same, before = [], agree
        same.append((run, k))
        last = string
    decide(before)
    kinds = pa.list_(pa.struct([("key", pa.int64()), ("base", pa.int32()), ("text", pa.binary())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([r["run"] for r in rows]), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([x.tobytes() for x in repeated], pa.binary()), pa.array(items, kinds)],
        names=["run", "bucket", "repeated", "items"])


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():  # sorted by bucket
            if held and held[0]["bucket"] != row["bucket"]:
                yield _verdicts(held, length)
                held = []
            held.append(row)
    if held:
        yield _verdicts(held, length)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for of, key, first, last, repeated in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            windows = np.frombuffer(repeated, "<i4")[np.frombuffer(of, "<i4")]
            gone = windows > 0
            key, first, last = (np.frombuffer(x, kind)[gone] for x, kind in ((key, "<i8"), (first, "<i4"), (last, "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(first), pa.array(np.minimum(last, first + windows[gone] - 1))], names=["key", "first", "last"])


def level(items: DataFrame, gram: int, length: int) -> tuple[DataFrame, DataFrame]:
    """items: key, base (place of the text in its document), text. Returns repeated windows (key, first, last), and the
    items of the next level."""
    spotted = stored(items.mapInArrow(partial(_anchors, gram=gram, length=length), ANCHORS), "anchors")
    spots = spotted.select("key", "base", F.inline("spots"))
    kinds = spots.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("whole") < F.max("whole")).alias("more"))
    kinds = stored(kinds.where("n > 1"), "common")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total // BUCKET_STRINGS)
    some = spots.where("head >= 0").join(kinds.select("anchor").hint("merge"), "anchor", "left_semi").dropDuplicates(["whole"])
    ends = some.agg(F.percentile_approx("head", [k / buckets for k in range(1, buckets)], max(10_000, 10 * buckets))).first()[0] if buckets > 1 else None
    ranges = Ranges(ends or (), buckets)
    spots = spots.drop("whole", "head")
    picked = spots.join(kinds.drop("n"), "anchor").groupBy("key", "base").agg(F.collect_set(F.struct("first", "last", "more")).alias("spots"))
    # Names that don't clash: the same text may be on both sides.
    picked = picked.withColumnsRenamed({"key": "of", "base": "from"})
    sources = items.join(picked, (F.col("key") == F.col("of")) & (F.col("base") == F.col("from"))).select("key", "base", "text", "spots")
    runs = stored(sources.mapInArrow(partial(_runs, ranges=ranges, length=length), RUNS), "runs")
    discard(spotted)
    exchanged = runs.select("run", "bucket", "prefix", "rest_size", "rest", "copies", "next", "key", "base").repartition("bucket").sortWithinPartitions("bucket")
    verdicts = stored(exchanged.mapInArrow(partial(_merge, length=length), VERDICTS), "verdicts")
    home = runs.select("run", "bucket", "ref_of", "ref_key", "ref_first", "ref_last").join(verdicts.select("run", "bucket", "repeated"), ["run", "bucket"])
    places = home.select("ref_of", "ref_key", "ref_first", "ref_last", "repeated").mapInArrow(_places, "key long, first int, last int")
    places = stored(places, "places")
    discard(runs)
    return places, stored(verdicts.select(F.inline("items")), "items")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes (null: empty), a key of both, whatever type the id has, and base 0."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("key"), F.lit(0).alias("base"))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key (of keyed(docs)) and its windows: array of first and last start of repeated strings of `length` bytes."""
    items = keyed(docs).where(F.octet_length("text") >= length).select("key", "base", "text")
    found = None
    for share in LEVELS:
        gram = max(1, round(share * length))
        places, items = level(items, gram, length)
        found = places if found is None else found.union(places)
        if gram < length and not items.limit(1).count():
            break
    return found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("windows"))


def cut(text: bytes, windows: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left of a text without its repeated windows; bytes and maximal runs removed."""
    kept, at, spans, removed = [], 0, 0, 0
    start = end = 0
    for first, last in sorted(windows):
        if first > end or not spans:
            kept.append(text[at:first])
            removed += end - start
            spans, start, end = spans + 1, first, first
        end = max(end, last + length)
        at = end
    return b"".join([*kept, text[at:]]), removed + end - start, spans


SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a text."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE)  # not inside a word
        end = cut.start() if cut else len(text)
        data = np.frombuffer(text, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(~IS_SPACE[data], prepend=False, append=False))
        starts.append(edge[0::2] + at)
        hashes.append(Hashes(WEIGHT[data]).of(edge[0::2], edge[1::2]))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def word_windows(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: numbers of the texts and their words; and of every window of `width` words the number of its text, its
    anchor (the least hash of a gram in it), and its own hash."""
    gram = min(PASSAGE_GRAM, width)
    at = 0
    while at < len(texts):
        size, end = len(texts[at]) + 1, at + 1
        while end < len(texts) and size + len(texts[end]) < PIECE:
            size, end = size + len(texts[end]) + 1, end + 1
        starts, words = word_hashes(b"\n".join(texts[at:end]))
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[at:end]]), starts, "right")
        number = np.arange(at, end)
        n_words = np.bincount(of, minlength=end - at)
        hashes, n = Hashes(words), len(words) - width + 1
        if n > 0:
            i = np.arange(len(words) - gram + 1)
            anchor = sliding_least(hashes.of(i, i + gram), width - gram + 1)
            whole = np.flatnonzero(of[:n] == of[width - 1 :])
            yield number, n_words, at + of[whole], anchor[whole], hashes.of(whole, whole + width)
        else:
            yield number, n_words, *(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64))
        at = end


def _lists(number: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list for each of n texts, of values in order of their numbers."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(number, np.arange(n + 1)), pa.int32()), values)


MARKS = "key long, mark long, n_words long, grams array<long>"


def _marks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, grams, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, n_words, number, anchor, _ in word_windows([t.as_buffer().to_pybytes() for t in batch.column(2)], width):
            sizes.append(n_words)
            new = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(anchor, prepend=anchor[:1]) != 0))
            pairs = np.unique(np.stack([number[new].astype(np.uint64), anchor[new]]), axis=1)
            of.append(pairs[0].astype(np.int64))
            grams.append(pairs[1])
        lists = _lists(np.concatenate(of), pa.array(np.concatenate(grams).view(np.int64)), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes).astype(np.int64)), lists], names=["key", "mark", "n_words", "grams"])


CUT = "n_bytes long, n_removed long, n_spans long, kept binary, key long, places array<struct<at:int,whole:long>>"


def _cut(batches: Iterator[pa.RecordBatch], length: int, digest: bool, width: int) -> Iterator[pa.RecordBatch]:
    """Texts without their repeated windows; and of texts with shared anchors the windows of words that have them."""
    for batch in batches:
        texts, windows, grams = [t.as_buffer().to_pybytes() for t in batch.column(1)], batch.column(2).to_pylist(), batch.column(4)
        out = [cut(t, [(w["first"], w["last"]) for w in ws or ()], length) for t, ws in zip(texts, windows, strict=True)]
        sizes = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [r for _, r, _ in out], [s for _, _, s in out])]
        kept = pa.array([sha256(k).hexdigest().encode() if digest else k for k, _, _ in out], pa.binary())
        of, at, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for row in np.flatnonzero(np.array([g.is_valid for g in grams], bool)):
            known = grams[int(row)].values.to_numpy().view(np.uint64)
            for _, _, _, anchor, own in word_windows([texts[row]], width):
                shared = np.flatnonzero(np.isin(anchor, known))
                of.append(np.full(len(shared), row))
                at.append(shared)
                whole.append(own[shared])
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(whole).view(np.int64))], names=["at", "whole"])
        places = _lists(np.concatenate(of), pairs, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, kept, batch.column(3), places], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "key", "places"])


def shared_anchors(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """copies: key, all_words (of a text that several documents are); and key, grams: anchors that several documents have. Of
    equal texts one, that with the least key, stands for all."""
    marks = rows.select("key", F.xxhash64("text").alias("mark"), "text").mapInArrow(partial(_marks, width=width), MARKS)
    marks = stored(marks.where(F.col("n_words") >= width), "passage-marks")
    same = stored(marks.groupBy("mark").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select(F.col("mark").alias("of_mark"), "a"), "copies")
    marks = marks.join(small_or_shuffled(same), F.col("mark") == F.col("of_mark"), "left")
    copies = stored(marks.where("a is not null").groupBy("key").agg(F.first("n_words").alias("all_words")), "copy-keys")
    one = marks.where("a is null or a = key").select("key", F.explode("grams").alias("gram"))
    common = stored(one.groupBy("gram").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("gram"), "common-grams")
    return copies, one.join(small_or_shuffled(common), "gram").groupBy("key").agg(F.collect_set("gram").alias("grams"))


def passage_words(places: DataFrame, width: int) -> DataFrame:
    """key, found: words inside the windows (key, at, whole) that several documents have."""
    shared = stored(places.groupBy("whole").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("whole"), "shared-windows")
    hits = places.join(small_or_shuffled(shared), "whole").groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    steps = F.transform("ats", lambda x, i: F.least(F.lit(width), F.coalesce(F.get("ats", i + 1) - x, F.lit(width))))
    return hits.select("key", F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x).alias("found"))


def deduplicate(docs: DataFrame, length: int = LENGTH, digest: bool = False, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the bytes kept (or their SHA-256 in hex), and n_passage_words, a row for each row of docs."""
    rows = keyed(docs.select("doc_id", "text"))
    copies, grams = shared_anchors(rows, passage)
    grams = stored(grams.withColumnRenamed("key", "of_grams"), "passage-grams")
    windows = stored(repeated_windows(docs, length), "windows").withColumnRenamed("key", "of")
    both = rows.join(windows, F.col("key") == F.col("of"), "left").join(grams, F.col("key") == F.col("of_grams"), "left").select("doc_id", "text", "windows", "key", "grams")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = stored(both.mapInArrow(partial(_cut, length=length, digest=digest, width=passage), f"doc_id {kind}, {CUT}"), "cut")
    found = small_or_shuffled(stored(passage_words(out.select("key", F.inline("places")), passage), "passage-words"))
    whole = small_or_shuffled(copies)
    out = out.join(found, "key", "left").join(whole, "key", "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", F.coalesce("all_words", "found", F.lit(0)).cast("long").alias("n_passage_words"))
