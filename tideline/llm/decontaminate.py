"""Benchmark decontamination with a distributed positional inverted index.

Index: documents are dealt out as Spark reads them; every SEGMENT_BYTES of text become a segment, a row of a table in the
shared folder: its documents, its sorted terms (64-bit word hashes), and for each term the positions of all its
occurrences. Positions count words through the segment, with a gap between documents. No word is left out, and as
segments hold documents, not terms, a word that makes up a third of the corpus is spread over all of them.

Search: Spark cuts the items into windows and stores each once with its items, in blocks of about BLOCK_WINDOWS, dealt by
hash, a row each. Spark joins every segment with every block (one, but for a large benchmark), so the driver holds nothing of a benchmark and
a task holds a block; up to BROADCAST_ROWS windows are broadcast, more are shuffled. A window starts from the postings
of its rarest term there, moved back by the term's offset, and intersects the others' offset-adjusted lists in order of
rarity; what is left are exact phrases. Windows go in slices by their rarest terms' postings, so that those of common
words alone need no more memory than others. With a slop, each word may stand that many places from its own: proximity
matches. Documents never move; what leaves a segment are the runs of words that were hit, and the items.

Edge cases: a null text has no words, and is not contaminated. Equal rows are judged each for itself. An item of fewer
words than a window, but not none, is one window; items without words match nothing; a null item_id reads `null`.
Empty documents give an empty result, an empty benchmark no hits. A document longer than a segment is a segment. Only doc_id
(a whole number) and text are read; other columns can have any names, and clean() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BROADCAST_ROWS, small_or_shuffled, stored

WINDOW = 10
SLOP = 2
SEGMENT_BYTES = 4 << 20
#: Bytes hashed in one go: bounds a task's memory.
PIECE_BYTES = 1 << 20
#: Windows that a block of the benchmark holds, about: 10 MB.
BLOCK_WINDOWS = 100_000
#: Postings of rarest terms that are looked at in one go, besides the last window's.
SLICE_POSTINGS = 500_000


def _lower_table() -> np.ndarray:
    """Bytes of words, A-Z lower-cased; 0 for all others. Words are [0-9a-z] and whatever is beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for first, last, shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
        table[first : last + 1] = np.arange(first, last + 1) + shift
    return table


LOWER = _lower_table()
WEIGHT = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words in bytes."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = at + PIECE_BYTES
        low = LOWER[data[at:end]]
        while end < len(data) and low[-1]:  # not inside a word
            gap = np.flatnonzero(low == 0)
            if len(gap):
                low = low[: gap[-1] + 1]
                break
            end += PIECE_BYTES
            low = LOWER[data[at:end]]
        edge = np.flatnonzero(np.diff(low != 0, prepend=False, append=False))
        first, last = edge[0::2], edge[1::2]
        if len(first):
            width = last - first
            begin = np.cumsum(width) - width
            within = np.arange(int(width.sum())) - np.repeat(begin, width)
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(width.max()) - 1, BASE))), dtype=np.uint64)
            h = np.add.reduceat(WEIGHT[low[low != 0]] * power[within], begin)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(h ^ (h >> np.uint64(32)))
            starts.append(first + at)
        at += len(low)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


INDEX = "segment string, doc_id array<long>, mark array<long>, n_words array<int>, terms binary, counts binary, positions binary"


def _segment(name: str, ids: list, marks: list, texts: list[bytes]) -> pa.RecordBatch:
    starts, hashes = tokens(np.frombuffer(b" ".join(texts), np.uint8))
    doc_at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    of = np.searchsorted(doc_at, starts, "right") - 1
    order = np.argsort(hashes, kind="stable")
    terms, counts = np.unique(hashes, return_counts=True)
    positions = (np.arange(len(of)) + of)[order].astype(np.int32)
    steps = np.diff(positions, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T  # byte planes: they pack well
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.int64())), pa.array([np.bincount(of, minlength=len(texts)).tolist()], pa.list_(pa.int32()))]
        + [pa.array([x.tobytes()], pa.binary()) for x in (terms, counts.astype(np.int32), steps)],
        names=["segment", "doc_id", "mark", "n_words", "terms", "counts", "positions"])


def _build(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids, marks, texts, held = [], [], [], 0
    for batch in batches:
        for i, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text or b""
            if texts and held + len(text) > segment_bytes:
                yield _segment(f"{task}-{number}", ids, marks, texts)
                ids, marks, texts, held, number = [], [], [], 0, number + 1
            ids.append(i), marks.append(mark), texts.append(text)
            held += len(text) + 1
    if texts:
        yield _segment(f"{task}-{number}", ids, marks, texts)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of docs (doc_id, text) as a table in the shared folder. mark: a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(partial(_build, segment_bytes=segment_bytes), INDEX), "positions")


class Block:
    """Distinct windows: rows of places in `terms` (-1 after a short window's end), and the items that hold each."""

    def __init__(self, rows: pa.StructArray) -> None:
        size, held, items = (rows.field(k) for k in ("size", "words", "item"))
        size = size.to_numpy().astype(np.int64)
        width = int(size.max())
        words = np.zeros((len(size), width), np.uint64)
        inside = np.arange(width) < size[:, None]
        words[inside] = np.frombuffer(b"".join(held.to_pylist()), np.uint64)
        both = np.column_stack([size.astype(np.uint64), words])
        distinct, of = np.unique(both, axis=0, return_inverse=True)
        self.size = distinct[:, 0].astype(np.int64)
        self.terms, place = np.unique(distinct[:, 1:], return_inverse=True)
        self.place = np.where(np.arange(width) < self.size[:, None], place.reshape(-1, width), -1)
        self.names, name = np.unique(np.array(items.to_pylist(), dtype=object).astype(str), return_inverse=True)
        pairs = np.unique(np.column_stack([of.ravel(), name]), axis=0)
        self.item = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))


WINDOWS = "size int, words binary, item string"


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, h = tokens(np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8))
            n = min(width, len(h))
            for at in range(0, len(h) - n + 1 if n else 0, 10_000):
                words = [w.tobytes() for w in np.lib.stride_tricks.sliding_window_view(h, n)[at : at + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(words), pa.int32()), pa.array(words, pa.binary()), pa.array([item] * len(words))], names=["size", "words", "item"])


def blocks(benchmark: DataFrame, width: int = WINDOW, most: int | None = None) -> tuple[DataFrame, int]:
    """The windows of benchmark (item_id, text) as a table, a row a block: block, windows; and the number of blocks."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("binary"))
    found = stored(rows.mapInArrow(partial(_windows, width=width), WINDOWS).distinct(), "windows")
    n = found.count()
    count = -(-n // (most or BLOCK_WINDOWS))
    dealt = found.groupBy(F.pmod(F.xxhash64("words"), F.lit(max(count, 1))).cast("int").alias("block")).agg(F.collect_list(F.struct("size", "words", "item")).alias("windows"))
    table = stored(dealt, "blocks")
    return F.broadcast(table) if n <= BROADCAST_ROWS else table.hint("merge"), count


def matches(block: Block, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, doc_first: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Window and start (a position) of every occurrence in a segment. SLICE_POSTINGS or so at a time."""
    none = np.zeros(0, np.int64)
    if not len(terms):
        return none, none
    at = np.searchsorted(terms, block.terms)
    found = terms[np.minimum(at, len(terms) - 1)] == block.terms
    at = np.where(found, at, 0)
    rare = np.where(found, counts[at], 0)
    rarity = np.where(block.place >= 0, rare[block.place], np.iinfo(np.int64).max)
    alive = np.flatnonzero((rarity > 0).all(axis=1))
    if not len(alive):
        return none, none
    order = np.argsort(rarity[alive], axis=1, kind="stable")
    first = np.cumsum(counts) - counts
    span = int(positions.max()) + 1 + block.place.shape[1] + 2 * slop  # a word wanted beyond the end is nobody's
    keys = np.repeat(np.arange(len(terms)), counts) * span + positions
    n = counts[at[block.place[alive, order[:, 0]]]]
    parts = np.cumsum(n) // SLICE_POSTINGS
    found = []
    for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(parts)) + 1):
        found.append(_occurrences(block, alive[part], order[part], at, counts, first, positions, keys, span, slop))
    window, start, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    one = np.searchsorted(doc_first, low, "right") == np.searchsorted(doc_first, high, "right")
    return window[one], start[one]


def _occurrences(block: Block, alive: np.ndarray, order: np.ndarray, at: np.ndarray, counts: np.ndarray, first: np.ndarray, positions: np.ndarray, keys: np.ndarray, span: int, slop: int) -> tuple[np.ndarray, ...]:
    """Window, start, and the least and greatest place of a word, of occurrences of some windows. order: offsets from the rarest term on."""
    anchor = at[block.place[alive, order[:, 0]]]
    n = counts[anchor]
    w = np.repeat(np.arange(len(alive)), n)
    posting = np.repeat(first[anchor], n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    start = positions[posting] - order[w, 0]
    low = high = positions[posting]
    for step in range(1, block.place.shape[1]):
        offset = order[w, step]
        place = block.place[alive[w], offset]
        own = at[np.maximum(place, 0)] * span
        want = np.maximum(start + offset - slop, 0)
        k = np.minimum(np.searchsorted(keys, own + want), len(keys) - 1)
        there = keys[k] - own
        good = (place < 0) | ((there >= want) & (there <= start + offset + slop))
        low, high = np.where(place < 0, low, np.minimum(low, there)), np.where(place < 0, high, np.maximum(high, there))
        w, start, low, high = w[good], start[good], low[good], high[good]
    return alive[w], start, low, high


FOUND = "segment string, at int, doc_id long, mark long, n_words int, runs array<struct<a:int,b:int>>, items array<string>, near array<string>"


def _items(block: Block, window: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.Array:
    """The names of each document's items."""
    n = block.item_from[window + 1] - block.item_from[window]
    item = block.item[np.repeat(block.item_from[window], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    pairs = np.unique(np.column_stack([np.repeat(doc, n), item]), axis=0)
    offsets = np.searchsorted(pairs[:, 0], np.arange(n_docs + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(block.names[pairs[:, 1]].tolist(), pa.string()))


def _search(batches: Iterator[pa.RecordBatch], slop: int) -> Iterator[pa.RecordBatch]:
    number, block = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            if batch.column(7)[row].as_py() != number:
                number, windows = batch.column(7)[row].as_py(), batch.column(8)[row]
                block = Block(windows.values) if windows.is_valid else None
            segment, ids, marks, sizes = (batch.column(k)[row].values if k else batch.column(0)[row].as_py() for k in range(4))
            terms = np.frombuffer(batch.column(4)[row].as_buffer(), np.uint64)
            counts = np.frombuffer(batch.column(5)[row].as_buffer(), np.int32).astype(np.int64)
            planes = np.frombuffer(batch.column(6)[row].as_buffer(), np.uint8).reshape(4, -1)
            positions = np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32).astype(np.int64)
            n_docs = len(ids)
            words = sizes.to_numpy()
            doc_first = np.cumsum(words) - words + np.arange(n_docs)
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(n_docs + 1, np.int32)), pa.array([], pa.string()))
            runs, items, near = empty, empty, empty
            begin = end = np.zeros(0, np.int64)
            if block is not None:
                of = lambda p: np.searchsorted(doc_first, p, "right") - 1
                window, start = matches(block, terms, counts, positions, doc_first)
                if len(window):
                    cover = np.zeros(int(doc_first[-1] + words[-1]) + 2, np.int32)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + block.size[window], -1)
                    edge = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False))
                    begin, end = edge[0::2], edge[1::2]
                    items = _items(block, window, of(start), n_docs)
                if slop:
                    window, start = matches(block, terms, counts, positions, doc_first, slop)
                    # A shifted window may begin before its document: its middle is inside one of its words' documents.
                    near = _items(block, window, np.maximum(of(np.maximum(start + block.size[window] // 2, 0)), 0), n_docs) if len(window) else empty
            doc = np.searchsorted(doc_first, begin, "right") - 1
            pair = pa.StructArray.from_arrays([pa.array((begin - doc_first[doc]).astype(np.int32)), pa.array((end - doc_first[doc]).astype(np.int32))], names=["a", "b"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), pair)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment] * n_docs), pa.array(np.arange(n_docs), pa.int32()), ids, marks, sizes, runs, items, near],
                names=["segment", "at", "doc_id", "mark", "n_words", "runs", "items", "near"])


def met(index: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, int]:
    """Every segment beside every block, and the number of blocks."""
    held, count = blocks(benchmark, width)
    each = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0)))))
    return each.join(held, "block", "left").select(*index.columns, "block", "windows"), count


def search(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row for each document: doc_id, mark, n_words, n_hit, items (sorted) with exact matches, near: with proximity matches."""
    both, count = met(index, benchmark, width)
    rows = both.mapInArrow(partial(_search, slop=slop), FOUND)
    if count > 1:
        gathered = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "items", "near")}
        rows = rows.groupBy("segment", "at").agg(*(F.first(c).alias(c) for c in ("doc_id", "mark", "n_words")), *gathered.values())
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    joined = F.aggregate(F.array_sort("runs"), start, lambda s, r: F.struct((s.n + F.greatest(r.b - F.greatest(r.a, s.end), F.lit(0))).alias("n"), F.greatest(s.end, r.b).alias("end")), lambda s: s.n)
    named = lambda c: F.array_sort(F.array_distinct(c))
    return rows.select("doc_id", "mark", F.col("n_words").cast("long").alias("n_words"), joined.cast("long").alias("n_hit"), named("items").alias("items"), named("near").alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    return search(build_index(docs), benchmark, width, slop)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Docs without those that hold any window of the benchmark. Rows are told apart by doc_id and a hash of the text."""
    found = stored(contamination(docs, benchmark, width, 0).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark")).distinct(), "hits")
    hit = small_or_shuffled(found)
    return docs.join(hit, docs.doc_id.eqNullSafe(hit.hit_id) & (F.xxhash64(docs.text) == hit.hit_mark), "left_anti")
