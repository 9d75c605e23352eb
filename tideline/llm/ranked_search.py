"""Ranked lexical search over impact-ordered bounds: variable-block-max WAND.

Index: documents are dealt out as Spark reads them, and every SEGMENT_BYTES of text are a shard. A shard's postings are rows of a
table in the shared folder, one a term: the places of its documents (sorted by id) and, for each, its impact, the
term's part of a score before the term's weight. A posting list is cut into blocks of variable length, each with its greatest impact.
Dynamic programming chooses the cuts: over all ways to cut the list into blocks of at most LONGEST_BLOCK postings, the least sum of
(greatest - own impact) over the postings, which is the bound's error, plus BLOCK_COST a block. All lists of a
shard go through it together, a posting of each at a time.

Search: items' terms are weighed by document frequencies over all shards and joined with the index by term, so that only
the lists that somebody asks for move, to a task for each shard and block of ITEMS items. There each item is searched exactly. The ends of
the blocks of its terms cut the shard into intervals inside which every term stands in one block (or in none), so the sum of weight times
greatest impact bounds any document there: WAND's pivot test, at block boundaries. Intervals below the threshold, the
item's LIMIT-th score so far in this task, are passed over; the others are scored from the highest bound down, some at a time,
and raise it. A shard whose whole lists' maxima stay below it is not opened. Each task hands on LIMIT rows an item,
and a window of limited rank per item puts them together. No item, shard or list is ever cut short, and ties at the
threshold are kept till the end, where the smaller id wins.

Edge cases: null texts have no terms, as documents and as items; such items find nothing. A term that all documents hold
can weigh 0 and then adds nothing; scores of 0 are no results. Equal rows are documents of their own, null ids come last among equal
scores. Items of equal id are one item with the terms of both; a null item_id is an item like others. An empty table gives an empty result. A text longer than a
segment is a shard. Only doc_id (a whole number) or item_id and text are read; other columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import ascii_lower, small_or_shuffled, stored, text_or_empty
from tideline.llm.decontaminate import LOWER

LIMIT = 50
SEGMENT_BYTES = 8 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Impacts are at most a million; a further block is worth this much of error.
BLOCK_COST = 400_000
LONGEST_BLOCK = 64
#: Items searched together.
ITEMS = 256
#: Places scored at a time, at least.
STEP = 256


# --- index


def _terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms; of each text's each term: the term's number, the text's, and how often it is there."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    edge = np.flatnonzero(np.diff(data != 0, prepend=False, append=False))
    first, size = edge[0::2], edge[1::2] - edge[0::2]
    text = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), first, "right") - 1
    ends = np.concatenate(([0], np.cumsum(size))).astype("<i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[data != 0])]).dictionary_encode()
    cell, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + text, return_counts=True)
    return words.dictionary, cell // len(texts), cell % len(texts), tf


def cut_lists(impact: np.ndarray, count: np.ndarray, cost: int = BLOCK_COST, longest: int = LONGEST_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of least bound error. impact: of all lists, one after the other; count: of each list. Gives the first posting of
    every block, and how many blocks each list has."""
    opens = np.zeros(len(impact), bool)
    opens[(np.cumsum(count) - count)[count == 1]] = True
    for low, high, width in ((1, 16, 16), (16, np.iinfo(np.int64).max, longest)):
        some = np.flatnonzero((count > low) & (count <= high))
        some = some[np.argsort(-count[some], kind="stable")]
        if len(some):
            _cut(impact, (np.cumsum(count) - count)[some], count[some], cost, min(width, longest), opens)
    return np.flatnonzero(opens), np.add.reduceat(opens, np.cumsum(count) - count) if len(count) else count


def _cut(impact: np.ndarray, first: np.ndarray, count: np.ndarray, cost: int, width: int, opens: np.ndarray) -> None:
    """first, count: lists by falling length. best[i] is the least cost of the first i postings; slot j % width stands for a block that begins at j."""
    most = int(count[0])
    before = np.zeros((len(count), width), np.int64)  # best[j]
    top = np.zeros((len(count), width), np.int64)  # the greatest impact since j
    best, taken = np.zeros(len(count), np.int64), np.zeros(len(impact), np.int8 if width < 128 else np.int64)
    slots = np.arange(width)
    for i in range(most):
        n = int(np.searchsorted(-count, -i))
        held = min(i + 1, width)
        slot = i % width
        before[:n, slot], top[:n, slot] = best[:n], 0
        here = impact[first[:n] + i]
        np.maximum(top[:n, :held], here[:, None], out=top[:n, :held])
        length = (slot - slots[:held]) % width + 1
        # The impacts themselves are in every way of cutting alike: only greatest times length counts.
        ways = top[:n, :held] * length + before[:n, :held]
        choice = np.argmin(ways, axis=1)
        best[:n] = ways[np.arange(n), choice] + cost
        taken[first[:n] + i] = length[choice] - 1
    at = first + count - 1
    while len(at):
        begin = at - taken[at]
        opens[begin] = True
        more = begin > first
        at, first = begin[more] - 1, first[more]


INDEX = "segment long, term string, n int, places binary, impacts binary, opens binary, tops binary"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _shard(segment: int, texts: list[bytes], n_docs: int, n_terms: int, cost: int) -> Iterator[pa.RecordBatch]:
    """The posting lists of a shard's texts, in the order of their places."""
    terms, term, place, tf = _terms(texts)
    if not len(terms):
        return
    size = np.bincount(place, weights=tf, minlength=len(texts)).astype(np.int64)
    m = 50 + np.array([50 * int(n) * n_docs // n_terms for n in size], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
    count = np.bincount(term, minlength=len(terms))
    first = np.cumsum(count) - count
    opens, blocks = cut_lists(impact, count, cost)
    tops = np.maximum.reduceat(impact, opens)
    within = opens - np.repeat(first, blocks)
    ends, block_ends = (np.concatenate(([0], np.cumsum(x))) for x in (count, blocks))
    within, within_ends = within[within > 0], block_ends - np.arange(len(block_ends))  # that the first block begins at 0 is not stored
    names = terms.cast(pa.large_string()).cast(pa.string())
    for at in range(0, len(terms), 5000):
        upto = min(at + 5000, len(terms))
        pack = lambda x, e: _slices(x.astype("<u4"), e[at : upto + 1])  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(upto - at, segment)), names[at:upto], pa.array(count[at:upto].astype(np.int32)), pack(place, ends), pack(impact, ends), pack(within, within_ends), pack(tops, block_ends)],
            names=NAMES)


def _slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values of four bytes, cut at ends, as binaries."""
    own = np.ascontiguousarray(values[ends[0] : ends[-1]])
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(((ends - ends[0]) * 4).astype("<i4")), pa.py_buffer(own)])


def _dealt(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """Shards of some segment_bytes: number, ids, texts."""
    task, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or b""
            if texts and held + len(text) > segment_bytes:
                yield (task << 32) + number, ids, texts
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(i), texts.append(text)
            held += len(text) + 1
    if texts:
        yield (task << 32) + number, ids, texts


def _indexed(batches: Iterator[pa.RecordBatch], segment_bytes: int, n_docs: int, n_terms: int, cost: int) -> Iterator[pa.RecordBatch]:
    """A row without term holds a shard's ids in the order of their places, those of n documents; what is beyond n has none."""
    for segment, ids, texts in _dealt(batches, segment_bytes):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))  # noqa: B023
        some = np.array([ids[k] for k in order if ids[k] is not None], "<i8")
        one = [[segment], [None], [len(some)], [some.tobytes()], [len(ids).to_bytes(4, "little")], [None], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(one, KINDS, strict=True)], names=NAMES)
        yield from _shard(segment, [texts[k] for k in order], n_docs, n_terms, cost)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of each batch."""
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(0)]
        inside = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)] != 0
        begins = np.flatnonzero(inside & ~np.append(False, inside[:-1])) if len(inside) else np.zeros(0, np.int64)
        of = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), begins, "right")
        yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(of))]), pa.array([len(begins)])], names=["n_docs", "n_terms"])


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, cost: int = BLOCK_COST) -> tuple[DataFrame, int]:
    """The index of docs (doc_id, text) as a table in the shared folder, and the number of documents with a term."""
    sizes = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_sizes, "n_docs long, n_terms long")
    n_docs, n_terms = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(partial(_indexed, segment_bytes=segment_bytes, n_docs=n_docs, n_terms=n_terms, cost=cost), INDEX), "postings"), n_docs


# --- search


class Best:
    """The best of an item so far: scores falling, then ids rising, null last."""

    def __init__(self, limit: int) -> None:
        self.limit, self.score, self.id, self.no_id = limit, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a score must reach."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.limit else 1

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        score, doc, no_id = np.concatenate((self.score, score)), np.concatenate((self.id, doc)), np.concatenate((self.no_id, no_id))
        order = np.lexsort((doc, no_id, -score))[: self.limit]
        self.score, self.id, self.no_id = score[order], doc[order], no_id[order]


class Lists:
    """The posting lists of a shard that some item asks for. Of each list: postings, blocks, greatest impact."""

    def __init__(self) -> None:
        self.place, self.impact, self.opens, self.tops = [], [], [], []

    def add(self, place: np.ndarray, impact: np.ndarray, opens: np.ndarray, tops: np.ndarray) -> int:
        for own, x in zip((self.place, self.impact, self.opens, self.tops), (place, impact, np.concatenate(([0], opens)), tops), strict=True):
            own.append(x.astype(np.int64))
        return len(self.place) - 1


def search_shard(lists: Lists, asked: list[tuple[int, int]], ids: np.ndarray, n_docs: int, best: Best, step: int = STEP) -> int:
    """Update an item's best with a shard's documents. asked: the item's lists and their weights. Gives how many places were scored."""
    asked = [(k, w) for k, w in asked if w > 0]
    if sum(w * int(lists.tops[k].max()) for k, w in asked) < best.least():
        return 0
    place = np.concatenate([lists.place[k] for k, _ in asked])
    part = np.concatenate([lists.impact[k] * w for k, w in asked])
    sizes = np.array([len(lists.place[k]) for k, _ in asked])
    begin = np.concatenate([lists.opens[k] + base for (k, _), base in zip(asked, np.cumsum(sizes) - sizes, strict=True)])  # of each block
    end = np.append(begin[1:], len(place))
    first, last = place[begin], place[end - 1]
    bound = np.concatenate([lists.tops[k] * w for k, w in asked])
    # Between two edges every list stands in one block or in none.
    edge, of = np.unique(np.concatenate((first, last + 1)), return_inverse=True)
    change = np.zeros(len(edge), np.int64)
    np.add.at(change, of, np.concatenate((bound, -bound)))
    limit, width = np.cumsum(change)[:-1], np.diff(edge)
    order = np.argsort(-limit, kind="stable")
    limit, low, width = limit[order], edge[:-1][order], width[order]
    upto = np.cumsum(width)
    at = scored = 0
    while at < len(limit) and limit[at] >= best.least():
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step)) + 1
        stop = min(stop, int(np.searchsorted(-limit, -best.least(), "right")))
        cover = np.zeros(n_docs + 1, np.int64)
        cover[low[at:stop]] += 1
        np.subtract.at(cover, low[at:stop] + width[at:stop], 1)
        chosen = np.cumsum(cover)[:-1] > 0
        before = np.concatenate(([0], np.cumsum(chosen)))
        kept = before[last + 1] > before[first]  # blocks that reach into a chosen interval; the others are not opened
        n = (end - begin)[kept]
        posting = np.repeat(begin[kept] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        posting = posting[chosen[place[posting]]]
        score = np.zeros(n_docs, np.int64)
        np.add.at(score, place[posting], part[posting])
        good = np.flatnonzero(score >= best.least())
        no_id = good >= len(ids)
        best.add(score[good], np.where(no_id, 0, ids[np.minimum(good, len(ids) - 1)] if len(ids) else 0), no_id)
        scored += int(width[at:stop].sum())
        at = stop
    return scored


FOUND = "at long, doc_id long, score long"


def _search(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows come by block of items and shard, the shard's ids first."""
    block = segment = None
    best: dict[int, Best] = {}
    asked: dict[int, list[tuple[int, int]]] = {}
    lists, ids, n_docs = Lists(), np.zeros(0, np.int64), 0

    def finish() -> None:
        for item, some in asked.items():
            search_shard(lists, some, ids, n_docs, best.setdefault(item, Best(limit)))

    def rows() -> pa.RecordBatch:
        n = [len(b.score) for b in best.values()]
        doc = pa.array(np.concatenate([b.id for b in best.values()]), mask=np.concatenate([b.no_id for b in best.values()]))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), n)), doc, pa.array(np.concatenate([b.score for b in best.values()]))], names=["at", "doc_id", "score"])

    for batch in batches:
        own = {c: batch.column(c) for c in batch.schema.names}
        for k in range(batch.num_rows):
            of = lambda c, kind="<u4": np.frombuffer(own[c][k].as_buffer(), kind)  # noqa: B023, E731
            if (own["block"][k].as_py(), own["segment"][k].as_py()) != (block, segment):
                finish()
                if own["block"][k].as_py() != block and best:
                    yield rows()
                    best = {}
                block, segment = own["block"][k].as_py(), own["segment"][k].as_py()
                lists, asked = Lists(), {}
                ids, n_docs = of("places", "<i8"), int(of("impacts")[0])
                continue
            number = lists.add(of("places"), of("impacts"), of("opens"), of("tops"))
            items = own["items"][k].values
            for item, weight in zip(items.field(0).to_pylist(), items.field(1).to_pylist(), strict=True):
                asked.setdefault(item, []).append((number, weight))
    finish()
    if best:
        yield rows()


def search(index: DataFrame, n_docs: int, items: DataFrame, limit: int = LIMIT, most: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents. items: item_id, text."""
    names = stored(items.select("item_id").distinct().withColumn("at", F.monotonically_increasing_id()), "items")
    own = items.join(small_or_shuffled(names.withColumnRenamed("item_id", "of")), F.col("item_id").eqNullSafe(F.col("of")))
    terms = own.select("at", F.explode(F.regexp_extract_all(ascii_lower(text_or_empty()), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    terms = stored(terms, "terms")
    wanted = small_or_shuffled(stored(terms.select("term").distinct(), "wanted"))
    held = index.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    blocks = max(1, -(-names.count() // most))
    block = F.pmod(F.xxhash64("at"), F.lit(blocks)).alias("block")
    asked = terms.join(held.select("term", weight.alias("weight")), "term").groupBy(block, "term").agg(F.collect_list(F.struct("at", "weight")).alias("items"))  # a block's items at most
    lists = index.join(small_or_shuffled(stored(asked, "asked")), "term").select("block", "segment", "places", "impacts", "opens", "tops", "items")
    docs = index.where("term is null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "segment", "places", "impacts", "opens", "tops", F.lit(None).cast("array<struct<at:bigint,weight:bigint>>").alias("items"))
    rows = lists.unionByName(docs).repartition("block", "segment").sortWithinPartitions("block", "segment", F.col("items").isNotNull())
    found = rows.mapInArrow(partial(_search, limit=limit), FOUND)
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.join(small_or_shuffled(names), "at").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    index, n_docs = build_index(docs)
    return search(index, n_docs, items, limit)
