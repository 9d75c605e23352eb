"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has bit b set if more than half of its shingle hashes have it. Fingerprints are
grouped by text-independent means only: equal fingerprints collapse first (so a group of exact copies is
one row, however large), the distinct ones are dealt out by bands of their bits (two fingerprints within
the radius agree on at least one key, so no link is lost), and each bucket is compared bit-sliced: 64
fingerprints stand vertically, one word per bit plane, and one XOR and a carry-save adder update 64 distances
at once; a word of 64 candidates is abandoned as soon as all its distances exceed the radius. Buckets over
CHUNK rows are cut into chunks and compared chunk against chunk, each pair of chunks in a place of its own. Only
a spanning forest of the links leaves a task; components come from alternating large and small stars.

Edge cases: a null or blank text has fingerprint 0 and links like any other. Rows with equal doc_id are
separate rows of the result. Rows with a null doc_id take part, but never name a component: component_id
is null if no row of the component has an id. An empty table gives an empty result.

keep_one, the pipeline's stage, links by Jaccard similarity of five-word shingles: fingerprints of shingle sets are compared
bit-sliced where two sets share a rare shingle, and what is within a wide radius is confirmed by the sets themselves: pair by
pair where pairs are few, else in crowds of sets that meet whole, so that no group's pairs become rows.

Very long texts are hashed piece by piece, and texts of any length have one fingerprint. Extra columns pass keep_one untouched,
whatever their names; near_duplicates reads doc_id (a whole number) and text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BROADCAST_ROWS, discard, small_or_shuffled, stored

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Near-copies (keep_one): words of a shingle, and the least Jaccard similarity as a fraction.
COPY_WIDTH = 5
COPY_LEAST = (4, 5)
#: Sets of exactly COPY_LEAST differ in some 10 of 64 bits, with a deviation of 3: beyond this radius lies at most one link in five million, of sets under
#: 16 shingles one in 75,000 (tests/llm/test_near_copies.py has the sum); more similar sets are nearer.
COPY_RADIUS = 26
#: One document in so many says which shingles are common; this changes the work, not the result.
ORDER_SAMPLE = 64
#: Rows of a bucket that are compared in one place; larger buckets are cut.
CHUNK = 2048
#: (word of 64 candidates, fingerprint) pairs compared in one go: bounds a task's memory.
STEP = 40_000
#: Rows that a task compares together, besides the last unit's: bounds its memory too.
GATHER = 50_000
#: A unit with more candidate pairs than so many times its rows is dense: which sets have one leaves the task, not the pairs.
DENSE = 8
#: Shingles of a chunk of sets that meet whole: bounds a task's memory.
CELLS = 1_000_000


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of `width` words, space-joined; of the whole sequence if there are fewer; none without words."""
    words = text.lower().split()  # on bytes: ASCII letters, and the six ASCII white-space characters
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """Bit b set if more than half of the 64-bit hashes have it."""
    hashes = hashes.astype(">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    return majority(np.array(shingle_hashes(text, width, seed), np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width, seed) for t in batch.column(2)]
        signed = np.array(prints, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed)], names=["doc_id", "mark", "print"])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, mark (a hash of the text) and the fingerprint as a signed 64-bit number, a row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, width=width, seed=seed), "doc_id long, mark long, print long")


def bands(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Keys that any two fingerprints within the radius share at least one of, each a list of (first bit, bits).

    64 bits in radius + k blocks: at most `radius` blocks differ, so k agree. More blocks make longer keys (fewer
    candidates a bucket) and more of them; any choice finds every link.
    """
    agree = 1 if n <= 3_000_000 else 2 if n <= 1_000_000_000 else 3
    edges = np.linspace(0, 64, radius + agree + 1).astype(int).tolist()
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(blocks, agree)]


def _key(number: int, parts: list[tuple[int, int]]) -> F.Column:
    key = F.lit(number).cast("long")
    for first, bits in parts:
        key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(F.col("print"), first).bitwiseAND(F.lit((1 << bits) - 1)))
    return key


def bit_planes(words: np.ndarray) -> np.ndarray:
    """(blocks, 64) fingerprints to (blocks, 64) planes: bit 63 - r of plane p is bit 63 - p of fingerprint r."""
    out = np.empty(words.shape, np.uint64)
    for at in range(0, len(words), 2048):
        bits = np.unpackbits(words[at : at + 2048].astype(">u8").view(np.uint8).reshape(-1, 64, 8), axis=2)
        turned = np.packbits(bits.transpose(0, 2, 1), axis=2)
        out[at : at + 2048] = turned.reshape(-1, 64 * 8).view(">u8")
    return out


def _add(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder of three words of one-bit counters: sum and carry."""
    u = total ^ x
    return u ^ y, (total & x) | (u & y)


def near_lanes(planes: np.ndarray, block: np.ndarray, prints: np.ndarray, dead: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a block and a fingerprint have candidates within the radius, and the 64-bit mask of those.

    dead: lanes that hold no candidate. The counters are three words for 0 to 7, one more for each power of two up to the
    radius, and a sticky word for what is beyond.
    """
    live = np.arange(len(block))
    ones = twos = fours = sticky = np.zeros(len(block), np.uint64)
    high = [ones] * max(0, radius.bit_length() - 3)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for group in range(0, 64, 8):
        x = []
        for p in range(group, group + 8):
            own = np.uint64(0) - ((prints >> np.uint64(63 - p)) & np.uint64(1))
            x.append(planes[block, p] ^ own)
        ones, a = _add(ones, x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, c = _add(twos, a, b)
        ones, a = _add(ones, x[4], x[5])
        ones, b = _add(ones, x[6], x[7])
        twos, d = _add(twos, a, b)
        fours, carry = _add(fours, c, d)
        for k, word in enumerate(high):
            high[k], carry = word ^ carry, word & carry
        sticky = sticky | carry
        over = sticky | dead | _above((ones, twos, fours, *high), radius)
        keep = over != full
        if not keep.all():
            live, block, prints, dead, over = live[keep], block[keep], prints[keep], dead[keep], over[keep]
            ones, twos, fours, sticky, *high = (w[keep] for w in (ones, twos, fours, sticky, *high))
        if not len(live):
            return live, np.zeros(0, np.uint64)
    return live, ~over


def _above(counter: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """Lanes whose counter, a word for each bit, is above `most`."""
    over, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for bit in reversed(range(len(counter))):
        if most >> bit & 1:
            equal = equal & counter[bit]
        else:
            over, equal = over | (equal & counter[bit]), equal & ~counter[bit]
    return over


class Forest:
    """Union by smallest index, many links at once."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = self.root[u], self.root[v]
            differ = u != v
            u, v = u[differ], v[differ]
            np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def meetings(unit: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the radius, some at a time. Rows, in order of unit and side, with equal unit meet: side 0 among
    itself if alone, else side 0 with 1."""
    cut = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    end = np.append(cut[1:], len(unit))
    zeros = np.add.reduceat((side == 0).astype(np.int64), cut)
    alone = zeros == end - cut
    t0, t1 = np.where(alone, cut, cut + zeros), end  # what stands in planes
    n_blocks = -(-(t1 - t0) // 64)
    first = np.cumsum(n_blocks) - n_blocks
    block_unit = np.repeat(np.arange(len(cut)), n_blocks)
    block_at = t0[block_unit] + 64 * (np.arange(len(block_unit)) - first[block_unit])
    rows = block_at[:, None] + np.arange(64)
    held = rows < t1[block_unit][:, None]
    planes = bit_planes(np.where(held, prints[np.minimum(rows, len(prints) - 1)], 0))
    lanes = np.packbits(~held, axis=1).view(">u8").ravel().astype(np.uint64)
    total = np.cumsum(zeros * n_blocks)
    for at in range(0, int(total[-1]), STEP):
        k = np.arange(at, min(at + STEP, int(total[-1])))
        of = np.searchsorted(total, k, side="right")
        k = k - (total[of] - zeros[of] * n_blocks[of])
        row, block = cut[of] + k // n_blocks[of], first[of] + k % n_blocks[of]
        ahead = (~alone[of]) | (block_at[block] + 63 > row)  # a pair within a unit is met once
        row, block = row[ahead], block[ahead]
        live, mask = near_lanes(planes, block, prints[row], lanes[block], radius)
        bits = np.unpackbits(mask.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        pair, lane = np.nonzero(bits)
        yield row[live][pair], block_at[block[live][pair]] + lane


def links_in(unit: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the meetings, as fingerprints."""
    order = np.lexsort((prints, side, unit))
    unit, side, prints = unit[order], side[order], prints[order]
    nodes, node = np.unique(prints, return_inverse=True)
    forest = Forest(len(nodes))
    for u, v in meetings(unit, side, prints, radius):
        forest.join(node[u], node[v])
    linked = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[linked], nodes[forest.root[linked]]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Numbers of the units, and the rows, of GATHER rows or more in whole units at a time. Rows are sorted by unit: their
    first three columns."""
    held, n = [], 0

    def numbered(table: pa.Table) -> np.ndarray:
        columns = [table.column(i).to_numpy() for i in range(3)]
        return np.cumsum(np.any([np.diff(c, prepend=c[:1]) != 0 for c in columns], axis=0))

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHER:
            rows = pa.Table.from_batches(held).combine_chunks()
            unit = numbered(rows)
            whole = int(np.searchsorted(unit, unit[-1]))
            if whole:
                yield unit[:whole], rows.slice(0, whole)
            held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
    if n:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield numbered(rows), rows


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for unit, rows in gathered(batches):
        side, prints = rows.column("side").to_numpy(), rows.column("print").to_numpy().view(np.uint64)
        u, v = links_in(unit, side, prints, radius)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def units(rows: DataFrame, key: str, member: str, cells: str | None = None) -> DataFrame:
    """rows dealt out by units (key, a, b), sorted: a key's rows are cut into chunks of about CHUNK (and CELLS of a column of sizes),
    and every two chunks, and each with itself, meet in a place of their own; side tells a's rows (0) from b's (1)."""
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(cells) / CELLS) if cells else F.count("*") / CHUNK).cast("int")
    large = rows.groupBy(key).agg(chunks.alias("chunks")).where("chunks > 1").withColumnRenamed(key, "key_")
    rows = rows.join(small_or_shuffled(stored(large, "buckets")), F.col(key) == F.col("key_"), "left").drop("key_").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64(member, key), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == a, 0).otherwise(1)
    rest = [c for c in rows.columns if c not in (key, "own", "other", "chunks")]
    return rows.select(F.col(key).alias("key"), a.alias("a"), b.alias("b"), side.alias("side"), *rest).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: enough links between the distinct fingerprints of a stored table `print` to connect all that are connected."""
    keys = bands(prints.count(), radius)
    dealt = prints.select("print", F.explode(F.array(*[_key(i, k) for i, k in enumerate(keys)])).alias("band"))
    return units(dealt, "band", "print").mapInArrow(partial(_links, radius=radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge: alternating large and small stars."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", "m")).distinct(), "stars")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, mark (a hash of the text), fingerprint (16 hex digits), component_id of every row of docs (doc_id, text)."""
    marked = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(marked.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(distinct.select("print"), radius))
    member = linked.select(F.col("node").alias("print"), "root").union(linked.select("root", "root").distinct())
    named = distinct.join(member, "print").groupBy("root").agg(F.min("first").alias("least"))
    member = stored(member.join(named, "root").select("print", "least"), "members")
    named = distinct.join(small_or_shuffled(member), "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))
    return marked.join(named, "print").select("doc_id", "mark", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def copy_shingles(text: bytes) -> np.ndarray:
    """The set of a text's COPY_WIDTH-word shingles as sorted signed hashes."""
    return np.unique(np.array(shingle_hashes(text, COPY_WIDTH), np.uint64).view(np.int64))


def _set_id(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), SEED)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the id, size and fingerprint of its set of shingles."""
    for batch in batches:
        found = [(_set_id(held), len(held), majority(held.view(np.uint64))) for held in map(copy_shingles, _bytes(batch.column(2)))]
        ids, sizes, prints = zip(*found, strict=True) if found else ((), (), ())
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed[0], pa.array(sizes, pa.int32()), signed[1]], names=["doc_id", "mark", "id", "size", "print"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [copy_shingles(t) for t in _bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))], names=["gram"])


def _firsts(batches: Iterator[pa.RecordBatch], late: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first fifth of each set of shingles: rare ones (not in `late`) first."""
    for batch in batches:
        ids, firsts = [], []
        for held in map(copy_shingles, _bytes(batch.column(0))):
            at = np.minimum(np.searchsorted(late, held), max(len(late) - 1, 0))
            order = np.lexsort((held, np.where(late[at] == held, rank[at], 0))) if len(late) else np.arange(len(held))
            firsts.append(held[order[: len(held) - -(-len(held) * COPY_LEAST[0] // COPY_LEAST[1]) + (len(held) > 0)]])
            ids.append(_set_id(held))
        own = np.repeat(np.array(ids, np.uint64).view(np.int64), [len(f) for f in firsts])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])), pa.array(own)], names=["gram", "id"])


def _apart(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a unit with different labels, sizes that allow COPY_LEAST, and fingerprints within the radius; of a dense unit
    every set that has such a pair, beside the first of these."""
    up, down = COPY_LEAST
    for unit, rows in gathered(batches):
        side, prints, ids, sizes, labels = (rows.column(c).to_numpy() for c in ("side", "print", "id", "size", "label"))
        sizes = sizes.astype(np.int64)
        most = DENSE * np.bincount(unit)
        count, paired = np.zeros(len(most), np.int64), np.zeros(len(unit), bool)
        held = [(np.zeros(0, np.int64),) * 2]
        for u, v in meetings(unit, side, prints.view(np.uint64), radius):
            good = (labels[u] != labels[v]) & (np.minimum(sizes[u], sizes[v]) * down >= np.maximum(sizes[u], sizes[v]) * up)
            u, v = u[good], v[good]
            paired[u] = paired[v] = True
            count += np.bincount(unit[u], minlength=len(most))
            few = (count <= most)[unit[u]]
            held.append((u[few], v[few]))
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        few = (count <= most)[unit[u]]
        u, v = ids[u[few]], ids[v[few]]
        crowd = np.flatnonzero(paired & (count > most)[unit])
        first = crowd[np.searchsorted(unit[crowd], unit[crowd])]
        columns = (np.concatenate((np.minimum(u, v), ids[first])), np.concatenate((np.maximum(u, v), ids[crowd])), np.arange(len(u) + len(crowd)) >= len(u))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "dense"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a home and a guest whose sets have COPY_LEAST. Rows are sorted by home and part, the home's own text first."""
    up, down = COPY_LEAST
    at, own = None, np.zeros(0, np.int64)
    for batch in batches:
        u, v = [], []
        for home, part, guest, text in zip(*(batch.column(i).to_pylist() for i in range(3)), _bytes(batch.column(3)), strict=True):
            held = copy_shingles(text)
            if guest is None:
                at, own = (home, part), held
            elif at == (home, part) and len(np.intersect1d(own, held, True)) * (up + down) >= up * (len(own) + len(held)):
                u.append(home)
                v.append(guest)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the stored pairs u, v of sets those with Jaccard similarity of COPY_LEAST or more, by their whole sets. A set's text goes
    where the pairs are that it is the home (u) of, in parts of CHUNK guests."""
    homes = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    guests = pairs.join(homes, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("guest"), F.col("v").alias("id"))
    own = homes.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("guest"), F.col("u").alias("id"))
    wanted = guests.union(own).join(sets.select("id", F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")), "id")
    wanted = wanted.select("u", "part", "guest", "of_id", "of_mark").hint("merge")  # as at any scale: texts go to their pairs
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))
    rows = texts.join(wanted, same).select("u", "part", "guest", "text").repartition("u", "part").sortWithinPartitions("u", "part", F.col("guest").asc_nulls_first())
    return rows.mapInArrow(_confirmed, "u long, v long").distinct()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple]]:
    """Side, label, fingerprint and set of every id of a unit, unit by unit. Rows are sorted by unit and side."""
    at, held = None, {}
    for batch in batches:
        for key, a, b, side, one, label, mark, text in zip(*(batch.column(i).to_pylist() for i in range(7)), _bytes(batch.column(7)), strict=True):
            if at != (key, a, b):
                if held:
                    yield held
                at, held = (key, a, b), {}
            if one not in held:
                held[one] = side, label, mark, copy_shingles(text)
    if held:
        yield held


def similar(side: np.ndarray, labels: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], radius: int) -> Iterator[tuple[int, int]]:
    """Places of links of a spanning forest between the labels: sets with COPY_LEAST whose fingerprints are within the radius."""
    up, down = COPY_LEAST
    root = np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    start = np.cumsum(sizes) - sizes
    grams, gram = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(grams), bool)
    for left, right in meetings(np.zeros(len(side), np.int64), side, prints, radius):
        good = (root[left] != root[right]) & (np.minimum(sizes[left], sizes[right]) * down >= np.maximum(sizes[left], sizes[right]) * up)
        left, right = left[good], right[good]
        order = np.argsort(left, kind="stable")
        for u, v in zip(*(np.split(x[order], np.flatnonzero(np.diff(left[order])) + 1) for x in (left, right)), strict=True):
            v = v[root[v] != root[u[:1]]]
            if not len(v):
                continue
            u = u[0]
            first = np.cumsum(sizes[v]) - sizes[v]
            at = np.repeat(start[v] - first, sizes[v]) + np.arange(sizes[v].sum())
            mine = gram[start[u] : start[u] + sizes[u]]
            own[mine] = True
            common = np.add.reduceat(own[gram[at]], first, dtype=np.int64)
            own[mine] = False
            near = v[common * (up + down) >= up * (sizes[u] + sizes[v])]
            for w in near[np.unique(root[near], return_index=True)[1]]:
                yield u, w
                root[root == root[w]] = root[u]


def _crowd_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for held in _whole(batches):
        side, labels, prints, sets = zip(*held.values(), strict=True)
        found = list(similar(np.array(side), np.array(labels), np.array(prints).view(np.uint64), list(sets), radius))
        ids, (u, v) = np.array(list(held)), np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])


def crowd_links(crowds: DataFrame, label: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: enough links to connect all similar sets of a crowd (root) whose labels differ. crowds (stored): node, root. Texts go
    once to each unit of two chunks of their crowd; links are confirmed there, and a spanning forest of them leaves the task."""
    inside = crowds.union(crowds.select("root", "root").distinct()).select(F.col("node").alias("id"), F.col("root").alias("crowd"))
    inside = inside.join(label, F.col("id") == F.col("node"), "left").select("id", "crowd", F.coalesce("root", "id").alias("label"))
    wanted = inside.join(sets.select("id", "size", "print", F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).hint("merge"), "id")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))
    rows = texts.join(small_or_shuffled(stored(wanted, "crowd-sets")), same)
    rows = stored(rows.select("crowd", "id", "label", "print", "text", "size"), "crowd-texts")
    dealt = units(rows, "crowd", "id", "size").select("key", "a", "b", "side", "id", "label", "print", "text")
    found = stored(dealt.mapInArrow(partial(_crowd_links, radius=COPY_RADIUS), "u long, v long"), "crowd-links")
    discard(rows)
    return found


def copy_links(sets: DataFrame, texts: DataFrame, late: np.ndarray, rank: np.ndarray) -> DataFrame:
    """u, v: enough pairs of similar sets to connect all that are connected. sets (stored): id, size, print, doc_id, mark (of
    one text); texts: doc_id, mark, text.

    Two similar sets share a shingle of their first fifths, in whatever order common to all. First every set meets only
    one set of each shared shingle; where all sets of a shingle are connected by then, no other pair of it counts. The
    others meet bit-sliced, in units of two chunks. Of units that are not dense the pairs are confirmed one by one; the sets of
    dense ones that are connected by dense units are a crowd, and meet whole.
    """
    up, down = COPY_LEAST
    dealt = texts.select("text").mapInArrow(partial(_firsts, late=late, rank=rank), "gram long, id long")
    shared = dealt.groupBy("gram").agg(F.min("id").alias("home"), F.max("id").alias("last")).where("home < last").drop("last")
    shared = stored(shared, "shared")
    held = stored(dealt.join(small_or_shuffled(shared), "gram").distinct(), "held")
    discard(shared)
    known = sets.hint("merge")  # as many as different texts
    a, b = (known.select(F.col("id").alias(f"id_{x}"), F.col("size").alias(f"size_{x}"), F.col("print").alias(f"print_{x}")) for x in "ab")
    near = (F.least("size_a", "size_b") * down >= F.greatest("size_a", "size_b") * up) & (F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= COPY_RADIUS)
    stars = held.where("id <> home").select(F.col("home").alias("u"), F.col("id").alias("v")).distinct()
    stars = stored(stars.join(a, F.col("u") == F.col("id_a")).join(b, F.col("v") == F.col("id_b")).where(near).select("u", "v"), "star-pairs")
    linked = stored(confirmed(stars, sets, texts), "star-links")
    label = components(linked)
    label = small_or_shuffled(stored(label.union(label.select("root", "root").distinct()), "labels"))
    open_ = held.join(label, F.col("id") == F.col("node"), "left").select("gram", "id", F.coalesce("root", "id").alias("label"))
    open_ = stored(open_, "open")
    mixed = open_.groupBy("gram").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("n > 2 and a <> b").select("gram")
    open_ = open_.join(stored(mixed, "mixed").hint("merge"), "gram", "left_semi")
    open_ = stored(open_.join(known.select(F.col("id").alias("id_"), "size", "print"), F.col("id") == F.col("id_")).drop("id_"), "mixed-sets")
    discard(held)
    rest = stored(units(open_, "gram", "id").mapInArrow(partial(_apart, radius=COPY_RADIUS), "u long, v long, dense boolean").distinct(), "rest")
    crowded = crowd_links(components(rest.where("dense").select("u", "v")), label, sets, texts)
    met = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = stored(rest.where("not dense").select("u", "v").join(met, ["u", "v"], "left_anti"), "rest-pairs")
    return linked.union(crowded).union(confirmed(rest, sets, texts))


def keep_one(docs: DataFrame) -> DataFrame:
    """Docs with one document of each group of near-copies (connected by Jaccard similarities of COPY_LEAST or more of their
    sets of COPY_WIDTH-word shingles): that with the smallest doc_id, without ids that with the smallest hash of its text.
    Rows of equal doc_id and text count as one. Links are confirmed exactly; a sample of the documents only says which
    shingles are common, and those come last in the order that finds candidates, which any order does. Texts without words
    are one group."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    some = texts.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(ORDER_SAMPLE)) == 0).select("text").mapInArrow(_grams, "gram long")
    common = some.groupBy("gram").count().where("count > 1").orderBy(F.desc("count"), "gram").limit(BROADCAST_ROWS).toArrow()
    late, rank = common.column("gram").to_numpy(), common.column("count").to_numpy()
    order = np.argsort(late)
    marked = stored(texts.mapInArrow(_sets, "doc_id long, mark long, id long, size int, print long"), "marked")
    sets = marked.where("size > 0").groupBy("id").agg(F.first("size").alias("size"), F.first("print").alias("print"), F.min(F.struct("doc_id", "mark")).alias("row"))
    sets = stored(sets.select("id", "size", "print", "row.doc_id", "row.mark"), "sets")
    linked = stored(components(copy_links(sets, texts, late[order], rank[order])), "linked")
    member = linked.union(linked.select("root", "root").distinct())
    named = marked.groupBy("id").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "mark")).alias("best"), F.count("*").alias("n"))
    named = named.join(small_or_shuffled(stored(member, "members")), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("group"), "best", "n")
    named = stored(named, "named")
    best = named.groupBy("group").agg(F.min("best").alias("kept"), F.sum("n").alias("all")).where("all > 1").drop("all")
    best = stored(named.join(best.hint("merge"), "group").select("id", F.col("kept.doc_id").alias("kept_id"), F.col("kept.mark").alias("kept_mark")), "best")
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    gone = stored(marked.join(small_or_shuffled(best), "id").where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "gone")
    again = stored(marked.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("mark").alias("again_mark")), "again")
    known = small_or_shuffled(gone)
    left = docs.join(known, docs.doc_id.eqNullSafe(known.gone_id) & (F.xxhash64(docs.text) == known.gone_mark), "left_anti")
    if not again.limit(1).count():
        return left
    twice = small_or_shuffled(again)
    same = left.doc_id.eqNullSafe(twice.again_id) & (F.xxhash64(left.text) == twice.again_mark)
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
