"""Mixing sources to target weights by Pareto order sampling.

Targets: the mix is RATIO times all words; a source's share is its weight's, never above CEILING times its own
words, the excess going to the others by weight until none is above. A source whose target is r times its words
first takes floor(r) whole copies of every document (certain); what is left, R words, is a Pareto sample: a
document's inclusion probability p rises with its length class (the bit length b of its word count: p = min(1,
c * b), c solved so that the expected words are R), and documents are ranked by their random odds over their
inclusion odds, (u / (1 - u)) / (p / (1 - p)). The sample has a fixed size in words: the ranking is cut where the
words taken are nearest to R, off by half a document at most. u comes from a hash of the id, so reruns agree.

No source is ever in one place: words are summed by source and one of BUCKETS slices of the ranking, and only the
slice where the cut falls is ranked row by row. The cut of each source goes back to the documents as a filter.

Edge cases: a null text has size 0, an empty one too; they take 0 words. Texts of any length count whole. Rows with equal doc_id share u and are
taken or left together; rows without an id draw by their text. The null source comes last. An empty table, or
one without words, gives rows with target 0. Columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import small_or_shuffled, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
RATIO = 1.5
CEILING = 2.0
#: Slices of the ranking in which words are summed before the cut is sought.
BUCKETS = 4096
SALT = "mix"


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight: sources by code point, null last, take the weights in turn."""
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranged = stored(totals.orderBy(F.col("source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("at")), "ranged")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part")).count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a partition
    position = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int")).cast("double")
    return ranged.join(before, part == F.col("part")).select("source", "source_size", weight.alias("weight"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target. Each round sums over the sources; it ends when no source is above its ceiling."""
    found = stored(source_weights(sizes, weights), "weights")
    above, level = F.lit(False), None
    total = float(found.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        held, free = found.agg(F.sum(F.when(above, F.col("source_size") * ceiling)), F.sum(F.when(~above, F.col("weight")))).first()
        now = (total * ratio - (held or 0.0)) / free if free else level or 0.0
        if now == level:
            break
        level = now
        above = F.col("weight") * level > F.col("source_size") * ceiling
    return found.select("source", "source_size", F.when(above, F.col("source_size") * ceiling).otherwise(F.col("weight") * level).alias("target"))


def uniform(salt: str = SALT) -> F.Column:
    """In (0, 1), from the id, or the text of a row without id."""
    return (F.conv(F.substring(draw(salt), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def draw(salt: str = SALT) -> F.Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    return F.md5(F.concat(F.lit(f"{salt}:"), name))


def length_class(size: F.Column) -> F.Column:
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def _plan(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole (certain copies), rest (words to sample), c (inclusion by length class)."""
    goals = goals.withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goals = goals.withColumn("whole", F.floor("r").cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # At most 64 length classes a source: c is the first, from the longest class down, that keeps the class below 1.
    by_class = sizes.groupBy("source", length_class(F.col("size")).alias("b")).agg(F.sum("size").alias("words")).where("b > 0")
    same = by_class.source.eqNullSafe(goals.source)
    up = Window.partitionBy(by_class.source).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    classes = by_class.join(goals, same).select(by_class.source, "b", "words", "source_size", "rest", F.sum(F.col("b") * F.col("words")).over(up).alias("scaled"), F.sum("words").over(up).alias("below"))
    c = (F.col("rest") - (F.col("source_size") - F.col("below"))) / F.col("scaled")
    solved = classes.withColumn("c", c).where(F.col("c") * F.col("b") <= 1).groupBy("source").agg(F.max_by("c", "b").alias("c"))
    return goals.join(solved, goals.source.eqNullSafe(solved.source), "left").select(goals.source, "source_size", "target", "whole", "rest", F.coalesce("c", F.lit(0.0)).alias("c"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds q (odds over odds; null: never taken) and u_key, which orders equal q."""
    p = F.least(F.col("c") * length_class(F.col("size")), F.lit(1.0))
    q = F.when(p >= 1, 0.0).when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    return rows.withColumn("q", q)


def cuts(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, ceiling: float = CEILING) -> DataFrame:
    """Per source: its plan, and the place (cut_q, cut_key) of the last document that its sample takes. sizes: source, size, u, u_key."""
    plan = stored(_plan(sizes, targets(sizes, weights, ratio, ceiling)), "plan")
    hint = small_or_shuffled(plan.withColumnRenamed("source", "of"))
    ranked = _ranked(sizes.join(hint, F.col("source").eqNullSafe(F.col("of"))).where("rest > 0 and size > 0")).where("q is not null")
    ranked = ranked.withColumn("slice", F.floor(F.col("q") / (F.col("q") + 1) * BUCKETS).cast("int")).select("source", "size", "q", "u_key", "slice", "rest")
    up = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    slices = slices.withColumn("before", F.sum("words").over(up) - F.col("words"))
    # The slice of the cut: the last that begins at or below what is left to take (before it all are taken, after it none).
    edge = stored(slices.where("before <= rest").groupBy("source").agg(F.max("slice").alias("edge"), F.max("before").alias("base")), "edges")
    hint = small_or_shuffled(edge.withColumnRenamed("source", "of"))
    inside = ranked.join(hint, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("edge")))
    units = inside.groupBy("source", "q", "u_key").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    up = Window.partitionBy("source").orderBy("q", "u_key").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("before", F.col("base") + F.sum("words").over(up) - F.col("words"))
    last = units.where("before + words / 2 <= rest").groupBy("source").agg(F.max(F.struct("q", "u_key")).alias("last"))
    cut = edge.join(last, edge.source.eqNullSafe(last.source), "left").select(edge.source.alias("of"), "edge", F.col("last.q").alias("cut_q"), F.col("last.u_key").alias("cut_key"))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, ceiling: float = CEILING, salt: str = SALT) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target (both the source's) and taken: the document's
    words times the copies that the mix takes of it."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*own).alias("own"), F.col("source").alias("key"), size.alias("size"), uniform(salt).alias("u"), draw(salt).alias("u_key"))
    sizes = stored(sized.select(F.col("key").alias("source"), "size", "u", "u_key"), "sizes")
    cut = stored(cuts(sizes, weights, ratio, ceiling), "cuts").withColumnRenamed("source", "of")
    rows = _ranked(sized.join(small_or_shuffled(cut), F.col("key").eqNullSafe(F.col("of")), "left"))
    slice_ = F.floor(F.col("q") / (F.col("q") + 1) * BUCKETS).cast("int")
    ahead = (F.col("q") < F.col("cut_q")) | ((F.col("q") == F.col("cut_q")) & (F.col("u_key") <= F.col("cut_key")))
    sampled = F.col("q").isNotNull() & F.col("edge").isNotNull() & ((slice_ < F.col("edge")) | F.coalesce((slice_ == F.col("edge")) & ahead, F.lit(False)))
    copies = F.col("whole") + F.when(sampled & (F.col("rest") > 0), 1).otherwise(0)
    return rows.select("own.*", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
