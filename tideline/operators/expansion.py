"""Texts brought to a number of words: by fillers, by translation there and back, or by asking for more words.

A strategy is chosen by name. Fillers are columns; the other two call a model through a slot, and a round of calls reads only the rows that
are still short, which a table in the shared folder holds from round to round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import external
from tideline.functions import text as T
from tideline.functions.numbers import mix
from tideline.operators.cohorts import drawn
from tideline.sources.shared import place, stored

# What a filler says before a sentence.
FILLERS = (
    "As I mentioned earlier, ", "To reiterate the key point, ", "Building on what was discussed, ", "To clarify and expand on this, ", "It's worth emphasizing that ",
    "To put it another way, ", "In other words, ", "More specifically, ", "To elaborate further, ", "It should be noted that ",
)
#: Fillers that a text gets at most.
MOST = 51
SIMILAR = 0.92


def n_words(text: Column) -> Column:
    return F.size(T.words(text))


def filled(text: Column, target: Column, fillers: tuple[str, ...] = FILLERS, seed: int = 42) -> Column:
    """A text with fillers, in turn, until it has `target` words or MOST fillers: each before a sentence that is not the first, at a place
    drawn from the text's hash and the filler's number. A single sentence is said once more behind a filler, and then has a second."""
    listed = F.array(*map(F.lit, fillers))
    sizes = F.array(*(F.lit(len(f.split())) for f in fillers))

    def step(s: Column, i: Column, start: Column, goal: Column) -> Column:
        filler = F.element_at(listed, (i % len(fillers) + 1).cast("int"))
        more = F.element_at(sizes, (i % len(fillers) + 1).cast("int"))
        single = F.size(s.parts) < 2
        at = 1 + F.pmod(mix(start + i), (F.size(s.parts) - 1).cast("long"))
        before = F.transform(s.parts, lambda p, k: F.when(k == at, F.concat(filler, p)).otherwise(p))
        again = F.concat(s.parts, F.array(F.concat(filler, F.lower(s.parts[0]))))
        grown = F.struct(F.when(single, again).otherwise(before).alias("parts"), (s.n + more + F.when(single, n_words(s.parts[0])).otherwise(0)).alias("n"))
        return F.when(s.n >= goal, s).otherwise(grown)

    def all_rounds(v: Column) -> Column:
        first = F.struct(T.sentences(v.text).alias("parts"), n_words(v.text).alias("n"))
        out = F.aggregate(F.sequence(F.lit(0), F.lit(MOST - 1)), first, lambda s, i: step(s, i, v.start, v.goal), lambda s: F.array_join(s.parts, " "))
        return F.when(n_words(v.text) >= v.goal, v.text).otherwise(out)

    start = drawn(seed, text)
    return F.when(text.isNotNull(), T.bind(F.struct(text.alias("text"), start.alias("start"), target.cast("int").alias("goal")), all_rounds))


def _by_calls(rows: DataFrame, factory: Callable[[], external.Batch], prompt: Callable[[Column, Column], Column], rounds: int, again: bool) -> DataFrame:
    """rows (id_, text, target) with expanded. A round asks for the rows that are short; again: from what the last round gave."""
    spark, path = rows.sparkSession, place(rows.sparkSession, "expanded")
    short = rows.select("id_", F.col("text").alias("from_"), F.col("text").alias("expanded"), "target").where(n_words(F.col("text")) < F.col("target"))
    for k in range(rounds):
        asked = external.respond(short.withColumn("asked_", prompt(F.col("expanded" if again else "from_"), F.col("target"))), "asked_", factory, "said_")
        said = F.when((F.col("said_") != "") & F.col("error").isNull(), F.col("said_"))
        # What failed keeps its text; of attempts from the same text the longest counts.
        best = F.coalesce(said, F.col("expanded")) if again else F.when(n_words(F.coalesce(said, F.lit(""))) > n_words(F.col("expanded")), said).otherwise(F.col("expanded"))
        done = stored(asked.select("id_", "from_", best.alias("expanded"), "target"), f"{path}/round={k}")
        short = done.where(n_words(F.col("expanded")) < F.col("target"))
        if short.isEmpty():
            break
    if rounds == 0:
        return rows.withColumn("expanded", F.col("text"))
    found = spark.read.schema("id_ long, expanded string, round int").option("basePath", path).parquet(path)
    last = found.groupBy("id_").agg(F.max_by("expanded", "round").alias("expanded"))
    return rows.join(last, "id_", "left").withColumn("expanded", F.coalesce("expanded", "text"))


def more_words(text: Column, target: Column) -> Column:
    """The request to say a text in so many words."""
    ratio = F.format_number(target / F.greatest(n_words(text), F.lit(1)), 1)
    return F.concat(F.lit("Say the following at greater length, about "), ratio, F.lit(" times as long, without changing what it means:\n\n"), text)


def expander(strategy: str, factory: Callable[[], external.Batch] | None = None, fillers: tuple[str, ...] = FILLERS, rounds: int = 3, attempts: int = 5, similarity: Callable[[Column, Column], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """By name: cri (fillers), bte (factory's batch translates there and back, up to `rounds` times), cpi (factory's batch answers a
    request for more words, up to `attempts` times). What is returned takes rows (text, target) and adds expanded, words,
    expanded_words, strategy and success: the target is reached and, where a similarity of both texts is given, it is at least SIMILAR."""
    if strategy not in ("cri", "bte", "cpi"):
        raise ValueError(f"no such strategy: {strategy}")
    if strategy != "cri" and factory is None:
        raise ValueError(f"{strategy} needs a model to call")

    def expand(rows: DataFrame) -> DataFrame:
        if strategy == "cri":
            out = rows.withColumn("expanded", filled(F.col("text"), F.col("target"), fillers))
        else:
            numbered = stored(rows.withColumn("id_", F.monotonically_increasing_id()), place(rows.sparkSession, "short"))
            ask = (lambda t, _: t) if strategy == "bte" else more_words
            out = _by_calls(numbered, factory, ask, rounds if strategy == "bte" else attempts, strategy == "bte").drop("id_")
        alike = similarity(F.col("text"), F.col("expanded")) >= SIMILAR if similarity else F.lit(True)
        sized = out.withColumns({"words": n_words(F.col("text")), "expanded_words": n_words(F.col("expanded")), "strategy": F.lit(strategy)})
        return sized.withColumn("success", (F.col("expanded_words") >= F.col("target")) & alike)

    return expand
