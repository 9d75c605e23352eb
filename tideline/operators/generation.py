"""From a conversation's plan to its user turns, and from turns to the requests that generate them.

A plan is a row: conv_id, num_turns, arc and topics (arrays of texts), twists (array of structs turn, twist), callbacks (array of
turns); turns count from 0. What one row becomes many of is exploded; what has to be seen in order, conversation by conversation,
is a window over its batches, each of which carries three messages and ten notes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType
from pyspark.sql.window import Window

from tideline.functions import text as T
from tideline.operators.cohorts import friction, uniform

#: An arc's mood lasts so many turns.
MOOD_TURNS = 5
#: Of messages before a batch, and of solved problems: how many are told, and of a message how much.
RECENT, RECENT_CHARS, NOTES = 3, 100, 10


def turns_of(plans: DataFrame) -> DataFrame:
    """A row for each turn of a plan: turn, emotion, topic, twist, callback. What a plan leaves out is general talk in a neutral mood."""
    if not isinstance(plans.schema["num_turns"].dataType, IntegralType):
        raise AnalysisException(f"num_turns must be a whole number, not {plans.schema['num_turns'].dataType.simpleString()}")
    for name in ("arc", "topics", "twists", "callbacks"):
        if not isinstance(plans.schema[name].dataType, ArrayType):
            raise AnalysisException(f"{name} must be an array, not {plans.schema[name].dataType.simpleString()}")
    turn, n = F.col("turn"), F.col("num_turns").cast("int")
    at = lambda items, k, other: F.when(F.size(items) > 0, F.get(items, F.least(k, F.size(items) - 1))).otherwise(other)
    # A plan is short, its turns are many: a file of plans that one task could read is dealt out first, by conversation.
    parts = int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plans.repartition(parts, "conv_id").select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("turn"))
    return rows.withColumns({
        "emotion": at("arc", F.floor(turn / MOOD_TURNS).cast("int"), "neutral"), "topic": at("topics", turn, "general"),
        "twist": F.try_element_at(F.filter("twists", lambda x: x.turn == turn), F.lit(-1)).twist,  # of two on a turn the last
        "callback": F.coalesce(F.array_contains("callbacks", turn), F.lit(False))})


def batch_size(num_turns: Column) -> Column:
    """Turns asked for at once: all of a short conversation, 20 of a middling one, else 15."""
    return F.when(num_turns <= 15, num_turns).when(num_turns <= 50, 20).otherwise(15)


def planned_turns(plans: DataFrame, seed: int = 42) -> DataFrame:
    """conv_id, num_turns, turn, batch, emotion, topic, twist, callback, mood (the user's, by a draw), length (short, long or normal, by a
    draw) and spec, the line that asks for the turn."""
    turns = turns_of(plans.select("conv_id", "num_turns", "arc", "topics", "twists", "callbacks"))
    roll = uniform(seed + 1, "conv_id", "turn")
    turns = turns.withColumns({
        "batch": F.floor(F.col("turn") / batch_size(F.col("num_turns"))).cast("int"), "mood": friction(F.col("turn"), uniform(seed, "conv_id", "turn")),
        "length": F.when(roll < 0.2, "short").when(roll < 0.4, "long").otherwise("normal")})
    optional = F.concat_ws(" | ", F.concat(F.lit("event: "), F.col("twist")), F.when(F.col("mood") != "none", F.concat(F.lit("mood: "), F.col("mood"))), F.when(F.col("callback"), F.lit("callback")))
    spec = F.concat_ws(" | ", F.concat(F.lit("[MSG "), (F.col("turn") + 1).cast("string"), F.lit("] "), F.col("topic")), F.col("emotion"), F.col("length"), F.when(optional != "", optional))
    return turns.select("conv_id", "num_turns", "turn", "batch", "emotion", "topic", "twist", "callback", "mood", "length", spec.alias("spec"))


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, n)


def _before(rows: DataFrame, own: str, most: int) -> DataFrame:
    """`own` (an array, of a batch) becomes the last `most` items of the batches before, by steps: each step hands on what one more batch with
    items adds, so that after `most` steps none is missing, and no row ever holds more than that."""
    before = Window.partitionBy("conv_id").orderBy("first_turn").rowsBetween(Window.unboundedPreceding, -1)
    none = F.slice(own, 1, 0)
    rows = rows.withColumn("upto_", _last(F.col(own), most))
    for step in range(most):
        earlier = F.coalesce(F.last(F.when(F.size(own) > 0, F.col("upto_")), ignorenulls=True).over(before), none)
        rows = rows.withColumn("upto_", _last(F.concat(earlier, own), most) if step < most - 1 else earlier)
    return rows.withColumn(own, F.col("upto_")).drop("upto_")


def batch_requests(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, batch, spec, message): conv_id, batch, first_turn, n, specs, and of the messages before the batch the last RECENT and
    the last NOTES that say that something is solved. message: what was generated for the turn, null where nothing is yet."""
    said = F.concat(F.lit("[MSG "), (F.col("turn") + 1).cast("string"), F.lit("] "), F.substring("message", 1, RECENT_CHARS))
    rows = turns.select("conv_id", "batch", F.struct("turn", "spec", said.alias("said"), T.resolved(F.col("message")).alias("note")).alias("t"))
    rows = rows.groupBy("conv_id", "batch").agg(F.array_sort(F.collect_list("t")).alias("t"))
    rows = rows.select("conv_id", "batch", F.col("t.turn")[0].alias("first_turn"), F.size("t").alias("n"), F.array_join("t.spec", "\n").alias("specs"), F.array_compact("t.said").alias("recent"), F.array_compact("t.note").alias("solved"))
    rows = _before(_before(rows, "recent", RECENT), "solved", NOTES)
    return rows.select("conv_id", "batch", "first_turn", "n", "specs", F.array_join("recent", "\n").alias("recent"), F.array_join("solved", "\n").alias("solved"))
