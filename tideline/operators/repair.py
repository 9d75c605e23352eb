"""Deterministic repairs of replies."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import text as T
from tideline.operators.scoring import role_ordinal
from tideline.sources.shared import place, stored

# Openings that replace banned ones.
REPLACEMENTS = (
    "A practical step here is to", "What I'd recommend is to", "The most effective approach is to", "Here's what will make the biggest difference:",
    "Your best move right now is to", "A proven strategy is to", "The smartest thing you can do is", "Right off the bat, I'd say",
)
BANNED = (r"[Tt]he single most important action(?:\s+is)?\s+(?:to\s+)?", r"[Tt]he key is to\s+", r"[Tt]he most important thing(?:\s+is)?\s+(?:to\s+)?")
# Sources by the words of a reply; the first that fits.
SOURCES = (
    (("cook", "food", "meal", "recipe", "nutrition", "eat", "diet"), "USDA Dietary Guidelines for Americans"),
    (("clean", "laundry", "mop", "scrub", "dust"), "EPA guidelines on household cleaning"),
    (("budget", "money", "saving", "financial", "credit", "debt"), "Consumer Financial Protection Bureau"),
    (("sleep", "insomnia", "circadian", "tired", "rest"), "National Sleep Foundation research"),
    (("exercise", "workout", "fitness", "cardio", "strength"), "American College of Sports Medicine guidelines"),
    (("stress", "anxiety", "mental", "mindful", "meditat"), "American Psychological Association research"),
    (("productiv", "focus", "time management", "procrastin"), "Harvard Business Review behavioral research"),
)
OTHER_SOURCE = "Peer-reviewed research in behavioral science"
# Phrases that are stripped from their third use on.
FILLERS = (
    r"Here'?s what most people get wrong about this:?\s*", r"That frustration makes total sense\.?\s*", r"A surprising fact:?\s*", r"Most people don'?t realize that\s+",
    r"The single most important action is to\s+", r"The key is to\s+", r"The most important thing is to\s+",
)


def replace_first(text: Column, pattern: str, new: Column | str) -> Column:
    """The first match only: what stands before it is kept by a group."""
    put = new if isinstance(new, Column) else F.lit(new)
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?:{pattern})", F.concat(F.lit("$1"), put))


def source_for(text: Column) -> Column:
    out = F.lit(OTHER_SOURCE)
    for parts, source in reversed(SOURCES):
        out = F.when(T.any_part(F.lower(text), parts), source).otherwise(out)
    return out


def force_fix(text: Column, turn: Column, pick: Column | None = None, tag: str = T.TAG) -> Column:
    """A reply made to meet the levels, but for numbered lines. pick: a whole number that chooses the opening (by default
    from the turn)."""
    pick = turn if pick is None else pick
    opening = F.element_at(F.array(*map(F.lit, REPLACEMENTS)), (F.pmod(pick, F.lit(len(REPLACEMENTS))) + 1).cast("int"))
    for banned in BANNED:
        text = replace_first(text, banned, F.concat(opening, F.lit(" ")))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s*\[Turn:\s*\d+\]\s*", ""), r"(?U)\A\s+", "")
    numbered = r"(?mdU)^\s*1[.)\s]"

    def tagged(t: Column) -> Column:
        return F.when(t.contains(tag), t).otherwise(F.concat(F.regexp_replace(t, r"(?U)\s+\z", ""), F.lit(f"\n\n{tag}")))

    def cited(t: Column) -> Column:
        cite = F.concat(F.lit("[Source: "), source_for(t), F.lit("]\n"))
        before_list = F.regexp_replace(t, r"(?s)\A(.*?)(?=(?md:^)\s*1[.)\s])", F.concat(F.lit("$1"), cite))
        before_tag = F.replace(t, F.lit(tag), F.concat(cite, F.lit(f"\n{tag}")))
        return F.when(t.contains("[Source:"), t).when(t.rlike(numbered), before_list).otherwise(before_tag)

    # Each step uses the text before it several times: bound, it is made once.
    text = T.bind(F.concat(F.lit("[Turn: "), turn.cast("string"), F.lit("] "), bare), tagged)
    return T.bind(F.regexp_replace(text, r"(?iU)\bhowever\b", "that said"), cited)


def filler_counts(messages: DataFrame) -> DataFrame:
    """Replies with f0..fn: how often each filler was used up to this reply, if it uses it."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = role_ordinal(messages.where("role = 'assistant'"), ("conv_id",))
    hits = {f"h{i}": F.col("text").rlike(f"(?iU){p}").cast("int") for i, p in enumerate(FILLERS)}
    rows = rows.withColumns(hits)
    return rows.withColumns({f"f{i}": F.when(F.col(f"h{i}") == 1, F.sum(f"h{i}").over(order)).otherwise(0) for i in range(len(FILLERS))}).drop(*hits)


def polished(text: Column) -> Column:
    """Behind the turn's tag: no orphaned marks or conjunctions, and a capital."""
    return T.bind(text, _polished)


def _polished(text: Column) -> Column:
    tag = F.regexp_extract(text, r"(?sU)\A(\[Turn:\s*\d+\])", 1)
    core = F.regexp_extract(text, r"(?sU)\A\[Turn:\s*\d+\]\s*(.*)\z", 1)
    marks = r"(?U)\A[\s,\-—–:]+"
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, marks, ""), r"(?i)\A(?:and|is that|is|that|but|so|or)\s+", ""), marks, "")

    def capital(c: Column) -> Column:
        head = F.length(F.regexp_extract(c, r"(?U)\A([^\w]*)[a-z]", 1))
        risen = F.concat(F.substr(c, F.lit(1), head), F.upper(F.substr(c, head + 1, F.lit(1))), F.substr(c, head + 2))
        return F.when(c.rlike(r"(?U)\A[^\w]*[a-z]"), risen).otherwise(c)

    return F.when(tag == "", text).otherwise(F.concat(tag, F.lit(" "), T.bind(core, capital)))


def _without(often: Column, filler: str):
    return lambda t: F.when(often, T.strip(replace_first(t, f"(?iU:{filler})", ""))).otherwise(t)


def strip_fillers(messages: DataFrame, allowed: int = 2) -> DataFrame:
    """Replies with `fixed`: fillers beyond the allowed uses removed, and the text polished."""
    rows = filler_counts(messages)
    text = F.col("text")
    for i, p in enumerate(FILLERS):
        text = T.bind(text, _without(F.col(f"f{i}") > allowed, p))
    return rows.withColumn("fixed", polished(text)).drop(*(f"f{i}" for i in range(len(FILLERS))))


def safety_net(messages: DataFrame) -> DataFrame:
    """Replies with `fixed`: fillers stripped, then every level forced."""
    return strip_fillers(messages).withColumn("fixed", force_fix(F.col("fixed"), F.col("turn")))


def failing(replies: DataFrame) -> DataFrame:
    """Those of replies (turn, text) that fail a level."""
    scores = T.validator_scores(F.col("text"), F.col("turn"))
    return replies.where(functools.reduce(lambda a, b: a | b, (c < 1 for c in scores.values())))


def audited(messages: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 1, force: bool = True) -> DataFrame:
    """messages (conv_id, msg_idx, role, text) with the replies that fail a level rewritten, at most `rounds` times, and what fails
    still made to meet the levels. rewrite takes the failing replies (conv_id, msg_idx, turn, text) and returns conv_id,
    msg_idx, text: a call of a language model, if there is one. Returns messages with fixed (how a reply was mended, or null) and
    fixed_round (when; from 1).

    Rounds are deltas: each reads the replies that the last left failing, writes what became of them to the shared folder, and
    the next reads that; it ends when none is left. All messages are read twice, for the first round and for the result, and
    the plans are the same however many rounds there were."""
    spark, path = messages.sparkSession, place(messages.sparkSession, "audit")
    said = role_ordinal(messages.where("role = 'assistant'"), ("conv_id",)).select("conv_id", "msg_idx", "turn", "text")
    left = stored(failing(said), f"{path}/left=0")
    k = 0
    while rewrite and k < rounds and not left.isEmpty():
        k += 1
        new = rewrite(left).select("conv_id", "msg_idx", F.col("text").alias("new_"))
        both = left.join(new, ["conv_id", "msg_idx"], "left").select("conv_id", "msg_idx", "turn", F.coalesce("new_", "text").alias("text"))
        left = failing(stored(both, f"{path}/rounds/round={k}"))
        left = stored(left, f"{path}/left={k}")
    if force:
        stored(left.withColumn("text", force_fix(F.col("text"), F.col("turn"))), f"{path}/rounds/round={rounds + 1}")
    elif k == 0:
        stored(left.limit(0), f"{path}/rounds/round=1")
    done = spark.read.schema("conv_id long, msg_idx long, turn long, text string, round int").option("basePath", f"{path}/rounds").parquet(f"{path}/rounds")
    last = done.groupBy("conv_id", "msg_idx").agg(F.max_by(F.struct("text", "round"), "round").alias("last_"))
    both = messages.join(last, ["conv_id", "msg_idx"], "left")
    how = F.when(F.col("last_.round") > rounds, "forced").when(F.col("last_").isNotNull(), "rewritten")
    return both.select(*(F.coalesce("last_.text", "text").alias(c) if c == "text" else c for c in messages.columns), how.alias("fixed"), F.col("last_.round").alias("fixed_round"))
