"""Scores of replies: five levels and their weighted mean, turn by turn."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import text as T

LEVELS = ("l1", "l2", "l3", "l4", "l5")
CURVE = ("model", "tier", "lang", "conv_id")


@dataclass(frozen=True)
class Scoring:
    """Parameters of the levels. Weights are made to sum to 1; `banned`, if given, holds for all languages."""

    tag: str = T.TAG
    bullets: int = 2
    banned: tuple[str, ...] | None = None
    strict: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(LEVELS, 0.2))

    def shares(self) -> dict[str, float]:
        total = sum(self.weights.values())
        return self.weights if abs(total - 1) <= 1e-6 else {k: w / total for k, w in self.weights.items()}


def role_ordinal(messages: DataFrame, key: tuple[str, ...], order: str = "msg_idx") -> DataFrame:
    """messages with `turn`: the place among the conversation's messages of the same role, from 1."""
    return messages.withColumn("turn", F.row_number().over(Window.partitionBy(*key, "role").orderBy(order)).cast("long"))


def level_scores(text: Column, turn: Column, lang: Column, rules: Scoring = Scoring()) -> dict[str, Column]:
    lexical = T.forbidden_score(text, rules.banned) if rules.banned else T.lexical_score(text, lang)
    return {
        "l1": T.tag_score(text, rules.tag),
        "l2": T.bullet_score(text, rules.bullets),
        "l3": lexical,
        "l4": T.citation_score(text, rules.strict),
        "l5": T.counter_score(text, turn),
    }


def weighted(levels: dict[str, Column], rules: Scoring = Scoring()) -> Column:
    """The levels' weighted mean, summed in the order of the levels."""
    out = None
    for name, share in rules.shares().items():
        part = levels[name] * F.lit(share)
        out = part if out is None else out + part
    return out


def score_turns(messages: DataFrame, key: tuple[str, ...] = ("conv_id",), rules: Scoring = Scoring(), order: str = "msg_idx") -> DataFrame:
    """key, turn, l1 to l5 and ddm of every assistant reply. messages: key, role, text, order, and lang (else English)."""
    replies = messages.where("role = 'assistant'")
    lang = F.col("lang") if "lang" in messages.columns else F.lit("en")
    numbered = role_ordinal(replies, key, order).withColumn("lang_", lang)
    levels = level_scores(F.col("text"), F.col("turn"), F.col("lang_"), rules)
    scored = numbered.select(*key, *(["lang"] if "lang" in messages.columns and "lang" not in key else []), "turn", *(c.alias(n) for n, c in levels.items()))
    return scored.withColumn("ddm", weighted({n: F.col(n) for n in LEVELS}, rules))


def passes(scores: DataFrame) -> DataFrame:
    """scores with {level}_pass and all_pass."""
    ok = {f"{n}_pass": F.col(n) >= 1.0 for n in LEVELS}
    every = ok["l1_pass"] & ok["l2_pass"] & ok["l3_pass"] & ok["l4_pass"] & ok["l5_pass"]
    return scores.withColumns(ok | {"all_pass": every})


def by_level(scores: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, turn, level, score: a row for each level of each turn."""
    return scores.unpivot([*key, "turn"], list(LEVELS), "level", "score")


def thought_and_action(messages: DataFrame, key: tuple[str, ...] = ("conv_id",), rules: Scoring = Scoring(), order: str = "msg_idx") -> DataFrame:
    """Scores of a reply's thought and of its spoken part, and how far they differ. Without a thought both are the same."""
    replies = role_ordinal(messages.where("role = 'assistant'"), key, order)
    said = replies.select(*key, "turn", T.thought(F.col("text")).alias("thought"), T.spoken(F.col("text")).alias("spoken"))
    said = said.withColumn("has_thought", F.col("thought") != "").withColumn("thought", F.when(F.col("thought") != "", F.col("thought")).otherwise(F.col("spoken")))
    score = lambda c: weighted(level_scores(F.col(c), F.col("turn"), F.lit("en"), rules), rules)
    out = said.select(*key, "turn", "has_thought", score("thought").alias("thought_ddm"), score("spoken").alias("output_ddm"), *(x.alias(f"aware_{n}") for n, x in T.awareness(F.col("thought")).items()))
    return out.withColumn("dissonance", F.col("thought_ddm") - F.col("output_ddm"))


def gold_turns(turn: Column, until: int | None = None, ratio: float | None = None) -> Column:
    """Which turns are replayed with a compliant reply: the first `until`, or every round(1 / ratio)-th (halves to even)."""
    if until is not None:
        return turn <= until
    if ratio is None or ratio <= 0:
        return F.lit(False)
    return (turn - 1) % max(1, round(1 / ratio)) == 0


def context_rows(messages: DataFrame, gold: DataFrame, use_gold: Column, key: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """The transcript that a model is shown: its own replies, or the gold ones where use_gold holds. messages and gold:
    key, msg_idx, role, turn, text."""
    theirs = gold.select(*key, "msg_idx", F.col("text").alias("gold_text"))
    both = messages.join(theirs, [*key, "msg_idx"], "left")
    swap = (F.col("role") == "assistant") & use_gold & F.col("gold_text").isNotNull()
    return both.select(*key, "msg_idx", "role", F.when(swap, F.col("gold_text")).otherwise(F.col("text")).alias("text"), swap.alias("gold_used"))


def reinjected(messages: DataFrame, prompt: str, turns: tuple[int, ...], key: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """messages with the system prompt once more before the user's message of each of the turns."""
    users = messages.where(F.col("role") == "user").where(F.col("turn").isin(*turns))
    again = users.withColumns({"role": F.lit("system"), "text": F.lit(prompt), "msg_idx": F.col("msg_idx") - 0.5})
    return messages.withColumn("msg_idx", F.col("msg_idx").cast("double")).unionByName(again)


def placed(messages: DataFrame, prompt: str, placement: str) -> DataFrame:
    """The prompt at the top (as the first row), appended to every user message, or both."""
    end = F.when(F.col("role") == "user", F.concat("text", F.lit(f"\n\n{prompt}"))).otherwise(F.col("text"))
    return messages.withColumn("text", end) if placement in ("appended", "both") else messages


def transcript(messages: DataFrame, key: tuple[str, ...] = ("conv_id",), window: int | None = None, mask: int | None = None, order: str = "msg_idx") -> DataFrame:
    """key and transcript: `[ROLE]: text` lines in order; only the last `window`; assistant texts before the last `mask` hidden."""
    back = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    rows = messages.withColumn("back", back)
    if window is not None:
        rows = rows.where(F.col("back") <= window)
    text = F.col("text") if mask is None else F.when((F.col("role") == "assistant") & (F.col("back") > mask), "[...]").otherwise(F.col("text"))
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), text)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(lines, lambda x: x.line), "\n\n").alias("transcript"))


def older_summary(messages: DataFrame, keep: int, key: tuple[str, ...] = ("conv_id",), order: str = "msg_idx") -> DataFrame:
    """What the messages before the last `keep` hold: the user's name, capitalised names that users say and sources that the
    assistant cites (the first 15), and the assistant's numbered advice (the last 8 lines, cut at 100 characters)."""
    back = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    old = messages.withColumn("back", back).where(F.col("back") > keep)
    mine, theirs = F.col("role") == "user", F.col("role") == "assistant"
    name = F.regexp_extract("text", r"(?dU)(?:I'm|I am|my name is|this is)\s+([A-Z][a-z]+)", 1)
    names = F.filter(F.regexp_extract_all("text", F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)), lambda x: F.length(x) > 3)
    cited = F.regexp_extract_all("text", F.lit(r"(?dU)\[Source:\s*([^\]]+)\]"), F.lit(1))
    lines = F.transform(F.regexp_extract_all("text", F.lit(r"(?mdU)^\s*\d+[.)\s]\s*(.+)$"), F.lit(1)), lambda x: F.substring(T.strip(x), 1, 100))
    advice = F.struct(F.col(order).alias("at"), F.filter(lines, lambda x: x != "").alias("lines"))
    out = old.groupBy(*key).agg(
        F.min(F.when(mine & (name != ""), F.struct(F.col(order).alias("at"), name.alias("name")))).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(mine, names).when(theirs, cited))))).alias("items"),
        F.array_sort(F.collect_list(F.when(theirs, advice))).alias("advice"))
    said = F.flatten(F.transform("advice", lambda x: x.lines))
    return out.select(*key, F.col("first.name").alias("user_name"), F.slice("items", 1, 15).alias("items"), F.slice(said, F.greatest(F.size(said) - 7, F.lit(1)), F.lit(8)).alias("advice"))
