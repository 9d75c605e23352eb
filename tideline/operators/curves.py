"""Metrics of a conversation's score curve: onsets, area, recovery, resilience, velocity, and what happens around an event.

All take a table of turns (key, turn, and a score) and give one row a curve, with one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.numbers import corr
from tideline.operators.scoring import LEVELS

Key = tuple[str, ...]


def area(score: Column, turn: Column) -> Column:
    """Trapezoid area over the curve's length; a single turn's is its score."""
    n = F.count(score)
    ends = F.min_by(score, turn) + F.max_by(score, turn)
    return F.when(n == 1, F.max(score)).otherwise(F.try_divide(F.sum(score) - ends / 2, n - 1))


def first_turn(when: Column, turn: Column) -> Column:
    return F.min(F.when(when, turn))


def with_onset(scores: DataFrame, key: Key, score: str = "ddm", k: int = 3) -> DataFrame:
    """scores with dop (the curve's first turn below 1) and low_run (turns below 1 among this one and the k - 1 after it)."""
    curve = Window.partitionBy(*key)
    low = (F.col(score) < 1).cast("int")
    return scores.withColumns({
        "dop": F.min(F.when(F.col(score) < 1, F.col("turn"))).over(curve),
        "low_run": F.sum(low).over(curve.orderBy("turn").rowsBetween(0, k - 1)),
    })


def curve_summary(scores: DataFrame, key: Key, score: str = "ddm", k: int = 3) -> DataFrame:
    """total_turns, mean, population std, auc, drift_onset, sustained_dop, total_collapse, half_life, recovery_events, recovery_rate."""
    s, t, dop = F.col(score), F.col("turn"), F.col("dop")
    after = F.count_if(t > dop)
    back = F.count_if((t > dop) & (s >= 1))
    out = with_onset(scores, key, score, k).groupBy(*key).agg(
        F.count("*").alias("total_turns"), F.avg(s).alias("mean_ddm"), F.stddev_pop(s).alias("std_ddm"), area(s, t).alias("auc"), F.min(dop).alias("drift_onset"),
        first_turn(F.col("low_run") == k, t).alias("sustained_dop"), first_turn(s == 0, t).alias("total_collapse"), first_turn(s <= 0.5, t).alias("half_life"),
        back.alias("recovery_events"), F.when(F.min(dop).isNull(), 1.0).otherwise(F.coalesce(F.try_divide(back.cast("double"), after), F.lit(0.0))).alias("recovery_rate"))
    return out


def level_decay(scores: DataFrame, key: Key, levels: tuple[str, ...] = LEVELS, lists: bool = False) -> DataFrame:
    """{level}_mean, {level}_auc and {level}_onset, and with lists {level}_scores in order of turns."""
    out = []
    for n in levels:
        out += [F.avg(n).alias(f"{n}_mean"), area(F.col(n), F.col("turn")).alias(f"{n}_auc"), first_turn(F.col(n) < 1, F.col("turn")).alias(f"{n}_onset")]
        out += [F.transform(F.array_sort(F.collect_list(F.struct("turn", n))), lambda x, n=n: x[n]).alias(f"{n}_scores")] if lists else []
    return scores.groupBy(*key).agg(*out)


def resilience(auc: Column, dop: Column, onsets: list[Column], recovery: Column, n: Column) -> Column:
    """0 to 100: area 40 %, onset 30 %, spread of the levels' onsets 15 %, recovery 15 %."""
    onset = F.coalesce(F.try_divide(dop.cast("double"), n), F.lit(1.0))
    failed = sum((o.isNotNull().cast("int") for o in onsets), F.lit(0))
    spread = F.least(F.lit(1.0), F.try_divide(5.0 * (F.greatest(*onsets) - F.least(*onsets)), n))
    cascade = F.when(failed >= 2, spread).otherwise(1.0)
    return 100 * (0.40 * auc + 0.30 * onset + 0.15 * cascade + 0.15 * recovery)


def drift_summary(scores: DataFrame, key: Key, k: int = 3) -> DataFrame:
    """curve_summary, level_decay and pdri in one row a curve."""
    both = curve_summary(scores, key, k=k).join(level_decay(scores, key), list(key))
    onsets = [F.col(f"{n}_onset") for n in LEVELS]
    return both.withColumn("pdri", resilience(F.col("auc"), F.col("drift_onset"), onsets, F.col("recovery_rate"), F.col("total_turns")))


def velocity(scores: DataFrame, key: Key, score: str = "ddm", window: int = 5) -> DataFrame:
    """Mean, steepest, spread and signs of the turn-to-turn changes, that at onset, and the least rolling mean over full
    windows (over single changes, if the curve has no more turns than the window)."""
    order = Window.partitionBy(*key).orderBy("turn")
    d, s, t = F.col("d"), F.col(score), F.col("turn")
    steps = scores.withColumns({"d": s - F.lag(score).over(order), "n": F.count("*").over(Window.partitionBy(*key))})
    frame = order.rowsBetween(1 - window, 0)
    steps = steps.withColumn("rolling", F.when(F.col("n") <= window, d).when(F.count("d").over(frame) == window, F.avg("d").over(frame)))
    none = F.count("d") == 0
    return steps.groupBy(*key).agg(
        F.when(none, 0.0).otherwise(F.avg(d)).alias("mean_velocity"), F.when(none, 0.0).otherwise(F.min(d)).alias("max_decline"), F.stddev_pop(d).alias("velocity_std"),
        F.when(~none, F.coalesce(F.min_by(F.when(t > 1, d), F.when((s < 1) & (t > 1), t)), F.lit(0.0))).alias("velocity_at_onset"),
        F.count_if(d < 0).alias("declining"), F.count_if(d > 0).alias("improving"), F.count_if(d == 0).alias("stable"), F.min("rolling").alias("min_rolling"))


# --- around an event


def shock(scores: DataFrame, key: Key, index: int, score: str = "ddm", span: int = 5) -> DataFrame:
    """Before, at and after a shock at place `index` (from 0) of the curve: means of up to `span` turns, the drop, and the turns
    until 90 % of the level before is back (counted with it; if never, all that are left, and permanent)."""
    s, t = F.col(score), F.col("turn")
    # Summed in order of turns: means of tenths decide whether a drop or a return is just met, and their last digits depend on the order.
    curve = Window.partitionBy(*key).orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pre = F.avg(F.when((t > index - span) & (t <= index), s)).over(curve)
    rows = scores.withColumn("pre", F.coalesce(pre, F.lit(1.0)))
    at, left = index + 1, F.count_if(t > index + 1)
    back = F.min(F.when((t > at) & (s >= 0.9 * F.col("pre")), t))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.first("pre").alias("pre_shock_ddm"), F.max(F.when(t == at, s)).alias("shock_turn_ddm"), F.avg(F.when((t > at) & (t <= at + span), s)).alias("post_shock_ddm"),
        F.coalesce(back - at, left).alias("recovery_turns"), back.isNull().alias("permanent_damage"))
    return out.where(F.col("n") > index + span).withColumn("ddm_drop", F.col("pre_shock_ddm") - F.col("shock_turn_ddm"))


def reinjection(scores: DataFrame, key: Key, turns: tuple[int, ...], score: str = "ddm") -> DataFrame:
    """The turn before and the turn after (the turn itself is skipped) each re-injection inside the curve, and the boost."""
    order = Window.partitionBy(*key).orderBy("turn")
    rows = scores.withColumns({"ddm_before": F.lag(score).over(order), "ddm_after": F.lead(score).over(order)})
    rows = rows.where(F.col("turn").isin(*turns) & F.col("ddm_after").isNotNull())
    return rows.select(*key, F.col("turn").alias("reinjection_turn"), "ddm_before", "ddm_after", (F.col("ddm_after") - F.col("ddm_before")).alias("recovery_boost"))


def around_onset(scores: DataFrame, key: Key, value: str, score: str = "ddm") -> DataFrame:
    """Means of a value before and from the onset (for onsets after the first turn), Student's t between them, Pearson's r
    with the score, and whether the model is as sure of itself after as before."""
    v, t, dop = F.col(value), F.col("turn"), F.col("dop")
    rows = with_onset(scores, key, score).where("dop > 1")
    side = {"pre": F.when(t < dop, v), "post": F.when(t >= dop, v)}
    parts = [f(c).alias(f"{name}_{what}") for name, c in side.items() for what, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    out = rows.groupBy(*key).agg(*parts, corr(v, F.col(score)).alias("r"), F.count("*").alias("n"))
    df = F.col("pre_n") + F.col("post_n") - 2
    pooled = ((F.col("pre_n") - 1) * F.col("pre_var") + (F.col("post_n") - 1) * F.col("post_var")) / F.when(df > 0, df)
    t_value = F.when((F.col("pre_n") > 1) & (F.col("post_n") > 1) & (pooled > 0), (F.col("pre_mean") - F.col("post_mean")) / F.sqrt(pooled * (1 / F.col("pre_n") + 1 / F.col("post_n"))))
    r = F.when(F.col("n") >= 3, F.col("r"))
    return out.select(*key, F.col("pre_mean").alias("pre_drift"), F.col("post_mean").alias("post_drift"), t_value.alias("t_stat"), df.alias("df"), r.alias("pearson_r"), (F.col("post_mean") <= F.col("pre_mean")).alias("confident"))


def context_budget(scores: DataFrame, key: Key, windows: DataFrame, default: int = 8192, score: str = "ddm") -> DataFrame:
    """Share of the model's context window in use at onset, at half life, at most and at the end. windows: model, context_window;
    a curve without any context_tokens counts 100 a turn."""
    known = F.max("context_tokens").over(Window.partitionBy(*key)).isNotNull()
    rows = scores.join(windows, "model", "left").withColumn("used", F.when(known, F.col("context_tokens")).otherwise(100 * F.col("turn")) / F.coalesce("context_window", F.lit(default)))
    s, t = F.col(score), F.col("turn")
    return rows.groupBy(*key).agg(
        F.min_by("used", F.when(s < 1, t)).alias("util_at_dop"), F.min_by("used", F.when(s <= 0.5, t)).alias("util_at_half_life"), F.max("used").alias("max_util"), F.max_by("used", "turn").alias("final_util"))


def prompt_share(scores: DataFrame, key: Key, prompt_tokens: int = 200, score: str = "ddm") -> DataFrame:
    """The system prompt's share of the context: at the first and last turn, on average, and at onset; and its r with the score."""
    share, t = F.col("share"), F.col("turn")
    rows = scores.withColumn("share", prompt_tokens / F.greatest("context_tokens", F.lit(1)))
    r = corr(share, F.col(score))
    return rows.groupBy(*key).agg(
        F.min_by(share, t).alias("initial_ratio"), F.max_by(share, t).alias("final_ratio"), F.avg(share).alias("mean_ratio"),
        F.min_by(share, F.when(F.col(score) < 1, t)).alias("ratio_at_dop"), F.when(F.count("*") >= 3, r).alias("corr"))


def onset_tokens(scores: DataFrame, key: Key, score: str = "ddm") -> DataFrame:
    return scores.groupBy(*key).agg(F.min_by("context_tokens", F.when(F.col(score) < 1, F.col("turn"))).alias("dop_tokens"))


def failure_order(decay: DataFrame, key: Key, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Levels in the order in which they failed (ties in the order of levels), the first of them, and how many failed."""
    onsets = F.array(*(F.struct(F.col(f"{n}_onset").alias("onset"), F.lit(i).alias("at"), F.lit(n).alias("level")) for i, n in enumerate(levels)))
    order = F.transform(F.array_sort(F.filter(onsets, lambda x: x.onset.isNotNull())), lambda x: x.level)
    return decay.select(*key, F.array_join(order, " -> ").alias("failure_order"), F.get(order, F.lit(0)).alias("first_failure"), F.size(order).alias("n_failed"))


def probes(scores: DataFrame, key: Key, recalls: DataFrame | None = None, offsets: tuple[int, ...] = (0, 5, 10, 20), score: str = "ddm") -> DataFrame:
    """Turns at each offset from the onset, with the score there; with recalls (key, turn, total_recall) the class of the lapse."""
    rows = with_onset(scores, key, score).where("dop is not null").withColumn("offset_from_dop", F.col("turn") - F.col("dop")).where(F.col("offset_from_dop").isin(*offsets))
    rows = rows.select(*key, F.col("turn").alias("probe_turn"), "dop", "offset_from_dop", F.col(score).alias("ddm_at_probe"))
    if recalls is None:
        return rows
    both = rows.join(recalls.withColumnRenamed("turn", "probe_turn"), [*key, "probe_turn"])
    kind = F.when((F.col("total_recall") >= 0.6) & (F.col("ddm_at_probe") < 0.8), "laziness").when(F.col("total_recall") < 0.4, "eviction").otherwise("partial")
    return both.withColumn("classification", kind)
