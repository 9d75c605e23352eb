"""Experiments as compositions: what several measured runs of the same conversations say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import curves

GOLD_UNTIL = (0, 1, 2, 3, 5, 10, 20, 50)
GOLD_RATIO = (0.0, 0.1, 0.25, 0.33, 0.5, 0.75, 1.0)


def decomposition(free: DataFrame, gold: DataFrame, key: list[str], score: str = "mean_ddm") -> DataFrame:
    """Runs with a model's own replies and with compliant ones: how much of the loss is cascade, how much forgetting."""
    both = free.select(*key, F.col(score).alias("free")).join(gold.select(*key, F.col(score).alias("gold")), key)
    cascade = F.col("free") - F.col("gold")
    pct = F.when(F.col("free") >= 1, 0.0).otherwise(F.abs(cascade) / F.greatest(1 - F.col("free"), F.lit(1e-6)) * 100)
    return both.withColumns({"cascade": cascade, "forgetting": 1 - F.col("gold"), "cascade_pct": pct})


def scaffolding(free: DataFrame, gold: DataFrame, measured: DataFrame, key: list[str], values: tuple[float, ...], kind: str) -> DataFrame:
    """A sweep's curve: at 0 the free run, from the conversation's length (or a ratio of 1) on the gold run, else the measured
    run of that value (null where there is none). Runs: key, mean_ddm; free also total_turns."""
    sweep = F.array(*(F.lit(float(v)) for v in values))
    rows = free.select(*key, "total_turns", F.col("mean_ddm").alias("free"), F.explode(sweep).alias("sweep_value"))
    rows = rows.join(gold.select(*key, F.col("mean_ddm").alias("gold")), key, "left").join(measured.select(*key, "sweep_value", F.col("mean_ddm").alias("own")), [*key, "sweep_value"], "left")
    full = F.col("sweep_value") >= (F.col("total_turns") if kind == "gold_until" else F.lit(1.0))
    value = F.when(F.col("sweep_value") <= 0, F.col("free")).when(full, F.col("gold")).otherwise(F.col("own"))
    return rows.select(*key, F.lit(kind).alias("sweep_type"), "sweep_value", value.alias("mean_ddm"))


def static_and_dynamic(static: DataFrame, dynamic: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Differences of two tracks by model and domain; either may lack a domain."""
    side = lambda rows, name: rows.select(*key, *(F.col(m).alias(f"{name}_{m}") for m in metrics))
    both = side(static, "static").join(side(dynamic, "dynamic"), key, "full_outer")
    return both.withColumns({f"delta_{m}": F.col(f"dynamic_{m}") - F.col(f"static_{m}") for m in metrics})


def delta_summary(deltas: DataFrame, metrics: list[str]) -> DataFrame:
    parts = [F.count("*").alias("n")]
    for m in metrics:
        parts += [F.count(f"delta_{m}").alias(f"{m}_n"), F.avg(f"delta_{m}").alias(f"{m}_mean"), F.stddev_pop(f"delta_{m}").alias(f"{m}_std")]
    return deltas.agg(*parts)


def real_drift(mean_delta: Column) -> Column:
    return F.when(mean_delta.isNull(), None).when(F.abs(mean_delta) < 3, "drift is real").otherwise("drift is an artefact")


def plan_at(turn: Column, plan: Column) -> dict[str, Column]:
    """What a plan has for a turn (from 0): arc by fives, topic, the last twist of the turn, and whether to call back."""
    arcs, topics = plan["emotional_arc"], plan["topics"]
    twists = F.filter(plan["plot_twists"], lambda t: t["turn"] == turn)
    return {
        "arc": F.get(arcs, F.least(F.floor(turn / 5), F.size(arcs) - 1).cast("int")),
        "topic": F.get(topics, F.least(turn, F.size(topics) - 1).cast("int")),
        "twist": F.get(twists, F.size(twists) - 1)["twist"],
        "callback": F.array_contains(plan["context_callbacks"], turn),
    }


def shock_impact(scores: DataFrame, key: tuple[str, ...], index: int) -> DataFrame:
    return curves.shock(scores, key, index)


def perplexity(logs: DataFrame, key: list[str], log_prob: str = "log_prob") -> DataFrame:
    """exp of the mean negative log-probability of a reply's tokens; infinite without tokens."""
    return logs.groupBy(*key).agg(F.coalesce(F.exp(-F.avg(log_prob)), F.lit(float("inf"))).alias("perplexity"))


def paraphrase_targets(pairs: DataFrame) -> DataFrame:
    """Lengths that English texts are expanded to, so that they cost what the other language's do: tokens times fertility, cut."""
    return pairs.withColumn("target_tokens", F.floor(F.col("en_tokens") * F.col("tfr")).cast("long"))


def expansion_success(tokens: Column, target: Column, similarity: Column) -> Column:
    return (tokens >= target) & (similarity >= 0.92)
