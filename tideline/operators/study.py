"""A whole study: phases in the order of their needs, each computed once and stored, so that a second run does only what is missing.

messages: model, tier, lang, conv_id, msg_idx, role, text. Replies are scored once; every later phase reads what the phases it
needs have stored. The scoring can be dealt to shards, each on its own cluster, and merged: every shard leaves its rows and, by Spark's
mark, that it is whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import tokens
from tideline.operators import cohorts, curves, scoring
from tideline.operators import statistics as S

KEY = scoring.CURVE
TIERS = ["short", "medium", "long"]


@dataclass(frozen=True)
class Phase:
    """build takes what its needs stored, in their order. `messages` is given, all else is a phase."""

    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


def _fertility(messages: DataFrame) -> DataFrame:
    pairs = cohorts.parallel_pairs(messages, ("model", "tier", "conv_id", "msg_idx"))
    count = lambda c: tokens.count_tokens(F.col(c), "whitespace")
    return cohorts.fertility(pairs.select("lang", count("text").alias("tokens"), count("en_text").alias("en_tokens")), ["lang"])


def _means(summary: DataFrame) -> DataFrame:
    return summary.groupBy("model", "lang").agg(F.avg("mean_ddm").alias("m"))


PHASES = {
    "turns": Phase(("messages",), lambda m: scoring.score_turns(m, KEY)),
    "fertility": Phase(("messages",), _fertility),
    "summary": Phase(("turns",), lambda t: curves.curve_summary(t, KEY)),
    "decay": Phase(("turns",), lambda t: curves.level_decay(t, KEY)),
    "velocity": Phase(("turns",), lambda t: curves.velocity(t, KEY)),
    "curve": Phase(("turns",), lambda t: cohorts.curve_by_turn(t, ["model", "lang"])),
    "groups": Phase(("summary",), lambda s: cohorts.spread(s, ["model", "lang"], ["mean_ddm", "auc", "drift_onset"])),
    "intervals": Phase(("summary",), lambda s: S.bootstrap(s, ["model", "lang"], "mean_ddm", "conv_id")),
    "regression": Phase(("fertility", "summary"), lambda f, s: S.ols(s.join(f.select("lang", "tfr"), "lang"), "tfr", "drift_onset")),
    "agreement": Phase(("summary",), lambda s: S.kendall_w(_means(s), "model", "lang", "m")),
    "tiers": Phase(("summary",), lambda s: S.effects(s, "tier", "mean_ddm", TIERS)),
    "order": Phase(("decay",), lambda d: curves.failure_order(d, KEY)),
}


def in_order(only: Iterable[str] | None = None, phases: dict[str, Phase] = PHASES) -> list[str]:
    """The named phases and what they need, each behind its needs, else as they are listed."""
    out: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"phases need each other: {' -> '.join([*above, name])}")
        if name in out or name == "messages":
            return
        if name not in phases:
            raise ValueError(f"no such phase: {name}")
        for need in phases[name].needs:
            visit(need, (*above, name))
        out.append(name)

    wanted = set(phases if only is None else only)
    for name in [*(n for n in phases if n in wanted), *sorted(wanted - set(phases))]:
        visit(name, ())
    return out


def is_whole(spark: SparkSession, path: str) -> bool:
    """Spark's mark that all tasks of a write ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run(messages: DataFrame, out: str, only: Iterable[str] | None = None, phases: dict[str, Phase] = PHASES) -> list[tuple[str, str]]:
    """Each phase's table under out, and what was done: (phase, ran or kept). A phase that an earlier run left whole is kept; one that it
    left in part is written anew."""
    spark, did = messages.sparkSession, []
    frames = {"messages": messages}
    for name in in_order(only, phases):
        path = f"{out}/{name}"
        kept = is_whole(spark, path)
        if not kept:
            phases[name].build(*(frames[n] for n in phases[name].needs)).write.mode("overwrite").parquet(path)
        frames[name] = spark.read.parquet(path)
        did.append((name, "kept" if kept else "ran"))
    return did


def score_shard(messages: DataFrame, out: str, shard: int, shards: int) -> bool:
    """Score the conversations of one of some shards, unless they are there. Whether it had to."""
    path = f"{out}/shards/shard={shard}"
    if is_whole(messages.sparkSession, path):
        return False
    own = messages.where(F.pmod(F.xxhash64(*KEY), F.lit(shards)) == shard)
    PHASES["turns"].build(own).write.mode("overwrite").parquet(path)
    return True


def merge_shards(spark: SparkSession, out: str, shards: int) -> DataFrame:
    """All shards' rows as the phase `turns`, and the manifest, a row for each shard: shard, turns, curves. A shard that is not whole stops it."""
    missing = [k for k in range(shards) if not is_whole(spark, f"{out}/shards/shard={k}")]
    if missing:
        raise ValueError(f"shards that are not whole: {missing}")
    rows = spark.read.option("basePath", f"{out}/shards").parquet(*(f"{out}/shards/shard={k}" for k in range(shards)))
    rows.groupBy("shard").agg(F.count("*").alias("turns"), F.count_if(F.col("turn") == 1).alias("curves")).write.mode("overwrite").parquet(f"{out}/manifest")
    rows.drop("shard").write.mode("overwrite").parquet(f"{out}/turns")
    return spark.read.parquet(f"{out}/manifest")
