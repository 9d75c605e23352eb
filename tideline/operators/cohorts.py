"""Groups of curves: aggregates, pivots, grouping sets, rankings, failure counts, fertility, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.scoring import LEVELS


def base_model(model: Column) -> Column:
    """A model's name without the tier that runs append to it."""
    return F.regexp_replace(model, r"-(?:short|medium|long)$", "")


def tier_of(name: Column) -> Column:
    return F.when(name.contains("short"), "short").when(name.contains("medium"), "medium").when(name.contains("long"), "long").otherwise("unknown")


def spread(summary: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """n, and {metric}_mean, _std (sample) and _median by group; nulls are left out."""
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.percentile(m, F.lit(0.5)).alias(f"{m}_median")]
    return summary.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def tier_levels(summary: DataFrame, metric: str = "mean_ddm") -> DataFrame:
    """Two grouping levels in one pass: by tier and language, and by tier (lang null, all_langs true)."""
    rows = summary.groupingSets([["tier", "lang"], ["tier"]], "tier", "lang").agg(
        F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.avg(F.col("drift_onset").isNotNull().cast("int")).alias("drift_share"), (F.grouping("lang") == 1).alias("all_langs"))
    return rows


def pivot_means(summary: DataFrame, rows: str, columns: str, values: list[str], metric: str = "mean_ddm") -> DataFrame:
    """A row for each of `rows`, a column for each of `values`, of the metric's mean."""
    return summary.groupBy(rows).pivot(columns, values).agg(F.avg(metric))


def mean_of_means(summary: DataFrame, outer: str, inner: str, metric: str = "mean_ddm") -> DataFrame:
    """outer, score (the mean over `inner` of its means), place: the ranking of languages over models."""
    means = summary.groupBy(outer, inner).agg(F.avg(metric).alias("m")).groupBy(outer).agg(F.avg("m").alias("score"))
    return means.withColumn("place", F.rank().over(Window.orderBy(F.col("score").desc())))  # a row a language


def first_failures(orders: DataFrame, group: str = "lang", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """How often each level failed first, by group, with its share; curves that never fail don't count."""
    counts = orders.where("first_failure is not null").groupBy(group).pivot("first_failure", list(levels)).count()
    counts = counts.na.fill(0, list(levels))
    total = sum((F.col(n) for n in levels), F.lit(0))
    return counts.select(group, *levels, total.alias("total"), *((100.0 * F.col(n) / total).alias(f"{n}_pct") for n in levels))


def curve_by_turn(scores: DataFrame, keys: list[str], score: str = "ddm") -> DataFrame:
    """Mean and sample deviation at each turn: what a decay plot draws."""
    return scores.groupBy(*keys, "turn").agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count("*").alias("n"))


def lang_summary(rows: DataFrame, metrics: list[str], by: str = "lang") -> DataFrame:
    parts = [f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy(by).agg(*parts)


def chances(rows: DataFrame, keys: list[str], **tests: Column) -> DataFrame:
    """How often each condition holds, in per cent."""
    return rows.groupBy(*keys).agg(*((F.avg(t.cast("int")) * 100).alias(name) for name, t in tests.items()))


# --- fertility


def fertility(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: keys, tokens and en_tokens of parallel texts. Ratios over the corpus and over pairs with English tokens."""
    ratio = F.col("tokens") / F.when(F.col("en_tokens") > 0, F.col("en_tokens"))
    total, english = F.sum("tokens"), F.sum("en_tokens")
    return pairs.groupBy(*keys).agg(
        F.try_divide(total.cast("double"), english).alias("tfr"), F.avg(ratio).alias("mean_tfr"), F.stddev_pop(ratio).alias("std_tfr"), F.percentile(ratio, F.lit(0.5)).alias("median_tfr"),
        F.max(ratio).alias("max_tfr"), F.min(ratio).alias("min_tfr"), total.alias("total_tokens"), english.alias("en_total_tokens"),
        (total - english).alias("token_overhead"), (100.0 * F.try_divide((total - english).cast("double"), english)).alias("overhead_pct"))


def parallel_pairs(messages: DataFrame, key: tuple[str, ...], source: str = "en") -> DataFrame:
    """Messages of each other language beside the source's at the same place: text, en_text. An equi-join, never a zip."""
    english = messages.where(F.col("lang") == source).select(*key, F.col("text").alias("en_text"))
    return messages.where(F.col("lang") != source).join(english, list(key))


def fertility_and_drift(found: DataFrame, summary: DataFrame) -> DataFrame:
    """Each curve's summary beside its model's and language's fertility."""
    left = found.select(F.col("model").alias("f_model"), F.col("lang").alias("f_lang"), "tfr")
    drift = summary.withColumn("base", base_model(F.col("model")))
    return drift.join(left, (F.col("base") == F.col("f_model")) & (F.col("lang") == F.col("f_lang"))).drop("f_model", "f_lang")


# --- order, samples, unions


def first_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("at_", at).where(F.col("at_") <= n).drop("at_")


def seeded_sample(rows: DataFrame, keys: list[str], name: str, n: int, seed: int = 42) -> DataFrame:
    """n rows a group, the same in every run: those whose hashes with the seed are least."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(draw, name))
    return rows.withColumn("at_", at).where(F.col("at_") <= n).drop("at_")


def most_common(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of a group (of equals the least) and its count."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("top"))
    return counts.join(top, keys).where("n = top").groupBy(*keys).agg(F.min(value).alias(value), F.max("n").alias("n"))


def last_written(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of shards; of rows with equal keys the last shard's stays."""
    out = None
    for i, shard in enumerate(shards):
        rows = shard.withColumn("shard_", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("shard_").desc()))
    return out.withColumn("at_", at).where("at_ = 1").drop("at_", "shard_")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: overwritten annotations."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order)))
    return rows.withColumn("at_", at).where("at_ = 1").drop("at_")


def drawn(seed: int, *columns: str | Column) -> Column:
    """A whole number below 2 ** 40, from a hash of the columns."""
    name = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(name), 1, 10), 16, 10).cast("long")


def uniform(seed: int, *columns: str) -> Column:
    """In [0, 1), from a hash of the columns."""
    return drawn(seed, *columns) / float(1 << 40)


def friction(turn: Column, roll: Column) -> Column:
    """A user's mood by roll, after the second turn."""
    kind = F.when(roll < 0.15, "pushback").when(roll < 0.25, "confusion").when(roll < 0.35, "tangent").when(roll < 0.42, "impatience").otherwise("none")
    return F.when(turn > 2, kind).otherwise("none")


def rotation(position: Column, seed: int, styles: int = 10) -> Column:
    """The style of a position: every block of `styles` (4 or more) positions uses each style once, in a hashed order that begins
    with two even styles and ends with two odd ones, so that the last two styles never come again at once."""
    block = F.floor(position / styles)

    def shuffled(first: int) -> Column:
        some = F.array(*map(F.lit, range(first, styles, 2)))
        return F.transform(F.array_sort(F.transform(some, lambda i: F.struct(drawn(seed, block, i).alias("h"), i.alias("i")))), lambda x: x.i)

    even, odd = shuffled(0), shuffled(1)
    inner = F.concat(F.slice(even, F.lit(3), F.size(even)), F.slice(odd, F.lit(1), F.size(odd) - 2))
    inner = F.transform(F.array_sort(F.transform(inner, lambda i: F.struct(drawn(seed + 1, block, i).alias("h"), i.alias("i")))), lambda x: x.i)
    order = F.concat(F.slice(even, 1, 2), inner, F.slice(odd, F.size(odd) - 1, F.lit(2)))
    return F.get(order, (position % styles).cast("int"))


# --- attention, as supplied weights


def attention_share(weights: Column, first: int | Column) -> Column:
    """Share of the first positions in a row of weights."""
    plus = lambda a, x: a + x.cast("double")
    head = F.aggregate(F.slice(weights, F.lit(1), first), F.lit(0.0), plus)
    return head / (F.aggregate(weights, F.lit(0.0), plus) + 1e-10)


def attention_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, turn, sys_len, last_token_attention (layer, head, position). The share of the system prompt by head
    averaged over heads (layer_shares) and over layers (share)."""
    mean = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0.0), lambda a, x: a + x) / F.size(c)
    layers = F.transform("last_token_attention", lambda layer: mean(layer, lambda head: attention_share(head, F.col("sys_len"))))
    out = rows.select(*keys, "turn", layers.alias("layer_shares"))
    return out.withColumn("share", mean(F.col("layer_shares"), lambda x: x))


def layer_curves(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The transpose: for each layer its shares in order of turns."""
    each = profile.select(*keys, "turn", F.posexplode("layer_shares").alias("layer", "share"))
    return each.groupBy(*keys, "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "share"))), lambda x: x.share).alias("shares"))
