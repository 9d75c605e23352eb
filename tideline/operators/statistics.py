"""Tests and regressions: sums in Spark, and their tails as columns of the row that is left."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import distributions as D
from tideline.functions.numbers import corr, mixed
from tideline.sources.shared import place, stored


def ols(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r2, adj_r2, f_stat of y on x, over pairs without nulls; nulls below three pairs."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = ok.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    enough = F.col("n") >= 3
    out = fit.select("n", *(F.when(enough, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")))
    df = F.col("n") - 2
    return out.withColumns({"adj_r2": 1 - (1 - F.col("r2")) * F.try_divide((F.col("n") - 1).cast("double"), df), "f_stat": F.try_divide(F.col("r2") * df, 1 - F.col("r2"))})


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, n, f_stat of a one-way analysis of variance."""
    by = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    whole = by.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return whole.select(F.col("k").alias("groups"), F.col("n").cast("long").alias("n"), f.alias("f_stat"))


#: Ranges of values that are numbered apart.
RANGES = 64


def ranks(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """rank_: ranks from 1, ties averaged. Values are counted first; distinct values are cut into ranges at quantiles, numbered inside
    their range, and moved by the counts of the ranges below (RANGES numbers a group)."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n_"))
    ends = F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)])
    part = lambda found: F.size(F.filter(found, lambda e: e < F.col(value))).alias("part_")
    if by:
        found = counts.groupBy(*by).agg(ends.alias("ends_")).withColumnsRenamed({k: f"{k}_of" for k in by})
        same = functools.reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in by))
        parts = counts.join(found, same).select(*counts.columns, part(F.col("ends_")))
    else:
        parts = counts.select("*", part(F.array(*map(F.lit, counts.agg(ends).first()[0] or [None]))))
    below = Window.partitionBy(*by).orderBy("part_") if by else Window.partitionBy(F.lit(0)).orderBy("part_")
    sums = parts.groupBy(*by, "part_").agg(F.sum("n_").alias("all_"))
    sums = sums.select(*by, "part_", (F.sum("all_").over(below) - F.col("all_")).alias("below_"))
    up = Window.partitionBy(*by, "part_").orderBy(value)
    placed = parts.withColumn("upto_", F.sum("n_").over(up)).join(sums, [*by, "part_"])
    placed = placed.select(*by, value, "n_", (F.col("below_") + F.col("upto_") - F.col("n_") + (F.col("n_") + 1) / 2.0).alias("rank_"))
    return rows.join(placed, [*by, value])


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, n, h_stat, corrected for ties."""
    ok = ranks(rows.where(F.col(value).isNotNull()).select(group, value), value)
    by = ok.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank_").alias("r")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    ties = ok.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.when(F.col("ties") < n * n * n - n, 1 - F.col("ties") / (n * n * n - n))
    return by.join(F.broadcast(ties)).select(F.col("k").alias("groups"), F.col("n").cast("long").alias("n"), F.when(F.col("k") > 1, h).alias("h_stat"))  # a row each


def measured(table: DataFrame, judge: str, item: str, value: str) -> DataFrame:
    """judge, item, value without nulls, stored: ranks are found by their values, and a mean computed twice can differ in its last digits."""
    return stored(table.where(F.col(value).isNotNull()).select(judge, item, value), place(table.sparkSession, "measured"))


def kendall_w(table: DataFrame, judge: str, item: str, value: str) -> DataFrame:
    """One row: judges, items, w, chi2. Items that any judge leaves out don't count; no correction for ties."""
    known = measured(table, judge, item, value)
    judges = known.agg(F.count_distinct(judge).alias("m"))
    whole = known.groupBy(item).agg(F.count_distinct(judge).alias("c")).join(F.broadcast(judges), F.col("c") == F.col("m")).select(item)
    summed = ranks(known.join(whole, item), value, [judge]).groupBy(item).agg(F.sum("rank_").alias("r"))
    out = summed.agg(F.count("*").alias("items"), (F.var_pop("r") * F.count("*")).alias("s")).join(F.broadcast(judges))  # a row each
    n, m = F.col("items"), F.col("m")
    w = F.try_divide(12 * F.col("s"), m * m * (n * n * n - n))
    return out.select(m.alias("judges"), "items", F.when(n >= 3, w).otherwise(0.0).alias("w"), F.when(n >= 3, m * (n - 1) * w).otherwise(0.0).alias("chi2"))


def pairs_of(table: DataFrame, judge: str, item: str, value: str) -> DataFrame:
    """a, b (judges, a < b), item, x, y: both values of each item that two judges share."""
    left = table.where(F.col(value).isNotNull()).select(F.col(judge).alias("a"), item, F.col(value).alias("x"))
    right = left.select(F.col("a").alias("b"), item, F.col("x").alias("y"))
    return left.join(right, item).where("a < b")


def kendall_tau(table: DataFrame, judge: str, item: str, value: str) -> DataFrame:
    """a, b, items, tau (b, for ties), discordant, of pairs of judges with three items or more; 0 where it isn't defined.

    Discordant pairs are inversions: in order of x (then y), an item counts those before it with a greater y. Both ranks are
    bits; at each bit two items that agree above it and differ there are met once, by running counts over that prefix. So the
    work grows with the items and the bits of their number, not with pairs of items."""
    both = pairs_of(measured(table, judge, item, value), judge, item, value)
    ranked = ranks(ranks(both, "x", ["a", "b"]).withColumnRenamed("rank_", "rx").drop("n_"), "y", ["a", "b"]).withColumnRenamed("rank_", "ry").drop("n_")
    # Twice an averaged rank is a whole number; of y's rank each prefix of bits is a group.
    rows = ranked.select("a", "b", (F.col("rx") * 2).cast("long").alias("rx"), (F.col("ry") * 2).cast("long").alias("ry"))
    rows = rows.groupBy("a", "b", "rx", "ry").agg(F.count("*").alias("c"))
    # One pass for all counts: bits from 0 on, and as -1, -2 and -3 the items that tie in x, in y and in both.
    parts = """inline(concat(
      transform(sequence(0, 40), bit -> named_struct('bit', bit, 'prefix', shiftright(ry, bit + 1), 'at', rx, 'one', shiftright(ry, bit) & 1L)),
      array(named_struct('bit', -1, 'prefix', rx, 'at', 0L, 'one', 1L), named_struct('bit', -2, 'prefix', ry, 'at', 0L, 'one', 1L), named_struct('bit', -3, 'prefix', ry, 'at', rx, 'one', 1L))))"""
    each = rows.select("a", "b", "c", F.expr(parts))
    each = each.groupBy("a", "b", "bit", "prefix", "at").agg(F.sum(F.col("c") * F.col("one")).alias("high"), F.sum(F.col("c") * (1 - F.col("one"))).alias("low"))
    before = F.sum("high").over(Window.partitionBy("a", "b", "bit", "prefix").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    of = lambda bit, x: F.sum(F.when(F.col("bit") == bit, x)).alias
    tied = F.expr("high * (high - 1) div 2")
    agg = each.withColumn("before", before).groupBy("a", "b").agg(
        F.sum(F.when(F.col("bit") >= 0, F.col("low") * F.coalesce("before", F.lit(0)))).alias("discordant"), of(-1, tied)("tx"), of(-2, tied)("ty"), of(-3, tied)("txy"), of(-1, F.col("high"))("items"))
    agg = agg.withColumn("n", F.expr("items * (items - 1) div 2"))
    s = F.col("n") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("discordant")
    tau = F.try_divide(s, F.sqrt((F.col("n") - F.col("tx")).cast("double") * (F.col("n") - F.col("ty"))))
    return agg.where("items >= 3").select("a", "b", "items", F.coalesce(tau, F.lit(0.0)).alias("tau"), "discordant", ((F.col("tx") + F.col("ty")) > 0).alias("ties"))


def spearman(table: DataFrame, judge: str, item: str, value: str) -> DataFrame:
    """a, b, items, rho of pairs of judges with three items or more; 0 where it isn't defined."""
    both = pairs_of(measured(table, judge, item, value), judge, item, value)
    first = ranks(both, "x", ["a", "b"]).withColumnRenamed("rank_", "rx").drop("n_")
    second = ranks(first, "y", ["a", "b"]).withColumnRenamed("rank_", "ry")
    return second.groupBy("a", "b").agg(F.count("*").alias("items"), F.coalesce(corr("rx", "ry"), F.lit(0.0)).alias("rho")).where("items >= 3")


def t_test(x: Column, first: Column) -> dict[str, Column]:
    """Aggregates t_stat and df of x where `first` holds against where it doesn't, for equal variances."""
    a, b = F.when(first, x), F.when(~first, x)
    n, m = F.count(a), F.count(b)
    pooled = F.try_divide((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b), (n + m - 2).cast("double"))
    return {"t_stat": F.when((n > 1) & (m > 1), F.try_divide(F.avg(a) - F.avg(b), F.sqrt(pooled * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m))))), "df": n + m - 2}


def pearson(x: str, y: str) -> Column:
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3, corr(x, y))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 and df of the independence of two columns, with Yates' correction at one degree of freedom."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    by_a, by_b = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("rb"))
    sides = by_a.agg(F.count("*").alias("ka"), F.sum("ra").cast("double").alias("n")).join(F.broadcast(by_b.agg(F.count("*").alias("kb"))))  # a row each
    # An empty cell adds its own expectation, and all expectations sum to n: only cells with rows are met. Where the
    # correction counts there are two rows and two columns, and |o - e| is the same in all four cells.
    met = cells.join(by_a, a).join(by_b, b).join(F.broadcast(sides))
    e = F.col("ra").cast("double") * F.col("rb") / F.col("n")
    d = F.abs(F.col("o") - e)
    whole = met.agg(F.sum(d * d / e).alias("met"), F.sum(e).alias("seen"), F.first("n").alias("n"), F.first((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.max(d).alias("d"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    full = F.col("met") + F.greatest(F.col("n") - F.col("seen"), F.lit(0.0))
    d = F.col("d") - F.least(F.lit(0.5), F.col("d"))
    ra, rb, n = (F.col(c).cast("double") for c in ("ra", "rb", "n"))
    yates = d * d * n * n * n / (ra * (n - ra) * rb * (n - rb))
    return whole.select(F.when(F.col("df") == 1, yates).otherwise(full).alias("chi2"), "df")


def cohens_d(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, var: what effect() compares."""
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def effects(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """Cohen's d between neighbours of an ordered list of groups: a, b, d (0 without spread), for groups of two or more."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    stats = cohens_d(rows, group, value).where("n > 1").withColumn("at", place).where("at > 0")
    after = stats.select(F.col(group).alias("b"), F.col("mean").alias("m2"), F.col("var").alias("v2"), (F.col("at") - 1).alias("at"))
    pooled = F.sqrt((F.col("var") + F.col("v2")) / 2)
    return stats.join(after, "at").select(F.col(group).alias("a"), "b", F.when(pooled > 0, (F.col("mean") - F.col("m2")) / pooled).otherwise(0.0).alias("d"))


#: Values of a group that one task resamples.
BLOCK = 4096


def block_shares(sizes: list[int], at: int, resamples: int, seed: int) -> np.ndarray:
    """How many of a resample's draws fall into block `at`, by resample: the blocks' shares are multinomial. Blocks are halved
    down to one; a half's draws depend on seed and place in the tree only, so all tasks agree without talking."""
    lo, hi, node = 0, len(sizes), 1
    left = np.full(resamples, sum(sizes))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        draw = np.random.RandomState([seed, node]).binomial(left, sum(sizes[lo:mid]) / sum(sizes[lo:hi]))
        left, lo, hi, node = (draw, lo, mid, 2 * node) if at < mid else (left - draw, mid, hi, 2 * node + 1)
    return left


#: Draws made in one go.
DRAWS = 1 << 20


def counted_sums(values: np.ndarray, draws: np.ndarray, at: int, seed: int) -> np.ndarray:
    """The sum of draws[r] values for each resample r. Draw k of resample r in block `at` is a hash of the seed, at, r and k: a
    start and a stride of the resample's own, and the mixed k-th number from there."""
    key = mixed(mixed(np.array([seed], np.uint64)) + np.uint64(at))
    own = np.arange(len(draws), dtype=np.uint64) * np.uint64(2)
    start, stride = mixed(key + own), mixed(key + own + np.uint64(1)) | np.uint64(1)
    out, upto = np.zeros(len(draws)), np.cumsum(draws)
    for some in np.split(np.arange(len(draws)), np.flatnonzero(np.diff(upto // DRAWS)) + 1):
        n = draws[some]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = mixed(np.repeat(start[some], n) + k.astype(np.uint64) * np.repeat(stride[some], n)) % np.uint64(len(values))
        out[some] = np.bincount(np.repeat(np.arange(len(some)), n), weights=values[place], minlength=len(some))
    return out


def bootstrap(rows: DataFrame, keys: list[str], value: str, order: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """keys, n, mean, lower, upper: the mean and its 95 % percentile interval over resamples; nulls are dropped, an empty group gives
    zeros. Blocks of a group's values are resampled in tasks of their own, in the order of a column, and draws are
    counted, not taken from a generator, so the seed gives the same interval in every run and in every engine."""

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.sort_values(["order_", "value_"])["value_"].to_numpy(float)
        sizes, at = [int(x) for x in pdf["sizes_"].iloc[0]], int(pdf["at_"].iloc[0])
        total = counted_sums(known, block_shares(sizes, at, resamples, seed), at, seed)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * (resamples + 1) for k in keys}, "at_": at, "resample_": range(-1, resamples), "sum_": [known.sum(), *total]})  # -1: all values

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def with_group(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnsRenamed({k: f"{k}_of" for k in keys})
        same = functools.reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys))
        return left.join(right, same, how).drop(*(f"{k}_of" for k in keys))

    part = rows.select(*keys, F.col(value).cast("double").alias("value_"), F.col(order).alias("order_"))
    groups = part.groupBy(*keys).agg(F.count("value_").alias("n"))
    part = part.where("value_ is not null")
    dealt = with_group(part, groups).select(*keys, "value_", "order_", F.pmod(F.xxhash64("order_", "value_"), F.ceil(F.col("n") / BLOCK)).alias("block_"))
    blocks = dealt.groupBy(*keys, "block_").count().groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_", "count"))).alias("blocks_"))
    dealt = with_group(dealt, blocks).select(*keys, "value_", "order_", (F.array_position("blocks_.block_", F.col("block_")) - 1).alias("at_"), F.col("blocks_.count").alias("sizes_"))
    drawn = dealt.groupBy(*keys, "at_").applyInPandas(sums, f"{kinds}, at_ long, resample_ long, sum_ double")
    drawn = drawn.groupBy(*keys, "resample_").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at_", "sum_"))), F.lit(0.0), lambda t, x: t + x["sum_"]).alias("sum_"))
    ends = drawn.groupBy(*keys).agg(F.percentile(F.when(F.col("resample_") >= 0, F.col("sum_")), F.array(F.lit(0.025), F.lit(0.975))).alias("ends_"), F.max(F.when(F.col("resample_") < 0, F.col("sum_"))).alias("all_"))
    per = lambda c: F.coalesce(F.try_divide(c, F.col("n")), F.lit(0.0))
    return with_group(groups, ends, "left").select(*keys, "n", per(F.col("all_")).alias("mean"), per(F.col("ends_")[0]).alias("lower"), per(F.col("ends_")[1]).alias("upper"))


def p_value(kind: str) -> Column:
    """The p value of a row of a test. kind: ols, anova, kruskal, kendall_w, kendall_tau, spearman, t, pearson or chi2."""
    c = F.col
    if kind == "ols":
        return D.f_tail(c("f_stat"), F.lit(1), c("n") - 2)
    if kind == "anova":
        return D.f_tail(c("f_stat"), c("groups") - 1, c("n") - c("groups"))
    if kind == "kruskal":
        return D.chi2_tail(c("h_stat"), c("groups") - 1)
    if kind == "kendall_w":
        return F.when(c("items") >= 3, D.chi2_tail(c("chi2"), c("items") - 1)).otherwise(1.0)
    if kind == "kendall_tau":
        n = c("items")
        z = 3 * c("tau") * F.sqrt(n * (n - 1)) / F.sqrt(2 * (2 * n + 5))
        return F.when(c("ties") | (n > 33), D.normal_two_sided(z)).otherwise(D.kendall_two_sided(c("discordant"), n))
    if kind in ("spearman", "pearson"):
        r, n = c("rho" if kind == "spearman" else "r"), c("items" if kind == "spearman" else "n")
        return D.t_two_sided(F.abs(r) * F.sqrt(F.greatest(n - 2, F.lit(0)) / F.greatest(1 - r * r, F.lit(1e-300))), n - 2)
    if kind == "t":
        return D.t_two_sided(c("t_stat"), c("df"))
    return D.chi2_tail(c("chi2"), c("df"))
