"""URL filters: rules by host and path, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs (those that the rules allow and block, all of them),
give each URL the mean log-likelihood difference per character. A model holds counts of (context, character) for contexts
of 0 to ORDER characters, keyed by the context itself: a table that grows with the labelled URLs. A longer context's
estimate is smoothed towards that of the next shorter one by STRENGTH; a context never seen leaves it as it is. A character
after its longest context decides all shorter ones, so each distinct such gram is costed once, and URLs sum their grams.
The threshold is calibrated on a tenth of the labelled URLs that the models leave out (by hash): the cut between their
scores with the fewest balanced errors, from a histogram.

Edge cases: a null URL, or one without `://`, has an empty host and path, no rule and no characters, and is allowed.
Repeated URLs count each. URLs of any length are scored whole. Columns named like the results are replaced. Where one class has no URLs all undecided ones are allowed. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, small_or_shuffled, stored

ORDER = 5
#: Contexts of fewer characters than this are few and shared by all grams: they go to the grams at any size.
SHORT = 2
STRENGTH = 2.0
#: One labelled URL in so many calibrates the threshold.
HELD_OUT = 10
#: Calibration scores are counted in so many bins of width 1 / 64 around 0.
BINS = 2048
#: Rules: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ALPHABET = 256.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and rule_verdict: of the fitting rules the longest."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict", "score", "verdict", "url_bytes")]
    out = pages.select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for say, host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, host + prefix).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every character of every URL: the gram of its ORDER characters before and itself, 9 bits each, and its URL."""
    size = np.array([len(u) for u in urls], np.int64)
    of = np.repeat(np.arange(len(urls)), size)
    chars = np.frombuffer(b"".join(urls), np.uint8).astype(np.int64) + 1
    within = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    gram = chars.copy()
    for k in range(1, ORDER + 1):
        before = np.concatenate((np.zeros(k, np.int64), chars))[: len(chars)]
        gram |= np.where(within >= k, before, 257) << (9 * k)  # 257: before the start
    return gram, of


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of each row and how often, with the row's other columns."""
    for batch in batches:
        gram, of = grams([u or b"" for u in batch.column(0).to_pylist()])
        order = np.lexsort((gram, of))
        gram, of = gram[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])))[: len(gram)])
        times = np.diff(np.append(first, len(gram)))
        own = [batch.column(i).take(pa.array(of[first])) for i in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(gram[first]), pa.array(times.astype(np.int64))], names=[*batch.schema.names[1:], "gram", "times"])


def _contexts(orders: Iterable[int]) -> Column:
    """k, context of the orders, of a column gram."""
    some = [f"named_struct('k', {k}, 'context', shiftleft(shiftright(gram, 9) & {(1 << 9 * k) - 1}L, 3) | {k}L)" for k in orders]
    return F.expr(f"inline(array({', '.join(some)}))")


def fit(labelled: DataFrame) -> DataFrame:
    """context, allow, block (how often in accepted and rejected URLs) and hits (the same by character), of labelled (url, blocked)."""
    rows = labelled.select(F.col("url").cast("binary"), "blocked").mapInArrow(_counted, "blocked boolean, gram long, times long")
    sums = [F.sum(F.when(F.col("blocked") == say, F.col("times")).otherwise(0)).alias(n) for n, say in (("allow", False), ("block", True))]
    whole = stored(rows.groupBy("gram").agg(*sums), "url-grams")
    each = whole.select(F.expr("gram & 511L").alias("char"), "allow", "block", _contexts(range(ORDER + 1)))
    each = each.groupBy("context", "char").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    hits = F.map_from_entries(F.collect_list(F.struct("char", F.struct("allow", "block")))).alias("hits")  # at most 256 characters
    return stored(each.groupBy("context").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), hits), "url-contexts")


def _ratios(some: DataFrame, model: DataFrame, strength: float) -> DataFrame:
    """gram, ratio: the log-likelihood as accepted less that as rejected of distinct grams."""
    short = F.broadcast(model.where(f"(context & 7L) < {SHORT}"))  # at most 1 + 257 rows of 256 characters
    long = small_or_shuffled(model.where(f"(context & 7L) >= {SHORT}"))
    each = some.select("gram", _contexts(range(SHORT))).join(short, "context", "left").unionByName(some.select("gram", _contexts(range(SHORT, ORDER + 1))).join(long, "context", "left"))
    each = each.withColumn("hit", F.expr("hits[gram & 511L]"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    seen = F.struct("k", zero(F.col("allow")).alias("na"), zero(F.col("hit.allow")).alias("ha"), zero(F.col("block")).alias("nb"), zero(F.col("hit.block")).alias("hb"))
    step = lambda n, h, p: F.when(n > 0, (h + strength * p) / (n + strength)).otherwise(p)
    start = F.struct(F.lit(1 / ALPHABET).alias("a"), F.lit(1 / ALPHABET).alias("b"))
    end = F.aggregate(F.sort_array(F.collect_list(seen)), start, lambda p, x: F.struct(step(x.na, x.ha, p.a).alias("a"), step(x.nb, x.hb, p.b).alias("b")), lambda p: F.log(p.a) - F.log(p.b))
    return each.groupBy("gram").agg(end.alias("ratio"))


def scored(rows: DataFrame, model: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """rows (with url) and their score: the mean over a URL's characters; 0 for an empty one."""
    key = F.struct(F.xxhash64("url"), F.hash("url"))
    urls = rows.where("length(url) > 0").select(F.col("url").cast("binary").alias("url"), F.xxhash64("url").alias("url_a"), F.hash("url").alias("url_b"))
    held = stored(urls.dropDuplicates(["url_a", "url_b"]).mapInArrow(_counted, "url_a long, url_b int, gram long, times long"), "grams-of-urls")
    ratio = stored(_ratios(held.select("gram").distinct(), model, strength), "ratios")
    total = F.sum((F.col("ratio") * F.col("times")).cast("decimal(30,15)")).cast("double")  # the same in any order
    score = held.join(small_or_shuffled(ratio), "gram").groupBy("url_a", "url_b").agg((total / F.sum("times")).alias("score"))
    own, of = (max(rows.columns, key=len) + end for end in ("_key", "_of"))  # no column has these names
    score = score.select(F.struct("url_a", "url_b").alias(of), "score")
    out = rows.withColumn(own, key).join(score, F.col(f"{own}.col1").eqNullSafe(F.col(f"{of}.url_a")) & F.col(f"{own}.col2").eqNullSafe(F.col(f"{of}.url_b")), "left")
    return out.select(*rows.columns, F.coalesce("score", F.lit(0.0)).alias("score"))


def log_ratio(urls: list[bytes], model: DataFrame, strength: float = STRENGTH) -> np.ndarray:
    """Scores of a few URLs."""
    rows = model.sparkSession.createDataFrame([(i, u.decode()) for i, u in enumerate(urls)], "at int, url string")
    return np.array([r["score"] for r in sorted(scored(rows, model, strength).collect(), key=lambda r: r["at"])])


def threshold(held_out: DataFrame) -> float:
    """The cut with the least sum of both classes' error rates over held_out (score, blocked); 0 if a class is missing."""
    at = F.least(F.greatest(F.floor(F.col("score") * 64) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = np.zeros((2, BINS))
    for r in held_out.groupBy("blocked", at.alias("at")).count().collect():  # at most 2 * BINS rows
        counts[int(r["blocked"]), r["at"]] = r["count"]
    totals = counts.sum(axis=1)
    if not totals.all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(counts, axis=1)), axis=1) / totals[:, None]
    wrong = below[0] + 1 - below[1]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((best[len(best) // 2] - BINS // 2) / 64)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, score and verdict: the longest rule's, else allow where the score reaches the threshold."""
    marked = ruled(pages, rules)
    aside = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    blocked = (F.col("rule_verdict") == "block").alias("blocked")
    labelled = marked.where("rule_verdict is not null")
    model = fit(labelled.where(~aside).select("url", blocked))
    every = stored(scored(marked, model), "scored")
    both = model.where("context = 0 and allow > 0 and block > 0").count() > 0  # the context of no characters
    cut = threshold(every.where("rule_verdict is not null").where(aside).select("score", blocked)) if both else -float("inf")
    method = F.when((F.col("score") >= cut) | (F.length("host") + F.length("path") == 0), "allow").otherwise("block")
    return every.withColumn("verdict", F.coalesce("rule_verdict", method)).drop("rule_verdict")
