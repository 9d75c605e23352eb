"""Tests and regressions, streams, sources."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from tideline.operators import curves, scenarios, scoring
from tideline.operators import statistics as S
from tideline.plans.curve_queries import RUNS
from tideline.plans.frames import KEY, rounded, scores, table, unsigned_zero
from tideline.plans.score_queries import TURNS_SQL
from tideline.sources import tables
from tideline.sources.shared import place
from tideline.streaming import live


def ols_slope_r2(spark, folder):
    return rounded(S.ols(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), 4)


def anova_f(spark, folder):
    return rounded(S.anova(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice"))


def kruskal_h(spark, folder):
    return rounded(S.kruskal(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


def _means(spark, folder):
    rows = scores(spark, folder)
    return rows.groupBy("model", "lang").agg(F.avg("ddm").alias("m"))


MEANS = f"{RUNS}, m AS (SELECT model, lang, avg(ddm) AS m FROM scores GROUP BY ALL)"


def kendall_w(spark, folder):
    return rounded(S.kendall_w(_means(spark, folder), "model", "lang", "m"))


def kendall_tau_b(spark, folder):
    return rounded(S.kendall_tau(_means(spark, folder), "model", "lang", "m").drop("ties"))


def spearman_rho(spark, folder):
    return rounded(S.spearman(_means(spark, folder), "model", "lang", "m"))


def ttest_stat(spark, folder):
    rows = table(spark, folder, "events")
    return rounded(rows.groupBy("event_type").agg(*(c.alias(n) for n, c in S.t_test(F.col("value"), F.col("event_id") % 3 == 0).items())))


def pearson_r(spark, folder):
    return rounded(table(spark, folder, "lineitem").groupBy("l_returnflag").agg(S.pearson("l_quantity", "l_extendedprice").alias("r")))


def chi2_stat(spark, folder):
    return rounded(S.chi_square(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority"))


def chi2_yates(spark, folder):
    return rounded(S.chi_square(table(spark, folder, "labels"), "quality", "toxic"))


def cohens_d(spark, folder):
    rows = curves.curve_summary(scores(spark, folder), KEY)
    return rounded(S.effects(rows, "tier", "mean_ddm", ["short", "medium", "long"]))


def bootstrap_ci(spark, folder):
    rows = curves.curve_summary(scores(spark, folder), KEY)
    return rounded(S.bootstrap(rows, ["model", "lang"], "mean_ddm", "conv_id", resamples=10_000))


def p_values(spark, folder):
    """Every test's p value on the same tables."""
    runs = {"ols": ols_slope_r2, "anova": anova_f, "kruskal": kruskal_h, "kendall_w": kendall_w, "kendall_tau": lambda s, f: S.kendall_tau(_means(s, f), "model", "lang", "m"), "spearman": spearman_rho, "t": ttest_stat, "chi2": chi2_stat}
    each = [query(spark, folder).select(F.lit(kind).alias("test"), S.p_value(kind).alias("p")) for kind, query in runs.items()]
    return rounded(functools.reduce(lambda x, y: x.union(y), each).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False))))


def perplexity(spark, folder):
    logs = table(spark, folder, "events").select("user_id", (-F.col("value") / 100).alias("log_prob"))
    return rounded(scenarios.perplexity(logs, ["user_id"]))


# --- streams


def _place(spark, name):
    return place(spark, name)


def _events(spark, folder):
    path = f"{folder}/events.parquet"
    return spark.read.parquet(path), path


def stream_event_windows(spark, folder):
    rows, path = _events(spark, folder)
    stream = spark.readStream.schema(rows.schema).parquet(path if "*" in path else path + "*")
    name = f"w{uuid.uuid4().hex}"
    return rounded(live.run_available(live.windowed(stream, "1 day", late="0 seconds"), name, _place(spark, name), "complete"))


def event_windows(spark, folder):
    return rounded(live.windowed(_events(spark, folder)[0], "1 day", "12 hours"))


def event_sessions(spark, folder):
    return rounded(live.sessions(_events(spark, folder)[0], "6 hours"))


def stream_turn_scores(spark, folder):
    from tideline.plans.frames import messages

    name = f"s{uuid.uuid4().hex}"
    at = _place(spark, f"{name}-in")
    replies = scoring.role_ordinal(messages(spark, folder).where("role = 'assistant'"), ("conv_id",)).select("conv_id", "turn", "text")
    replies.write.parquet(at)
    return rounded(live.run_available(live.stream_scores(spark.readStream.schema(replies.schema).parquet(at)), name, _place(spark, name)))


def stream_numbered_scores(spark, folder):
    """The replies shuffled over four batches, without their turns; a last message, long after, lets the last ones go."""
    from tideline.plans.frames import messages

    name = f"n{uuid.uuid4().hex}"
    at = _place(spark, f"{name}-in")
    rows = messages(spark, folder).where("role = 'assistant'").select("conv_id", "msg_idx", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("msg_idx")).alias("at"), "text")
    rows.repartition(4, F.xxhash64("conv_id", "msg_idx")).write.parquet(at)
    end = rows.agg(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("msg_idx"), (F.coalesce(F.max("at"), F.timestamp_seconds(F.lit(0))) + F.expr("INTERVAL 400 DAYS")).alias("at"), F.lit("").alias("text"))
    end.write.mode("append").parquet(at)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
    numbered = live.number_turns(stream, "300 days")
    return rounded(live.with_rocks(spark, lambda: live.run_available(live.stream_scores(numbered), name, _place(spark, name))))


def stream_curve_state(spark, folder):
    name = f"c{uuid.uuid4().hex}"
    at = _place(spark, f"{name}-in")
    scores(spark, folder).select("conv_id", "turn", "ddm").repartition("conv_id").write.parquet(at)
    stream = spark.readStream.schema("conv_id long, turn long, ddm double").parquet(at)
    return rounded(live.run_available(live.stream_curves(stream), name, _place(spark, name), "update", ("conv_id",)))


# --- sources: written by our writers, read by our readers


def jsonl_round_trip(spark, folder):
    at = _place(spark, "parallel")
    rows = table(spark, folder, "conversations").select(F.lit("short").alias("tier"), F.expr("CASE conv_id % 2 WHEN 0 THEN 'en' ELSE 'it' END").alias("lang"), "conv_id", F.col("turn").alias("msg_idx"), "role", "text")
    line = F.to_json(F.struct("role", "text"))
    lists = rows.groupBy("lang", "conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", line.alias("line")))), lambda x: x.line), "\n").alias("value"))
    lists.repartition(8, "conv_id").select("value", "lang").write.partitionBy("lang").text(at)
    back = tables.read_conversations(spark, f"{at}/*/*.txt")
    return rounded(back.groupBy(F.regexp_replace("lang", "lang=", "").alias("lang"), "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))


def master_round_trip(spark, folder):
    at = _place(spark, "masters")
    rows = table(spark, folder, "conversations").select("conv_id", F.lit("en").alias("lang"), F.col("turn").alias("msg_idx"), "role", "text")
    tables.write_masters(rows, at)
    docs = spark.read.schema(tables.MASTER).json(at)
    each = docs.select(F.col("id").alias("conv_id"), F.explode("conversations").alias("lang", "m")).select("conv_id", F.posexplode("m").alias("msg_idx", "m"))
    return rounded(each.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count("*").alias("n"), F.sum(F.length(tables.said(F.col("m")))).alias("chars")))


def summary_csv_round_trip(spark, folder):
    at = _place(spark, "bundle")
    rows = curves.curve_summary(scores(spark, folder), KEY).withColumnsRenamed({"conv_id": "conversation_id", "lang": "language"})
    rows = rows.select(*(c.split()[0] for c in tables.SUMMARY.split(", ")))
    tables.write_bundle(rows, rows, rows, rows, at, "csv")
    return rounded(tables.read_summary(spark, f"{at}/drift_summary").select(F.col("conversation_id").cast("long").alias("conv_id"), "total_turns", "drift_onset", "auc"))


QUERIES = {f.__name__: f for f in (
    ols_slope_r2, anova_f, kruskal_h, kendall_w, kendall_tau_b, spearman_rho, ttest_stat, pearson_r, chi2_stat, chi2_yates, cohens_d, bootstrap_ci, p_values, perplexity, stream_event_windows, event_windows, event_sessions,
    stream_turn_scores, stream_numbered_scores, stream_curve_state, jsonl_round_trip, master_round_trip, summary_csv_round_trip)}
CHI = lambda t, a, b, yates: f"""WITH o AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {t} GROUP BY ALL), ra AS (SELECT a, sum(o) AS ra FROM o GROUP BY a), rb AS (SELECT b, sum(o) AS rb FROM o GROUP BY b), n AS (SELECT sum(o) AS n FROM o),
e AS (SELECT coalesce(o.o, 0) AS o, ra * rb / n AS e FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN o USING (a, b)) SELECT round(sum(power(abs(o - e) - {"least(0.5, abs(o - e))" if yates else "0"}, 2) / e), 6) AS chi2, (SELECT count(*) - 1 FROM ra) * (SELECT count(*) - 1 FROM rb) AS df FROM e"""  # noqa: E731
RANKED = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0::DOUBLE"
PAIRS = f"{MEANS}, p AS (SELECT x.model AS a, y.model AS b, x.lang, x.m AS x, y.m AS y FROM m x JOIN m y ON x.lang = y.lang AND x.model < y.model)"
ORACLES = {
    "ols_slope_r2": unsigned_zero("WITH f AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem) SELECT n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 4) AS adj_r2, round(r2 * (n - 2) / (1 - r2), 4) AS f_stat FROM f", "adj_r2", "r2"),
    "anova_f": "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mm, sum(n * v) AS w FROM g) SELECT k AS groups, CAST(n AS BIGINT) AS n, round(((SELECT sum(g.n * power(g.m - t.mm, 2)) FROM g) / (k - 1)) / (w / (n - k)), 6) AS f_stat FROM t",
    "kruskal_h": "WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM v), q AS (SELECT sum(s * s / n) AS q, count(*) AS k, sum(n)::DOUBLE AS n FROM (SELECT g, sum(r) AS s, count(*) AS n FROM r GROUP BY g)), t AS (SELECT sum(power(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY v)) SELECT k AS groups, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (power(n, 3) - n)), 4) AS h_stat FROM q, t",
    "kendall_w": f"{MEANS}, r AS (SELECT lang, {RANKED.format('model', 'm')} AS r FROM m), s AS (SELECT lang, sum(r) AS r FROM r GROUP BY lang), t AS (SELECT count(*) AS n, var_pop(r) * count(*) AS s, (SELECT count(DISTINCT model) FROM m) AS m FROM s) SELECT m AS judges, n AS items, round(12 * s / (m * m * (power(n, 3) - n)), 6) AS w, round(m * (n - 1) * 12 * s / (m * m * (power(n, 3) - n)), 6) AS chi2 FROM t",
    "kendall_tau_b": f"{PAIRS}, q AS (SELECT u.a, u.b, sign(u.x - v.x) * sign(u.y - v.y) AS s, u.x = v.x AS tx, u.y = v.y AS ty FROM p u JOIN p v ON u.a = v.a AND u.b = v.b AND u.lang < v.lang) SELECT a, b, CAST((1 + sqrt(1 + 8 * count(*))) / 2 AS BIGINT) AS items, round(sum(s) / sqrt((count(*) - count(*) FILTER (tx))::DOUBLE * (count(*) - count(*) FILTER (ty))), 6) AS tau, count(*) FILTER (s < 0) AS discordant FROM q GROUP BY a, b",
    "spearman_rho": f"{PAIRS}, r AS (SELECT a, b, {RANKED.format('a, b', 'x')} AS rx, {RANKED.format('a, b', 'y')} AS ry FROM p) SELECT a, b, count(*) AS items, round(corr(rx, ry), 6) AS rho FROM r GROUP BY a, b",
    "ttest_stat": "WITH s AS (SELECT event_type, count(value) FILTER (event_id % 3 = 0) AS n, count(value) FILTER (event_id % 3 <> 0) AS m, avg(value) FILTER (event_id % 3 = 0) AS a, avg(value) FILTER (event_id % 3 <> 0) AS b, var_samp(value) FILTER (event_id % 3 = 0) AS v, var_samp(value) FILTER (event_id % 3 <> 0) AS w FROM events GROUP BY event_type) SELECT event_type, round((a - b) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1.0::DOUBLE / n + 1.0::DOUBLE / m)), 6) AS t_stat, n + m - 2 AS df FROM s",
    "pearson_r": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag",
    "chi2_stat": CHI("orders", "o_orderstatus", "o_orderpriority", False),
    "chi2_yates": CHI("labels", "quality", "toxic", True),
    "cohens_d": unsigned_zero(f"{RUNS}, g AS (SELECT tier, avg(mean_ddm) AS m, var_samp(mean_ddm) AS v, CASE tier WHEN 'short' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS at_ FROM summary GROUP BY tier HAVING count(*) > 1) SELECT x.tier AS a, y.tier AS b, round((x.m - y.m) / sqrt((x.v + y.v) / 2), 6) AS d FROM g x JOIN g y ON y.at_ = x.at_ + 1", "d"),
    "perplexity": "SELECT user_id, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY user_id",
    "stream_event_windows": "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start_s, CAST(floor(epoch(ts) / 86400) * 86400 + 86400 AS BIGINT) AS end_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "event_windows": "WITH w AS (SELECT unnest([CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT), CAST(floor(epoch(ts) / 43200) * 43200 - 43200 AS BIGINT)]) AS s, event_type, value FROM events) SELECT s AS start_s, s + 86400 AS end_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, epoch(ts) AS t, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(min(t)) AS BIGINT) AS start_s, CAST(floor(max(t)) + 21600 AS BIGINT) AS end_s, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_turn_scores": f"SELECT conv_id, turn, l1, l2, l3, l4, l5, ddm FROM ({TURNS_SQL.replace('CASE lang', 'CASE $$en$$')})",
    "stream_numbered_scores": f"SELECT conv_id, turn, l1, l2, l3, l4, l5, ddm FROM ({TURNS_SQL.replace('CASE lang', 'CASE $$en$$')})",
    "stream_curve_state": f"{RUNS} SELECT conv_id, total_turns AS n, round(mean_ddm, 6) AS mean, round(auc, 6) AS auc, drift_onset AS dop, sustained_dop AS sdop, half_life, total_collapse AS collapse, recovery_events AS recoveries FROM summary",
    "jsonl_round_trip": "SELECT CASE conv_id % 2 WHEN 0 THEN 'en' ELSE 'it' END AS lang, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ALL",
    "master_round_trip": "SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
    "summary_csv_round_trip": f"{RUNS} SELECT conv_id, total_turns, drift_onset, round(auc, 6) AS auc FROM summary",
}
MIX_SQL = lambda n, x: f"{x} & 4294967295 AS {n}_0, (xor({n}_0, {n}_0 >> 16) * 73244475) & 4294967295 AS {n}_1, (xor({n}_1, {n}_1 >> 16) * 73244475) & 4294967295 AS {n}_2, xor({n}_2, {n}_2 >> 16) AS {n}"
#: Groups of one block, which all are here.
ORACLES["bootstrap_ci"] = f"""{RUNS}, g AS (SELECT model, lang, list(mean_ddm ORDER BY conv_id, mean_ddm) AS v, count(mean_ddm) AS n FROM summary GROUP BY model, lang),
seeded AS (SELECT {MIX_SQL("s", "42::BIGINT")}, {MIX_SQL("key", "s")}),
lanes AS (SELECT r, {MIX_SQL("start", "key + 2 * r")}, {MIX_SQL("odd", "key + 2 * r + 1")}, odd | 1 AS stride FROM seeded, range(10000) AS t(r)),
draws AS (SELECT model, lang, n, r, v[1 + h % n] AS x FROM (SELECT model, lang, v, n, r, {MIX_SQL("h", "start + k * stride")} FROM (SELECT *, unnest(range(n)) AS k FROM g), lanes)),
sums AS (SELECT model, lang, r, sum(x) / n AS m FROM draws GROUP BY model, lang, n, r)
SELECT model, lang, n, round(list_sum(v) / n, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM sums JOIN g USING (model, lang) GROUP BY model, lang, n, v"""
#: The incomplete beta function's fraction half a step at a time, the gamma function's series and fraction, and Kendall's counts.
ORACLES["p_values"] = f"""WITH RECURSIVE tests(test, kind, a, b, x) AS (
  SELECT 'ols', 'beta', (n - 2) / 2.0::DOUBLE, 0.5::DOUBLE, (n - 2)::DOUBLE / (f_stat + n - 2) FROM ({ORACLES["ols_slope_r2"]})
  UNION ALL SELECT 'anova', 'beta', (n - groups) / 2.0::DOUBLE, (groups - 1) / 2.0::DOUBLE, (n - groups)::DOUBLE / ((groups - 1) * f_stat + n - groups) FROM ({ORACLES["anova_f"]})
  UNION ALL SELECT 'kruskal', 'gamma', (groups - 1) / 2.0::DOUBLE, 0, h_stat / 2 FROM ({ORACLES["kruskal_h"]})
  UNION ALL SELECT 'kendall_w', 'gamma', (items - 1) / 2.0::DOUBLE, 0, chi2 / 2 FROM ({ORACLES["kendall_w"]})
  UNION ALL SELECT 'spearman', 'beta', (items - 2) / 2.0::DOUBLE, 0.5, (items - 2) / (items - 2 + rho * rho * (items - 2) / greatest(1 - rho * rho, 1e-300)) FROM ({ORACLES["spearman_rho"]})
  UNION ALL SELECT 't', 'beta', df / 2.0::DOUBLE, 0.5, df / (df + t_stat * t_stat) FROM ({ORACLES["ttest_stat"]})
  UNION ALL SELECT 'chi2', 'gamma', df / 2.0::DOUBLE, 0, chi2 / 2 FROM ({ORACLES["chi2_stat"]})
  UNION ALL SELECT 'kendall_tau', 'count', items, discordant, 0 FROM ({ORACLES["kendall_tau_b"]})),
named AS MATERIALIZED (SELECT *, row_number() OVER () AS id, kind = 'beta' AND x >= (a + 1) / (a + b + 2) AS swap FROM tests),
sides AS MATERIALIZED (SELECT id, CASE WHEN swap THEN b ELSE a END AS a, CASE WHEN swap THEN a ELSE b END AS b, CASE WHEN swap THEN 1 - x ELSE x END AS x, swap FROM named WHERE kind = 'beta'),
beta(id, a, b, x, i, c, d, f) AS (
  SELECT id, a, b, x, 1, 1.0::DOUBLE, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)) FROM sides
  UNION ALL SELECT id, a, b, x, i + 1, 1 + t / c, 1 / (1 + t * d), f * (1 + t / c) / (1 + t * d)
  FROM (SELECT *, CASE WHEN i % 2 = 1 THEN m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) ELSE -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) END AS t FROM (SELECT *, (i + 1) // 2 AS m FROM beta))
  WHERE i <= 2 * (100 + 10 * ceil(sqrt(greatest(a, b))))),
gamma(id, a, x, i, term, total, c, d, f) AS (
  SELECT id, a, x, 1, 1 / a, 1 / a, 1e300::DOUBLE, 1 / (x + 1 - a), 1 / (x + 1 - a) FROM named WHERE kind = 'gamma'
  UNION ALL SELECT id, a, x, i + 1, term * x / (a + i), total + term * x / (a + i), y - i * (i - a) / c, 1 / (y - i * (i - a) * d), f * (y - i * (i - a) / c) / (y - i * (i - a) * d)
  FROM (SELECT *, x + 1 - a + 2 * i AS y FROM gamma) WHERE i <= 100 + 10 * ceil(sqrt(a))),
orders(k, c) AS (SELECT 1, [1.0::DOUBLE] UNION ALL SELECT k + 1, list_transform(range(0, len(c) + k), lambda i: list_sum(c[greatest(1, i - k + 1):i + 1])) FROM orders WHERE k < 33),
p AS (
  SELECT n.test, CASE WHEN n.x <= 0 THEN 0 ELSE CASE WHEN s.swap THEN 1 - v ELSE v END END AS p FROM named n JOIN sides s USING (id) JOIN (
    SELECT id, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * arg_max(f, i) / a AS v FROM beta GROUP BY id, a, b, x) USING (id)
  UNION ALL SELECT n.test, exp(n.a * ln(n.x) - n.x - lgamma(n.a)) * v FROM named n JOIN (
    SELECT id, CASE WHEN x < a + 1 THEN exp(lgamma(a) + x - a * ln(x)) - arg_max(total, i) ELSE arg_max(f, i) END AS v FROM gamma GROUP BY id, a, x) USING (id)
  UNION ALL SELECT test, CASE WHEN 2 * less < a * (a - 1) / 2 THEN least(1, 2 * list_sum(c[1:less + 1]) / list_sum(c)) ELSE 1 END
  FROM (SELECT *, CAST(least(b, a * (a - 1) / 2 - b) AS BIGINT) AS less FROM named WHERE kind = 'count') JOIN orders ON k = a)
SELECT test, round(p, 6) + 0.0::DOUBLE AS p, p < 0.05 AS significant FROM p"""
