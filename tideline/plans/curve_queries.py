"""Curve metrics, and what happens around an event, on the events' curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import curves, scenarios, scoring
from tideline.operators.scoring import LEVELS
from tideline.plans.frames import KEY, SCORES_SQL, rounded, scores, unsigned_zero
from tideline.plans.score_queries import TURNS_SQL

K = "model, tier, lang, conv_id"
BASE = f"WITH {SCORES_SQL}"
SUMMARY_CTE = lambda key: f"""
marked AS (SELECT *, min(turn) FILTER (ddm < 1) OVER (PARTITION BY {key}) AS dop, sum(CASE WHEN ddm < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM scores),
summary AS (
  SELECT {key}, count(*) AS total_turns, avg(ddm) AS mean_ddm, stddev_pop(ddm) AS std_ddm,
    CASE WHEN count(*) = 1 THEN max(ddm) ELSE (sum(ddm) - (arg_min(ddm, turn) + arg_max(ddm, turn)) / 2) / nullif(count(*) - 1, 0) END AS auc,
    min(dop) AS drift_onset, min(turn) FILTER (run = 3) AS sustained_dop, min(turn) FILTER (ddm = 0) AS total_collapse, min(turn) FILTER (ddm <= 0.5) AS half_life,
    count(*) FILTER (turn > dop AND ddm >= 1) AS recovery_events,
    CASE WHEN min(dop) IS NULL THEN 1.0::DOUBLE ELSE coalesce((count(*) FILTER (turn > dop AND ddm >= 1))::DOUBLE / nullif(count(*) FILTER (turn > dop), 0), 0) END AS recovery_rate
  FROM marked GROUP BY {key})"""  # noqa: E731
RUNS = f"""{BASE}, {SUMMARY_CTE(K)},
decay AS (
  SELECT {K}, {", ".join(f"avg({n}) AS {n}_mean, CASE WHEN count(*) = 1 THEN max({n}) ELSE (sum({n}) - (arg_min({n}, turn) + arg_max({n}, turn)) / 2) / nullif(count(*) - 1, 0) END AS {n}_auc, min(turn) FILTER ({n} < 1) AS {n}_onset" for n in LEVELS)}
  FROM scores GROUP BY {K})"""
ROUND = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
SUMMARY_COLUMNS = f"{K}, total_turns, {ROUND(['mean_ddm', 'std_ddm', 'auc'])}, drift_onset, sustained_dop, total_collapse, half_life, recovery_events, round(recovery_rate, 6) AS recovery_rate"
LEVEL_COLUMNS = ", ".join(f"round({n}_mean, 6) AS {n}_mean, round({n}_auc, 6) AS {n}_auc, {n}_onset" for n in LEVELS)
FAILED = " + ".join(f"CASE WHEN {n}_onset IS NULL THEN 0 ELSE 1 END" for n in LEVELS)
ONSETS = ", ".join(f"{n}_onset" for n in LEVELS)
PDRI_SQL = f"""round(100 * (0.40::DOUBLE * auc + 0.30::DOUBLE * coalesce(drift_onset::DOUBLE / total_turns, 1) + 0.15::DOUBLE * CASE WHEN {FAILED} >= 2 THEN least(1.0::DOUBLE, 5.0::DOUBLE * (greatest({ONSETS}) - least({ONSETS})) / total_turns) ELSE 1 END
  + 0.15::DOUBLE * recovery_rate), 6) AS pdri"""
STEPS = f"""{BASE}, steps AS (SELECT *, ddm - lag(ddm) OVER (PARTITION BY {K} ORDER BY turn) AS d, count(*) OVER (PARTITION BY {K}) AS n FROM scores),
rolling AS (SELECT *, CASE WHEN n <= 5 THEN d WHEN count(d) OVER w = 5 THEN avg(d) OVER w END AS r FROM steps WINDOW w AS (PARTITION BY {K} ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _summary(*columns):
    def query(spark, folder):
        out = rounded(curves.curve_summary(scores(spark, folder), KEY))
        return out.select(*KEY, *columns) if columns else out

    return query


def per_level_decay(spark, folder):
    return rounded(curves.level_decay(scores(spark, folder), KEY))


def drift_summary(spark, folder):
    return rounded(curves.drift_summary(scores(spark, folder), KEY))


def resilience_index(spark, folder):
    return drift_summary(spark, folder).select(*KEY, "pdri")


def conversation_drift_summary(spark, folder):
    from tideline.plans.frames import messages

    return rounded(curves.curve_summary(scoring.score_turns(messages(spark, folder)), ("conv_id",)))


def onset_tokens(spark, folder):
    return rounded(curves.onset_tokens(scores(spark, folder), KEY))


def velocity_summary(spark, folder):
    return rounded(curves.velocity(scores(spark, folder), KEY))


def rolling_velocity_min(spark, folder):
    return velocity_summary(spark, folder).select(*KEY, "min_rolling")


def shock_impact(spark, folder):
    return rounded(curves.shock(scores(spark, folder), KEY, 10).drop("n"))


SHOCK_SQL = f"""{BASE}, pre AS (SELECT *, coalesce(avg(ddm) FILTER (turn > 5 AND turn <= 10) OVER (PARTITION BY {K}), 1) AS pre FROM scores),
s AS (SELECT {K}, count(*) AS n, max(pre) AS p, max(ddm) FILTER (turn = 11) AS at_, avg(ddm) FILTER (turn > 11 AND turn <= 16) AS post, min(turn) FILTER (turn > 11 AND ddm >= 0.9::DOUBLE * pre) AS back, count(*) FILTER (turn > 11) AS rest FROM pre GROUP BY {K})
SELECT {K}, round(p, 6) AS pre_shock_ddm, round(at_, 6) AS shock_turn_ddm, round(post, 6) AS post_shock_ddm, coalesce(back - 11, rest) AS recovery_turns, back IS NULL AS permanent_damage, round(p - at_, 6) AS ddm_drop FROM s WHERE n > 15"""


def reinjection_boost(spark, folder):
    return rounded(curves.reinjection(scores(spark, folder), KEY, (5, 15, 30)))


def pre_post_onset_means(spark, folder):
    return rounded(curves.around_onset(scores(spark, folder), KEY, "value"))


PREPOST_SQL = f"""{BASE}, d AS (SELECT *, min(turn) FILTER (ddm < 1) OVER (PARTITION BY {K}) AS dop FROM scores),
a AS (SELECT {K}, count(value) FILTER (turn < dop) AS n1, avg(value) FILTER (turn < dop) AS m1, var_samp(value) FILTER (turn < dop) AS v1, count(value) FILTER (turn >= dop) AS n2, avg(value) FILTER (turn >= dop) AS m2,
  var_samp(value) FILTER (turn >= dop) AS v2, corr(value, ddm) AS r, count(*) AS n FROM d WHERE dop > 1 GROUP BY {K}),
p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0) AS pooled FROM a)
SELECT {K}, round(m1, 6) AS pre_drift, round(m2, 6) AS post_drift, round(CASE WHEN n1 > 1 AND n2 > 1 AND pooled > 0 THEN (m1 - m2) / sqrt(pooled * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) END, 6) AS t_stat, n1 + n2 - 2 AS df,
  round(CASE WHEN n >= 3 AND NOT isnan(r) THEN r END, 6) AS pearson_r, m2 <= m1 AS confident FROM p"""


def context_budget(spark, folder):
    windows = spark.createDataFrame([("alpha", 4096), ("beta", 16384)], "model string, context_window long")
    return rounded(curves.context_budget(scores(spark, folder), KEY, windows))


BUDGET_SQL = f"""{BASE}, u AS (SELECT s.*, context_tokens / coalesce(w.cw, 8192)::DOUBLE AS used FROM scores s LEFT JOIN (VALUES ('alpha', 4096), ('beta', 16384)) w(m, cw) ON s.model = w.m)
SELECT {K}, round(arg_min(used, turn) FILTER (ddm < 1), 6) AS util_at_dop, round(arg_min(used, turn) FILTER (ddm <= 0.5), 6) AS util_at_half_life, round(max(used), 6) AS max_util, round(arg_max(used, turn), 6) AS final_util FROM u GROUP BY {K}"""


def prompt_share(spark, folder):
    return rounded(curves.prompt_share(scores(spark, folder), KEY))


SHARE_SQL = f"""{BASE}, u AS (SELECT *, 200 / greatest(context_tokens, 1)::DOUBLE AS share FROM scores)
SELECT {K}, round(arg_min(share, turn), 6) AS initial_ratio, round(arg_max(share, turn), 6) AS final_ratio, round(avg(share), 6) AS mean_ratio, round(arg_min(share, turn) FILTER (ddm < 1), 6) AS ratio_at_dop,
  round(CASE WHEN count(*) >= 3 AND NOT isnan(corr(share, ddm)) THEN corr(share, ddm) END, 6) AS corr FROM u GROUP BY {K}"""


def failure_order(spark, folder):
    out = curves.failure_order(curves.level_decay(scores(spark, folder), KEY), KEY)
    return out.select(*KEY, "failure_order", "first_failure", F.col("n_failed").cast("long").alias("n_failed"))


ORDER_SQL = f"""{RUNS}, o AS (SELECT {K}, unnest([{", ".join(f"{{'at': {n}_onset, 'pos': {i}, 'level': '{n}'}}" for i, n in enumerate(LEVELS))}]) AS x FROM decay)
SELECT {K}, coalesce(string_agg(x.level, ' -> ' ORDER BY x.at, x.pos) FILTER (x.at IS NOT NULL), '') AS failure_order, arg_min(x.level, x.at * 10 + x.pos) FILTER (x.at IS NOT NULL) AS first_failure, count(*) FILTER (x.at IS NOT NULL) AS n_failed
FROM o GROUP BY {K}"""


def probe_offsets(spark, folder):
    rows = scores(spark, folder)
    recalls = rows.select(*KEY, "turn", (F.col("event_id") % 11 / 10.0).alias("total_recall"))
    return rounded(curves.probes(rows, KEY, recalls))


PROBE_SQL = f"""{BASE}, d AS (SELECT *, min(turn) FILTER (ddm < 1) OVER (PARTITION BY {K}) AS dop, event_id % 11 / 10.0::DOUBLE AS recall FROM scores)
SELECT {K}, turn AS probe_turn, dop, turn - dop AS offset_from_dop, round(ddm, 6) AS ddm_at_probe, round(recall, 6) AS total_recall,
  CASE WHEN recall >= 0.6 AND ddm < 0.8 THEN 'laziness' WHEN recall < 0.4 THEN 'eviction' ELSE 'partial' END AS classification FROM d WHERE dop IS NOT NULL AND turn - dop IN (0, 5, 10, 20)"""


def free_vs_gold(spark, folder):
    rows = curves.curve_summary(scores(spark, folder), KEY).select(*KEY, "total_turns", "mean_ddm")
    gold = rows.withColumn("mean_ddm", F.least(F.lit(1.0), F.col("mean_ddm") + 0.1)).where("conv_id % 7 <> 0")
    return rounded(scenarios.decomposition(rows, gold, list(KEY)))


FREE_SQL = f"""{RUNS}, g AS (SELECT {K}, mean_ddm AS free, least(1.0::DOUBLE, mean_ddm + 0.1::DOUBLE) AS gold FROM summary WHERE conv_id % 7 <> 0)
SELECT {K}, round(free, 6) AS free, round(gold, 6) AS gold, round(free - gold, 6) AS cascade, round(1 - gold, 6) AS forgetting, round(CASE WHEN free >= 1 THEN 0 ELSE abs(free - gold) / greatest(1 - free, 1e-6) * 100 END, 4) AS cascade_pct FROM g"""


def free_vs_gold_rounded(spark, folder):
    return free_vs_gold(spark, folder).withColumn("cascade_pct", F.round("cascade_pct", 4))


def scaffolding_sweep(spark, folder):
    rows = curves.curve_summary(scores(spark, folder), KEY).select(*KEY, "total_turns", "mean_ddm")
    gold = rows.select(*KEY, F.least(F.lit(1.0), F.col("mean_ddm") + 0.2).alias("mean_ddm"))
    own = rows.select(*KEY, F.explode(F.array(F.lit(5.0), F.lit(20.0), F.lit(0.5))).alias("sweep_value"), (F.col("mean_ddm") + 0.05).alias("mean_ddm"))
    until = scenarios.scaffolding(rows, gold, own, list(KEY), scenarios.GOLD_UNTIL, "gold_until")
    return rounded(until.union(scenarios.scaffolding(rows, gold, own, list(KEY), scenarios.GOLD_RATIO, "gold_ratio")))


SWEEP_SQL = f"""{RUNS}, f AS (SELECT {K}, total_turns, mean_ddm AS free FROM summary),
v AS (SELECT 'gold_until' AS sweep_type, unnest([{", ".join(f"{float(x)}" for x in scenarios.GOLD_UNTIL)}])::DOUBLE AS sweep_value UNION ALL SELECT 'gold_ratio', unnest([{", ".join(f"{float(x)}" for x in scenarios.GOLD_RATIO)}])::DOUBLE)
SELECT {K}, sweep_type, sweep_value, round(CASE WHEN sweep_value <= 0 THEN free WHEN sweep_value >= CASE WHEN sweep_type = 'gold_until' THEN total_turns ELSE 1 END THEN least(1.0::DOUBLE, free + 0.2::DOUBLE)
  WHEN sweep_value IN (5, 20, 0.5) THEN free + 0.05::DOUBLE END, 6) AS mean_ddm FROM f, v"""


def static_vs_dynamic(spark, folder):
    rows = curves.curve_summary(scores(spark, folder), KEY)
    side = lambda some: rows.where(some).groupBy("model", F.concat(F.lit("domain "), (F.col("conv_id") % 9).cast("string")).alias("domain")).agg(F.avg("mean_ddm").alias("mean_ddm"), F.avg("drift_onset").alias("dop"))
    out = scenarios.static_and_dynamic(side("conv_id % 2 = 0 and conv_id % 9 <> 4"), side("conv_id % 2 = 1 and conv_id % 9 <> 5"), ["model", "domain"], ["mean_ddm", "dop"])
    return rounded(out)


TRACKS_SQL = f"""{RUNS}, t AS (SELECT model, 'domain ' || (conv_id % 9) AS domain, conv_id, mean_ddm, drift_onset FROM summary),
s AS (SELECT model, domain, avg(mean_ddm) AS a, avg(drift_onset) AS b FROM t WHERE conv_id % 2 = 0 AND conv_id % 9 <> 4 GROUP BY ALL), d AS (SELECT model, domain, avg(mean_ddm) AS a, avg(drift_onset) AS b FROM t WHERE conv_id % 2 = 1 AND conv_id % 9 <> 5 GROUP BY ALL)
SELECT coalesce(s.model, d.model) AS model, coalesce(s.domain, d.domain) AS domain, round(s.a, 6) AS static_mean_ddm, round(s.b, 6) AS static_dop, round(d.a, 6) AS dynamic_mean_ddm, round(d.b, 6) AS dynamic_dop,
  round(d.a - s.a, 6) AS delta_mean_ddm, round(d.b - s.b, 6) AS delta_dop FROM s FULL JOIN d ON s.model = d.model AND s.domain = d.domain"""


def delta_summary(spark, folder):
    return rounded(scenarios.delta_summary(static_vs_dynamic(spark, folder), ["mean_ddm", "dop"]))


def plan_position_lookup(spark, folder):
    from tideline.plans.frames import table

    plan = F.expr("named_struct('emotional_arc', array('calm','tense','open'), 'topics', array('a','b','c','d'), 'plot_twists', array(named_struct('turn', 2L, 'twist', 'first'), named_struct('turn', 2L, 'twist', 'second')), 'context_callbacks', array(1L, 4L))")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", plan.alias("plan"))
    return rows.select("conv_id", "turn", *(c.alias(n) for n, c in scenarios.plan_at(F.col("turn"), F.col("plan")).items()))


PLAN_SQL = "SELECT conv_id, turn, CASE least(turn // 5, 2) WHEN 0 THEN 'calm' WHEN 1 THEN 'tense' ELSE 'open' END AS arc, CASE least(turn, 3) WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS topic, CASE WHEN turn = 2 THEN 'second' END AS twist, turn IN (1, 4) AS callback FROM conversations"

QUERIES = {
    "curve_auc": _summary("auc"), "curve_onsets": _summary("drift_onset", "total_collapse", "half_life"), "sustained_onset": _summary("sustained_dop"), "recovery_rate": _summary("recovery_events", "recovery_rate"),
    "curve_summary": _summary(), "per_level_decay": per_level_decay, "resilience_index": resilience_index, "drift_summary": drift_summary, "conversation_drift_summary": conversation_drift_summary, "onset_tokens": onset_tokens,
    "velocity_summary": velocity_summary, "rolling_velocity_min": rolling_velocity_min, "shock_impact": shock_impact, "reinjection_boost": reinjection_boost, "pre_post_onset_means": pre_post_onset_means,
    "context_budget": context_budget, "prompt_share": prompt_share, "failure_order": failure_order, "probe_offsets": probe_offsets, "free_vs_gold": free_vs_gold_rounded, "scaffolding_sweep": scaffolding_sweep,
    "static_vs_dynamic_full_outer": static_vs_dynamic, "delta_summary": delta_summary, "plan_position_lookup": plan_position_lookup,
}
VELOCITY_SQL = f"""{STEPS} SELECT {K}, round(CASE WHEN count(d) = 0 THEN 0 ELSE avg(d) END, 6) AS mean_velocity, round(CASE WHEN count(d) = 0 THEN 0 ELSE min(d) END, 6) AS max_decline, round(stddev_pop(d), 6) AS velocity_std,
  round(CASE WHEN count(d) > 0 THEN coalesce(arg_min(d, turn) FILTER (ddm < 1 AND turn > 1), 0) END, 6) AS velocity_at_onset, count(*) FILTER (d < 0) AS declining, count(*) FILTER (d > 0) AS improving, count(*) FILTER (d = 0) AS stable,
  round(min(r), 6) AS min_rolling FROM rolling GROUP BY {K}"""
ORACLES = {
    "curve_auc": f"{RUNS} SELECT {K}, round(auc, 6) AS auc FROM summary",
    "curve_onsets": f"{RUNS} SELECT {K}, drift_onset, total_collapse, half_life FROM summary",
    "sustained_onset": f"{RUNS} SELECT {K}, sustained_dop FROM summary",
    "recovery_rate": f"{RUNS} SELECT {K}, recovery_events, round(recovery_rate, 6) AS recovery_rate FROM summary",
    "curve_summary": f"{RUNS} SELECT {SUMMARY_COLUMNS} FROM summary",
    "per_level_decay": f"{RUNS} SELECT {K}, {LEVEL_COLUMNS} FROM decay",
    "resilience_index": f"{RUNS} SELECT {K}, {PDRI_SQL} FROM summary JOIN decay USING ({K})",
    "drift_summary": f"{RUNS} SELECT {SUMMARY_COLUMNS}, {LEVEL_COLUMNS}, {PDRI_SQL} FROM summary JOIN decay USING ({K})",
    "conversation_drift_summary": f"WITH scores AS ({TURNS_SQL}), {SUMMARY_CTE('conv_id')} SELECT {SUMMARY_COLUMNS.replace(K, 'conv_id')} FROM summary",
    "onset_tokens": f"{BASE} SELECT {K}, arg_min(context_tokens, turn) FILTER (ddm < 1) AS dop_tokens FROM scores GROUP BY {K}",
    "velocity_summary": unsigned_zero(VELOCITY_SQL, "mean_velocity", "max_decline", "velocity_at_onset", "min_rolling"),
    "rolling_velocity_min": unsigned_zero(f"{STEPS} SELECT {K}, round(min(r), 6) AS min_rolling FROM rolling GROUP BY {K}", "min_rolling"),
    "shock_impact": unsigned_zero(SHOCK_SQL, "ddm_drop"),
    "reinjection_boost": unsigned_zero(f"""{BASE}, s AS (SELECT *, lag(ddm) OVER w AS b, lead(ddm) OVER w AS a FROM scores WINDOW w AS (PARTITION BY {K} ORDER BY turn))
SELECT {K}, turn AS reinjection_turn, round(b, 6) AS ddm_before, round(a, 6) AS ddm_after, round(a - b, 6) AS recovery_boost FROM s WHERE turn IN (5, 15, 30) AND a IS NOT NULL""", "recovery_boost"),
    "pre_post_onset_means": PREPOST_SQL, "context_budget": BUDGET_SQL, "prompt_share": SHARE_SQL, "failure_order": ORDER_SQL, "probe_offsets": PROBE_SQL, "free_vs_gold": unsigned_zero(FREE_SQL, "cascade", "forgetting"), "scaffolding_sweep": SWEEP_SQL,
    "static_vs_dynamic_full_outer": unsigned_zero(TRACKS_SQL, "delta_mean_ddm", "delta_dop"),
    "delta_summary": f"WITH t AS ({TRACKS_SQL}) SELECT count(*) AS n, " + ", ".join(f"count(delta_{m}) AS {m}_n, round(avg(delta_{m}), 6) AS {m}_mean, round(stddev_pop(delta_{m}), 6) AS {m}_std" for m in ("mean_ddm", "dop")) + " FROM t",
    "plan_position_lookup": PLAN_SQL,
}
