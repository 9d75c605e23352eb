"""Plans, requests, accounts of calls, the audit's rounds, and a whole study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import external
from tideline.functions import text as T
from tideline.operators import generation, repair, study
from tideline.plans.cohort_queries import DRAWN_SQL
from tideline.plans.curve_queries import LEVELS, SUMMARY_CTE, K
from tideline.plans.frames import LANG, MESSAGES_SQL, MODEL, TIER, messages, rounded, table
from tideline.plans.rule_queries import FIX_SQL
from tideline.plans.score_queries import REPLIES, TURNS_SQL, V_SQL
from tideline.sources.shared import place, stored

# --- plans: a customer's conversation, as long and as eventful as its number says

PLAN = {
    "num_turns": "CAST(c_custkey % 60 AS INT)",
    "arc": "CASE c_custkey % 4 WHEN 0 THEN {0}'calm', 'confused', 'relieved'{1} WHEN 1 THEN {0}'cross'{1} WHEN 2 THEN {0}'eager', 'tired', 'cross', 'calm', 'glad'{1} ELSE NULL END",
    "topics": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {0}c_mktsegment, 'prices', 'returns', 'delivery ' || CAST(c_custkey % 9 AS VARCHAR(9)){1} END",
}


def _plans(spark, folder):
    fields = {k: F.expr(x.format("array(", ")")) for k, x in PLAN.items()}
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("conv_id"), *(x.alias(k) for k, x in fields.items()))
    twist = lambda n, of: F.struct((F.col("conv_id") % n).cast("int").alias("turn"), F.concat(F.lit(f"{of} "), F.col("conv_id").cast("string")).alias("twist"))
    return rows.withColumns({"twists": F.array(twist(11, "loss"), twist(23, "gain")), "callbacks": F.array((F.col("conv_id") % 13).cast("int"), (F.col("conv_id") % 29).cast("int"))})


def plan_turns(spark, folder):
    return rounded(generation.planned_turns(_plans(spark, folder)))


ROLL_SQL = lambda seed: f"{DRAWN_SQL.format(seed, 'conv_id || $$:$$ || turn')} / 1099511627776::DOUBLE"
PLANS_SQL = f"""plans AS (SELECT c_custkey AS conv_id, {", ".join(f"{x.format('[', ']')} AS {k}" for k, x in PLAN.items())} FROM customer),
turns AS (SELECT *, unnest(range(num_turns)) AS turn FROM plans),
told AS (
  SELECT conv_id, num_turns, turn, CASE WHEN num_turns <= 15 THEN 0 WHEN num_turns <= 50 THEN turn // 20 ELSE turn // 15 END AS batch,
    coalesce(arc[1 + least(turn // 5, len(arc) - 1)], 'neutral') AS emotion, coalesce(topics[1 + least(turn, len(topics) - 1)], 'general') AS topic,
    CASE turn WHEN conv_id % 23 THEN 'gain ' || conv_id WHEN conv_id % 11 THEN 'loss ' || conv_id END AS twist, turn IN (conv_id % 13, conv_id % 29) AS callback, {ROLL_SQL(42)} AS r, {ROLL_SQL(43)} AS q FROM turns),
drawn AS (
  SELECT *, CASE WHEN turn <= 2 THEN 'none' WHEN r < 0.15 THEN 'pushback' WHEN r < 0.25 THEN 'confusion' WHEN r < 0.35 THEN 'tangent' WHEN r < 0.42 THEN 'impatience' ELSE 'none' END AS mood,
    CASE WHEN q < 0.2 THEN 'short' WHEN q < 0.4 THEN 'long' ELSE 'normal' END AS length FROM told),
specs AS (
  SELECT *, '[MSG ' || (turn + 1) || '] ' || topic || ' | ' || emotion || ' | ' || length || coalesce(' | event: ' || twist, '') || CASE WHEN mood <> 'none' THEN ' | mood: ' || mood ELSE '' END || CASE WHEN callback THEN ' | callback' ELSE '' END AS spec FROM drawn)"""
PLANNED_SQL = f"WITH {PLANS_SQL} SELECT conv_id, num_turns, turn, batch, emotion, topic, twist, callback, mood, length, spec FROM specs"

#: What was said so far: the last turns of a plan have no message yet.
SAID = "CASE WHEN turn >= num_turns - 4 THEN NULL WHEN (conv_id + turn) % 5 = 0 THEN 'I finally sorted ' || topic || ' out' WHEN (conv_id + turn) % 9 = 0 THEN '  We got my ' || topic || ' ' || repeat('back and forth ', 7) ELSE 'So, ' || topic || '? ' || repeat('Tell me more. ', 9) END"


def plan_requests(spark, folder):
    turns = generation.planned_turns(_plans(spark, folder)).withColumn("message", F.expr(SAID))
    return rounded(generation.batch_requests(turns))


REQUESTS_SQL = rf"""WITH {PLANS_SQL}, said AS (SELECT *, {SAID} AS message FROM specs),
batches AS (SELECT conv_id, batch, min(turn) AS first_turn, count(*) AS n, string_agg(spec, chr(10) ORDER BY turn) AS specs FROM said GROUP BY conv_id, batch),
before AS (
  SELECT b.conv_id, b.batch, list('[MSG ' || (s.turn + 1) || '] ' || substr(message, 1, 100) ORDER BY s.turn) FILTER (message IS NOT NULL) AS told,
    list(trim(substr(message, 1, 60)) ORDER BY s.turn) FILTER (regexp_matches(lower(message), '{"|".join(T.RESOLVED)}')) AS solved
  FROM batches b LEFT JOIN said s ON s.conv_id = b.conv_id AND s.turn < b.first_turn GROUP BY ALL)
SELECT conv_id, batch, first_turn, n, specs, coalesce(array_to_string(told[-3:], chr(10)), '') AS recent, coalesce(array_to_string(solved[-10:], chr(10)), '') AS solved FROM batches JOIN before USING (conv_id, batch)"""


# --- accounts of calls: a client that costs a text's words, and fails at every seventh length

AGENTS, PHASES = ["simulator", "writer"], ["draft", "revision"]


def _client():
    def call(texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("no reply")
        return [external.Reply(t.upper(), len(t.split()), len(t)) for t in texts]

    return call


def agent_accounts(spark, folder):
    """What the observation counted while the replies were written."""
    role, half = F.when(F.col("role") == "user", AGENTS[0]).otherwise(AGENTS[1]), F.when(F.col("conv_id") % 2 == 0, PHASES[0]).otherwise(PHASES[1])
    rows = table(spark, folder, "conversations").select("text", role.alias("agent"), half.alias("phase"))
    counted, seen = external.observed(external.respond(rows, "text", _client, attempts=2, wait=0.0), AGENTS, PHASES)
    stored(counted, place(spark, "replies"))
    return spark.createDataFrame(external.accounts(seen, AGENTS, PHASES), "agent string, phase string, " + ", ".join(f"{c} long" for c in external.ACCOUNT))


ACCOUNTS_SQL = r"""WITH c AS (SELECT CASE role WHEN 'user' THEN 'simulator' ELSE 'writer' END AS agent, CASE conv_id % 2 WHEN 0 THEN 'draft' ELSE 'revision' END AS phase, length(text) % 7 = 0 AS bad, len(regexp_extract_all(text, '\S+')) AS w, length(text) AS n FROM conversations)
SELECT agent, phase, count(*) FILTER (NOT bad) AS calls, CAST(coalesce(sum(w) FILTER (NOT bad), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS completion_tokens, count(*) FILTER (bad) AS errors, 2 * count(*) FILTER (bad) AS retries
FROM c GROUP BY agent, phase"""


# --- the audit's rounds: a rewriter that mends one thing at a time, and some things never

MENDED = """CASE WHEN contains(text, 'However') THEN replace(text, 'However', 'Still') WHEN NOT contains(text, '[SYS_ACK: ACTIVE]') THEN text || chr(10) || '[SYS_ACK: ACTIVE]'
  WHEN NOT contains(text, '[Source:') THEN text || ' [Source: Almanac 9]' ELSE text END"""
ROUNDS = 3


def audit_rounds(spark, folder):
    rows = messages(spark, folder).drop("lang")
    out = repair.audited(rows, lambda left: left.withColumn("text", F.expr(MENDED)), ROUNDS)
    return rounded(out.select("conv_id", "msg_idx", F.md5("text").alias("text_md5"), "fixed", "fixed_round"))


MET_SQL = " AND ".join(f"({x}) = 1" for x in V_SQL.values())
FORCED_SQL, _ = FIX_SQL.removeprefix(REPLIES).replace("FROM replies)", "FROM failed)").rsplit("\n", 1)
ROUNDS_SQL = f"""WITH RECURSIVE {MESSAGES_SQL}, rounds AS (
  SELECT conv_id, msg_idx, ord, text, 0 AS k, {MET_SQL} AS met FROM messages WHERE role = 'assistant'
  UNION ALL SELECT conv_id, msg_idx, ord, text, k, {MET_SQL} FROM (SELECT conv_id, msg_idx, ord, {MENDED} AS text, k + 1 AS k FROM rounds WHERE NOT met AND k < {ROUNDS})),
last_ AS (SELECT * FROM rounds QUALIFY row_number() OVER (PARTITION BY conv_id, msg_idx ORDER BY k DESC) = 1), failed AS (SELECT * FROM last_ WHERE NOT met){FORCED_SQL}
SELECT conv_id, msg_idx, md5(coalesce(e.e, l.text, m.text)) AS text_md5, CASE WHEN e.e IS NOT NULL THEN 'forced' WHEN l.k > 0 THEN 'rewritten' END AS fixed, CASE WHEN e.e IS NOT NULL THEN {ROUNDS + 1} WHEN l.k > 0 THEN l.k END AS fixed_round
FROM messages m LEFT JOIN last_ l USING (conv_id, msg_idx) LEFT JOIN e ON e.conv_id = m.conv_id AND e.ord = l.ord"""

# --- a study of the marked conversations: five in a row are one in five languages, scored in three shards

MEASURES = {"turns": "sum(ddm)", "summary": "sum(auc)", "decay": "sum(l2_auc)", "curve": "sum(turn)", "groups": "sum(mean_ddm_mean)", "intervals": "sum(mean)", "fertility": "sum(tfr)", "regression": "max(slope)", "agreement": "max(w)", "tiers": "sum(d)", "order": "sum(n_failed)", "velocity": "sum(mean_velocity)"}


def full_run(spark, folder):
    """Rows and a measure of every phase's table."""
    of = F.floor(F.col("conv_id") / 5)
    rows = messages(spark, folder).select("lang", of.alias("conv_id"), "msg_idx", "role", "text").withColumns({"model": F.expr(MODEL.format("conv_id")), "tier": F.expr(TIER.format("conv_id"))})
    out = place(spark, "study")
    for shard in range(3):
        study.score_shard(rows, out, shard, 3)
    study.merge_shards(spark, out, 3)
    parts = [spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("phase"), F.count("*").alias("n"), F.expr(MEASURES[name]).cast("double").alias("measure")) for name, _ in study.run(rows, out)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return rounded(whole)


STUDY_SQL = f"""WITH scores AS (SELECT conv_id // 5 AS conv_id, {MODEL.format("(conv_id // 5)")} AS model, {TIER.format("(conv_id // 5)")} AS tier, {LANG.format("conv_id")} AS lang, turn, l1, l2, l3, l4, l5, ddm FROM ({TURNS_SQL})), {SUMMARY_CTE(K)},
decay AS (SELECT {K}, CASE WHEN count(*) = 1 THEN max(l2) ELSE (sum(l2) - (arg_min(l2, turn) + arg_max(l2, turn)) / 2) / nullif(count(*) - 1, 0) END AS l2_auc, {" + ".join(f"(count(*) FILTER ({n} < 1) > 0)::INT" for n in LEVELS)} AS n_failed FROM scores GROUP BY {K}),
words AS (WITH {MESSAGES_SQL} SELECT conv_id // 5 AS c, msg_idx, lang, len(regexp_extract_all(text, '\\S+')) AS n FROM messages),
fertility AS (SELECT a.lang, sum(a.n)::DOUBLE / sum(b.n) AS tfr FROM words a JOIN words b ON a.c = b.c AND a.msg_idx = b.msg_idx AND b.lang = 'en' WHERE a.lang <> 'en' GROUP BY a.lang),
means AS (SELECT model, lang, avg(mean_ddm) AS m FROM summary GROUP BY ALL),
ranked AS (SELECT model, lang, rank() OVER (PARTITION BY model ORDER BY m) + (count(*) OVER (PARTITION BY model, m) - 1) / 2.0::DOUBLE AS r FROM means WHERE lang IN (SELECT lang FROM means GROUP BY lang HAVING count(*) = (SELECT count(DISTINCT model) FROM means))),
judged AS (SELECT count(*) AS n, var_pop(r) * count(*) AS s, (SELECT count(DISTINCT model) FROM means) AS m FROM (SELECT lang, sum(r) AS r FROM ranked GROUP BY lang)),
tier AS (SELECT avg(mean_ddm) AS m, var_samp(mean_ddm) AS v, CASE tier WHEN 'short' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS at_ FROM summary GROUP BY tier HAVING count(*) > 1)
SELECT phase, n, round(measure, 6) + 0.0::DOUBLE AS measure FROM (
  SELECT 'turns' AS phase, count(*) AS n, sum(ddm)::DOUBLE AS measure FROM scores UNION ALL SELECT 'summary', count(*), sum(auc) FROM summary UNION ALL SELECT 'decay', count(*), sum(l2_auc) FROM decay
  UNION ALL SELECT 'curve', count(*), sum(turn) FROM (SELECT DISTINCT model, lang, turn FROM scores) UNION ALL SELECT 'groups', count(*), sum(m) FROM means UNION ALL SELECT 'intervals', count(*), sum(m) FROM means
  UNION ALL SELECT 'fertility', count(*), sum(tfr) FROM fertility UNION ALL SELECT 'regression', 1, regr_slope(drift_onset, tfr) FROM summary JOIN fertility USING (lang)
  UNION ALL SELECT 'agreement', 1, CASE WHEN n >= 3 THEN 12 * s / (m * m * (power(n, 3) - n)) ELSE 0 END FROM judged UNION ALL SELECT 'tiers', count(*), sum((x.m - y.m) / sqrt((x.v + y.v) / 2)) FROM tier x JOIN tier y ON y.at_ = x.at_ + 1
  UNION ALL SELECT 'order', count(*), sum(n_failed) FROM decay UNION ALL SELECT 'velocity', count(*), sum(v) FROM (SELECT coalesce((arg_max(ddm, turn) - arg_min(ddm, turn)) / nullif(count(*) - 1, 0), 0) AS v FROM scores GROUP BY {K}))"""

QUERIES = {f.__name__: f for f in (plan_turns, plan_requests, agent_accounts, audit_rounds, full_run)}
ORACLES = {"plan_turns": PLANNED_SQL, "plan_requests": REQUESTS_SQL, "agent_accounts": ACCOUNTS_SQL, "audit_rounds": ROUNDS_SQL, "full_run": STUDY_SQL}
