"""Groups of curves, orders, samples, unions, fertility, attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import tokens
from tideline.operators import cohorts, curves, expansion
from tideline.operators.scoring import LEVELS
from tideline.plans.curve_queries import ORDER_SQL, RUNS, K
from tideline.plans.frames import KEY, MESSAGES_SQL, SCORES_SQL, messages, rounded, scores, table


def _summary(spark, folder):
    return curves.curve_summary(scores(spark, folder), KEY)


def model_lang_aggregate(spark, folder):
    return rounded(cohorts.spread(_summary(spark, folder), ["model", "lang"], ["mean_ddm", "auc", "drift_onset"]))


def _spread_sql(keys, metrics):
    parts = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, round(quantile_cont({m}, 0.5), 6) AS {m}_median" for m in metrics)
    return f"{RUNS} SELECT {keys}, count(*) AS n, {parts} FROM summary GROUP BY {keys}"


def lang_summary(spark, folder):
    return rounded(cohorts.lang_summary(_summary(spark, folder), ["mean_ddm", "recovery_rate"]))


def tier_grouping_sets(spark, folder):
    return rounded(cohorts.tier_levels(_summary(spark, folder)))


def model_lang_pivot(spark, folder):
    return rounded(cohorts.pivot_means(_summary(spark, folder), "model", "lang", ["en", "it", "es", "fr", "de"]))


def lang_ranking(spark, folder):
    return rounded(cohorts.mean_of_means(_summary(spark, folder), "lang", "model"))


def _orders(spark, folder):
    return curves.failure_order(curves.level_decay(scores(spark, folder), KEY), KEY)


def first_failure_pivot(spark, folder):
    return rounded(cohorts.first_failures(_orders(spark, folder)))


def mean_onset_by_level(spark, folder):
    decay = curves.level_decay(scores(spark, folder), KEY)
    return rounded(decay.groupBy("lang").agg(*(F.avg(f"{n}_onset").alias(f"{n}_onset") for n in LEVELS)))


def mode_top1(spark, folder):
    return rounded(cohorts.most_common(_orders(spark, folder).where("first_failure is not null"), ["lang"], "first_failure"))


def decay_curve_by_turn(spark, folder):
    return rounded(cohorts.curve_by_turn(scores(spark, folder), ["model", "lang"]))


def predicate_rates(spark, folder):
    rows = curves.shock(scores(spark, folder), KEY, 10)
    return rounded(cohorts.chances(rows, ["lang"], permanent=F.col("permanent_damage"), sharp=F.col("ddm_drop") > 0.3))


def base_model_and_tier(spark, folder):
    rows = _summary(spark, folder).withColumn("name", F.concat_ws("-", "model", "tier"))
    return rows.select("conv_id", "name", cohorts.base_model(F.col("name")).alias("base"), cohorts.tier_of(F.col("name")).alias("tier_found"))


def first_n_per_group(spark, folder):
    return cohorts.first_n(table(spark, folder, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 2)


def seeded_sample(spark, folder):
    return cohorts.seeded_sample(table(spark, folder, "documents").select("source", "doc_id"), ["source"], "doc_id", 10)


def first_per_difficulty(spark, folder):
    rows = table(spark, folder, "part").select("p_brand", "p_size", "p_partkey")
    return rows.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"))


def shard_union_dedupe(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.lit("first").alias("shard"))
    return cohorts.last_written([rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 2 = 0").withColumn("shard", F.lit("second"))], ["doc_id"])


def latest_annotation(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    return cohorts.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def round_robin(spark, folder):
    return table(spark, folder, "documents").groupBy(F.pmod("doc_id", F.lit(10)).alias("slot")).agg(F.count("*").alias("n"))


def friction_rolls(spark, folder):
    rows = table(spark, folder, "conversations").where("role = 'user'")
    return rows.groupBy(cohorts.friction(F.col("turn"), cohorts.uniform(42, "conv_id", "turn")).alias("mood")).agg(F.count("*").alias("n"))


def style_rotation(spark, folder):
    rows = table(spark, folder, "events").select("user_id", (F.col("event_id") % 100).alias("position"))
    return rows.select("position", cohorts.rotation(F.col("position"), 7).cast("long").alias("style")).distinct()


DRAWN_SQL = "CAST('0x' || substr(md5('{}:' || {}), 1, 10) AS BIGINT)"
ROTATION_SQL = f"""WITH b AS (SELECT DISTINCT event_id % 100 // 10 AS block FROM events), s AS (SELECT block, unnest(range(0, 10)) AS style FROM b),
h AS (SELECT *, {DRAWN_SQL.format(7, "block || ':' || style")} AS h, {DRAWN_SQL.format(8, "block || ':' || style")} AS g FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY block, style % 2 ORDER BY h, style) AS at_ FROM h),
p AS (SELECT block, style, row_number() OVER (PARTITION BY block ORDER BY CASE WHEN style % 2 = 0 AND at_ <= 2 THEN 0 WHEN style % 2 = 1 AND at_ > 3 THEN 2 ELSE 1 END, CASE WHEN style % 2 = 0 AND at_ <= 2 OR style % 2 = 1 AND at_ > 3 THEN h ELSE g END, style) - 1 AS at_ FROM r)
SELECT DISTINCT event_id % 100 AS position, style FROM events JOIN p ON block = event_id % 100 // 10 AND at_ = event_id % 10"""


# --- fertility


def _pairs(spark, folder):
    """Messages of a conversation beside those of the next: a stand-in for parallel texts."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    english = rows.select((F.col("conv_id") + 1).alias("conv_id"), "turn", F.col("text").alias("en_text"))
    both = rows.join(english, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.expr("CASE conv_id % 4 WHEN 0 THEN 'it' WHEN 1 THEN 'es' WHEN 2 THEN 'fr' ELSE 'de' END").alias("lang"), "text", "en_text")


def _counted(spark, folder):
    rows = _pairs(spark, folder)
    out = None
    for name in ("whitespace", "utf8_bytes"):
        part = rows.select("conv_id", "turn", "lang", F.lit(name).alias("model"), tokens.count_tokens(F.col("text"), name).alias("tokens"), tokens.count_tokens(F.col("en_text"), name).alias("en_tokens"))
        out = part if out is None else out.union(part)
    return out


def fertility_ratio(spark, folder):
    return rounded(cohorts.fertility(_counted(spark, folder), ["model", "lang"]))


COUNTED_SQL = r"""WITH p AS (SELECT a.conv_id, a.turn, CASE a.conv_id % 4 WHEN 0 THEN 'it' WHEN 1 THEN 'es' WHEN 2 THEN 'fr' ELSE 'de' END AS lang, a.text, b.text AS en FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id + 1 AND a.turn = b.turn),
t AS (SELECT lang, 'whitespace' AS model, len(regexp_extract_all(text, '\S+')) AS tokens, len(regexp_extract_all(en, '\S+')) AS en_tokens FROM p UNION ALL SELECT lang, 'utf8_bytes', strlen(text), strlen(en) FROM p)"""
FERTILITY_SQL = f"""{COUNTED_SQL} SELECT model, lang, round(sum(tokens)::DOUBLE / sum(en_tokens), 6) AS tfr, round(avg(tokens / nullif(en_tokens, 0)::DOUBLE), 6) AS mean_tfr, round(stddev_pop(tokens / nullif(en_tokens, 0)::DOUBLE), 6) AS std_tfr,
  round(quantile_cont(tokens / nullif(en_tokens, 0)::DOUBLE, 0.5), 6) AS median_tfr, round(max(tokens / nullif(en_tokens, 0)::DOUBLE), 6) AS max_tfr, round(min(tokens / nullif(en_tokens, 0)::DOUBLE), 6) AS min_tfr, CAST(sum(tokens) AS BIGINT) AS total_tokens,
  CAST(sum(en_tokens) AS BIGINT) AS en_total_tokens, CAST(sum(tokens) - sum(en_tokens) AS BIGINT) AS token_overhead, round(100.0::DOUBLE * (sum(tokens) - sum(en_tokens))::DOUBLE / sum(en_tokens), 6) AS overhead_pct FROM t GROUP BY model, lang"""


def fertility_overhead(spark, folder):
    return fertility_ratio(spark, folder).select("model", "lang", "token_overhead", "overhead_pct")


def fertility_drift_join(spark, folder):
    found = cohorts.fertility(_counted(spark, folder), ["model", "lang"])
    names = found.withColumn("model", F.expr("CASE model WHEN 'whitespace' THEN 'alpha' ELSE 'beta' END"))
    rows = _summary(spark, folder).withColumn("model", F.concat_ws("-", "model", "tier"))
    return rounded(cohorts.fertility_and_drift(names, rows).select("conv_id", "model", "base", "lang", "tfr", "auc"))


def parallel_pair_join(spark, folder):
    rows = messages(spark, folder).withColumn("pair", F.floor(F.col("conv_id") / 5))
    out = cohorts.parallel_pairs(rows, ("pair", "msg_idx"))
    return rounded(out.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.length("en_text")).alias("en_chars")))


def cri_expand(spark, folder):
    rows = _pairs(spark, folder).select("conv_id", "turn", F.col("en_text").alias("text"))
    rows = rows.withColumn("target", F.ceil(tokens.count_tokens(F.col("text"), "whitespace") * 1.3))
    out = expansion.expander("cri")(rows)
    return rounded(out.select("conv_id", "turn", "target", F.col("expanded_words").alias("tokens"), F.col("success").alias("reached"), F.md5("expanded").alias("expanded_md5")))


#: Sentences end at white space behind a mark; a mark is kept, so the white space becomes a character that no text has. Then filler after filler.
FILLERS_SQL = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in expansion.FILLERS) + "]"
EXPAND_SQL = rf"""WITH RECURSIVE p AS (SELECT a.conv_id, a.turn, b.text AS en FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id + 1 AND a.turn = b.turn),
f(conv_id, turn, target, start, i, n, parts) AS (
  SELECT conv_id, turn, CAST(ceil(len(regexp_extract_all(en, '\S+')) * 1.3) AS BIGINT), {DRAWN_SQL.format(42, "en")}, 0, len(regexp_extract_all(en, '\S+')), string_split(regexp_replace(en, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) FROM p
  UNION ALL
  SELECT conv_id, turn, target, start, i + 1, n + len(regexp_extract_all(filler, '\S+')) + CASE WHEN len(parts) < 2 THEN len(regexp_extract_all(parts[1], '\S+')) ELSE 0 END,
    CASE WHEN len(parts) < 2 THEN list_append(parts, filler || lower(parts[1])) ELSE list_transform(parts, lambda x, k: CASE WHEN k = 2 + h % (len(parts) - 1) THEN filler || x ELSE x END) END
  FROM (SELECT *, {FILLERS_SQL}[1 + i % {len(expansion.FILLERS)}] AS filler, (start + i) & 4294967295 AS h0, (xor(h0, h0 >> 16) * 73244475) & 4294967295 AS h1, (xor(h1, h1 >> 16) * 73244475) & 4294967295 AS h2, xor(h2, h2 >> 16) AS h FROM f)
  WHERE n < target AND i < 51)
SELECT f.conv_id, f.turn, target, n AS tokens, n >= target AS reached, md5(CASE WHEN i = 0 THEN en ELSE array_to_string(parts, ' ') END) AS expanded_md5
FROM f JOIN p USING (conv_id, turn) QUALIFY row_number() OVER (PARTITION BY f.conv_id, f.turn ORDER BY i DESC) = 1"""


# --- attention


def attention_share(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("w"))
    return rounded(rows.select("vec_id", cohorts.attention_share(F.col("w"), F.lit(8)).alias("share")))


def curve_transpose(spark, folder):
    rows = table(spark, folder, "embeddings").select((F.col("vec_id") % 20).alias("conv_id"), F.col("vec_id").alias("turn"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("layer_shares"))
    out = cohorts.layer_curves(rows, ["conv_id"])
    return rounded(out.select("conv_id", "layer", F.size("shares").alias("n"), F.element_at("shares", 1).alias("first"), F.element_at("shares", -1).alias("last")))


def attention_profile(spark, folder):
    heads = F.array(F.slice("w", 1, 16), F.slice("w", 17, 16))
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("w"))
    rows = rows.select("vec_id", F.lit(1).alias("turn"), F.lit(4).alias("sys_len"), F.array(heads, heads).alias("last_token_attention"))
    return rounded(cohorts.attention_profile(rows, ["vec_id"]).select("vec_id", "share"))


def lookup_with_default(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    names = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return rows.join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("NONE")).alias("segment"))


def model_pairs(spark, folder):
    means = _summary(spark, folder).groupBy("model", "lang").agg(F.avg("mean_ddm").alias("m"))
    from tideline.operators.statistics import pairs_of

    return rounded(pairs_of(means, "model", "lang", "m").select("a", "b", "lang", (F.col("x") - F.col("y")).alias("gap")))


QUERIES = {f.__name__: f for f in (
    model_lang_aggregate, lang_summary, tier_grouping_sets, model_lang_pivot, lang_ranking, first_failure_pivot, mean_onset_by_level, mode_top1, decay_curve_by_turn, predicate_rates, base_model_and_tier, first_n_per_group,
    seeded_sample, first_per_difficulty, shard_union_dedupe, latest_annotation, round_robin, friction_rolls, style_rotation, fertility_ratio, fertility_overhead, fertility_drift_join, parallel_pair_join, cri_expand,
    attention_share, curve_transpose, attention_profile, lookup_with_default)} | {"model_pairs_cross": model_pairs}
SHOCKS = f"""WITH {SCORES_SQL}, pre AS (SELECT *, coalesce(avg(ddm) FILTER (turn > 5 AND turn <= 10) OVER (PARTITION BY {K}), 1) AS pre FROM scores),
s AS (SELECT {K}, count(*) AS n, max(pre) AS p, max(ddm) FILTER (turn = 11) AS at_, min(turn) FILTER (turn > 11 AND ddm >= 0.9::DOUBLE * pre) AS back FROM pre GROUP BY {K})"""
ORACLES = {
    "model_lang_aggregate": _spread_sql("model, lang", ["mean_ddm", "auc", "drift_onset"]),
    "lang_summary": f"{RUNS} SELECT lang, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in ("mean_ddm", "recovery_rate")) + " FROM summary GROUP BY lang",
    "tier_grouping_sets": f"{RUNS} SELECT tier, lang, count(*) AS n, round(avg(mean_ddm), 6) AS mean, round(stddev_samp(mean_ddm), 6) AS std, round(avg(CASE WHEN drift_onset IS NULL THEN 0 ELSE 1 END), 6) AS drift_share, grouping(lang) = 1 AS all_langs FROM summary GROUP BY GROUPING SETS ((tier, lang), (tier))",
    "model_lang_pivot": f"{RUNS} SELECT model, " + ", ".join(f"round(avg(mean_ddm) FILTER (lang = '{x}'), 6) AS {x}" for x in ("en", "it", "es", "fr", "de")) + " FROM summary GROUP BY model",
    "lang_ranking": f"{RUNS}, m AS (SELECT lang, model, avg(mean_ddm) AS m FROM summary GROUP BY ALL), s AS (SELECT lang, avg(m) AS score FROM m GROUP BY lang) SELECT lang, round(score, 6) AS score, rank() OVER (ORDER BY score DESC) AS place FROM s",
    "first_failure_pivot": f"WITH o AS ({ORDER_SQL}), c AS (SELECT lang, " + ", ".join(f"count(*) FILTER (first_failure = '{n}') AS {n}" for n in LEVELS) + ", count(*) AS total FROM o WHERE first_failure IS NOT NULL GROUP BY lang) SELECT *, " + ", ".join(f"round(100.0::DOUBLE * {n} / total, 6) AS {n}_pct" for n in LEVELS) + " FROM c",
    "mean_onset_by_level": f"{RUNS} SELECT lang, " + ", ".join(f"round(avg({n}_onset), 6) AS {n}_onset" for n in LEVELS) + " FROM decay GROUP BY lang",
    "mode_top1": f"WITH o AS ({ORDER_SQL}), c AS (SELECT lang, first_failure, count(*) AS n FROM o WHERE first_failure IS NOT NULL GROUP BY ALL) SELECT lang, min(first_failure) AS first_failure, max(n) AS n FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.lang = c.lang) GROUP BY lang",
    "decay_curve_by_turn": f"WITH {SCORES_SQL} SELECT model, lang, turn, round(avg(ddm), 6) AS mean, round(stddev_samp(ddm), 6) AS std, count(*) AS n FROM scores GROUP BY model, lang, turn",
    "predicate_rates": f"{SHOCKS} SELECT lang, round(avg(CASE WHEN back IS NULL THEN 1 ELSE 0 END) * 100, 6) AS permanent, round(avg(CASE WHEN p - at_ > 0.3 THEN 1 ELSE 0 END) * 100, 6) AS sharp FROM s WHERE n > 15 GROUP BY lang",
    "base_model_and_tier": f"{RUNS} SELECT conv_id, model || '-' || tier AS name, model AS base, tier AS tier_found FROM summary",
    "first_n_per_group": "SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2",
    "seeded_sample": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 10",
    "first_per_difficulty": "SELECT p_brand, arg_min(p_partkey, p_size::BIGINT * 1000000000 + p_partkey) AS p_partkey FROM part GROUP BY p_brand",
    "shard_union_dedupe": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS shard FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
    "latest_annotation": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "round_robin": "SELECT doc_id % 10 AS slot, count(*) AS n FROM documents GROUP BY slot",
    "friction_rolls": f"WITH r AS (SELECT turn, {DRAWN_SQL.format(42, "conv_id || ':' || turn")} / 1099511627776::DOUBLE AS u FROM conversations WHERE role = 'user') SELECT CASE WHEN turn <= 2 THEN 'none' WHEN u < 0.15::DOUBLE THEN 'pushback' WHEN u < 0.25::DOUBLE THEN 'confusion' WHEN u < 0.35::DOUBLE THEN 'tangent' WHEN u < 0.42::DOUBLE THEN 'impatience' ELSE 'none' END AS mood, count(*) AS n FROM r GROUP BY mood",
    "style_rotation": ROTATION_SQL,
    "cri_expand": EXPAND_SQL,
    "fertility_ratio": FERTILITY_SQL,
    "fertility_overhead": f"SELECT model, lang, token_overhead, overhead_pct FROM ({FERTILITY_SQL})",
    "fertility_drift_join": f"{RUNS}, f AS ({FERTILITY_SQL}), g AS (SELECT CASE model WHEN 'whitespace' THEN 'alpha' ELSE 'beta' END AS base, lang, tfr FROM f) SELECT conv_id, model || '-' || tier AS model, base, summary.lang, tfr, round(auc, 6) AS auc FROM summary JOIN g ON g.base = summary.model AND g.lang = summary.lang",
    "parallel_pair_join": f"WITH {MESSAGES_SQL} SELECT a.lang, count(*) AS n, CAST(sum(length(a.text)) AS BIGINT) AS chars, CAST(sum(length(b.text)) AS BIGINT) AS en_chars FROM messages a JOIN messages b ON a.conv_id // 5 = b.conv_id // 5 AND a.msg_idx = b.msg_idx AND a.lang <> 'en' AND b.lang = 'en' GROUP BY a.lang",
    "attention_share": "SELECT vec_id, round(list_sum(list_transform(list_slice(embedding, 1, 8), lambda x: abs(x)::DOUBLE)) / (list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)) + 1e-10), 6) AS share FROM embeddings",
    "curve_transpose": "WITH e AS (SELECT vec_id % 20 AS conv_id, vec_id, unnest(range(0, 3)) AS layer, embedding FROM embeddings) SELECT conv_id, layer, count(*) AS n, round(arg_min(embedding[layer + 1]::DOUBLE, vec_id), 6) AS first, round(arg_max(embedding[layer + 1]::DOUBLE, vec_id), 6) AS last FROM e GROUP BY conv_id, layer",
    "attention_profile": "WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS w FROM embeddings) SELECT vec_id, round((list_sum(w[1:4]) / (list_sum(w[1:16]) + 1e-10) + list_sum(w[17:20]) / (list_sum(w[17:32]) + 1e-10)) / 2, 6) AS share FROM w",
    "lookup_with_default": "SELECT o_orderkey, coalesce(c_mktsegment, 'NONE') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey",
    "model_pairs_cross": f"{RUNS}, m AS (SELECT model, lang, avg(mean_ddm) AS m FROM summary GROUP BY ALL) SELECT x.model AS a, y.model AS b, x.lang, round(x.m - y.m, 6) AS gap FROM m x JOIN m y ON x.lang = y.lang AND x.model < y.model",
}
