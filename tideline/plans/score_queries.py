"""Scores of replies, thoughts, recall, and conversation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import scoring, validate
from tideline.plans.frames import MESSAGES_SQL, messages, rounded, table

REPLIES = f"WITH {MESSAGES_SQL}, replies AS (SELECT * FROM messages WHERE role = 'assistant')"
TAG_SQL = r"CASE WHEN regexp_matches(text, '(?i)\[?SYS_ACK: ACTIVE\]?\s*($|\n)') THEN 1.0 ELSE 0.0 END"
BULLET_SQL = r"least(len(regexp_extract_all(text, '(?m)^\s*\d+[.)\]]\s+')), 2) / 2.0"
WORDS_SQL = {lang: "|".join(words) for lang, words in T.FORBIDDEN.items()}
LEXICAL_SQL = "CASE lang " + " ".join(rf"WHEN '{lang}' THEN CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)') THEN 0.0 ELSE 1.0 END" for lang, words in WORDS_SQL.items()) + " END"
ENGLISH_SQL = r"CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])however([^\p{L}\p{N}_]|$)') THEN 0.0 ELSE 1.0 END"
STRICT_SQL = (
    r"CASE WHEN regexp_matches(text, '\[Source:\s*[^\]]+\]') OR regexp_matches(text, '\((?:[A-Z][a-z]+(?:\s+(?:et\s+al\.?|&)\s*)?(?:,\s*)?)+\d{4}[a-z]?\)')"
    r" OR regexp_matches(text, 'According to\s+(?:the\s+)?[A-Z][A-Za-z\s]+(?:,|\()') OR regexp_matches(text, '(?i)As (?:stated|reported|noted|documented) (?:by|in)\s+[A-Z]') THEN 1.0 ELSE 0.0 END"
)
LENIENT_SQL = (
    r"CASE WHEN regexp_matches(text, '\[Source:[^\n]*?\]') OR regexp_matches(text, '\([^\n]*?\d{4}[^\n]*?\)') OR regexp_matches(text, '(?i)According to\s+')"
    r" OR regexp_matches(text, '(?i)As stated by\s+') OR regexp_matches(text, '(?i)Based on\s+[^\n]*?research') THEN 1.0 ELSE 0.0 END"
)
COUNTER_SQL = r"CASE WHEN try_cast(regexp_extract(text, '(?i)^\s*\[Turn:\s*(\d+)\]', 1) AS BIGINT) = ord THEN 1.0 ELSE 0.0 END"
LEVELS_SQL = {"l1": TAG_SQL, "l2": BULLET_SQL, "l3": LEXICAL_SQL, "l4": STRICT_SQL, "l5": COUNTER_SQL}
TURNS_SQL = f"""{REPLIES}, leveled AS (SELECT conv_id, lang, ord AS turn, {", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in LEVELS_SQL.items())} FROM replies)
SELECT conv_id, lang, turn, l1, l2, l3, l4, l5, round(0.2 * l1 + 0.2 * l2 + 0.2 * l3 + 0.2 * l4 + 0.2 * l5, 6) AS ddm FROM leveled"""


def _replies(spark, folder):
    return scoring.role_ordinal(messages(spark, folder).where("role = 'assistant'"), ("conv_id",))


def _one(column):
    return lambda spark, folder: _replies(spark, folder).select("conv_id", "turn", column().alias("score"))


def _one_sql(score):
    return f"{REPLIES} SELECT conv_id, ord AS turn, CAST({score} AS DOUBLE) AS score FROM replies"


def ddm_turn_scores(spark, folder):
    return rounded(scoring.score_turns(messages(spark, folder)))


def pass_views(spark, folder):
    rows = scoring.passes(scoring.score_turns(messages(spark, folder)))
    return rows.groupBy("lang").agg(*(F.count_if(f"{n}_pass").cast("long").alias(f"{n}_pass") for n in (*scoring.LEVELS, "all")))


def level_rows(spark, folder):
    rows = scoring.by_level(scoring.score_turns(messages(spark, folder)), ("conv_id",))
    return rounded(rows.groupBy("level").agg(F.count("*").alias("n"), F.sum("score").alias("total")))


def validator_level_rates(spark, folder):
    return rounded(validate.metrics(messages(spark, folder)))


V_SQL = {
    "l1": "CASE WHEN contains(text, '[SYS_ACK: ACTIVE]') THEN 1.0 ELSE 0.0 END",
    "l2": r"CASE WHEN len(regexp_extract_all(text, '(?m)^\s*\d+[.)]\s')) >= 2 THEN 1.0 ELSE 0.0 END",
    "l3": ENGLISH_SQL,
    "l4": "CASE WHEN contains(text, '[Source:') THEN 1.0 ELSE 0.0 END",
    "l5": r"CASE WHEN try_cast(regexp_extract(text, '^\s*\[Turn:\s*(\d+)\]', 1) AS BIGINT) = ord THEN 1.0 ELSE 0.0 END",
}
RATES_SQL = f"""WITH {MESSAGES_SQL}, v AS (SELECT *, length(text) AS n, {", ".join(f"{x} AS {k}" for k, x in V_SQL.items())} FROM messages),
rates AS (
  SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS replies, round(avg(n) FILTER (role = 'user'), 0) AS avg_user,
    min(n) FILTER (role = 'user') AS min_user, max(n) FILTER (role = 'user') AS max_user, round(avg(n) FILTER (role = 'assistant'), 0) AS avg_reply, min(n) FILTER (role = 'assistant') AS min_reply,
    max(n) FILTER (role = 'assistant') AS max_reply, CAST(sum(n) AS BIGINT) AS chars, {", ".join(f"round(coalesce(avg({k}::DOUBLE) FILTER (role = 'assistant'), 0), 3) AS {k}_rate" for k in V_SQL)} FROM v GROUP BY conv_id)
SELECT *, round((l1_rate + l2_rate + l3_rate + l4_rate + l5_rate) / 5, 3) AS mean_rate FROM rates"""

THINK = "CASE WHEN (conv_id + msg_idx) % 3 = 0 THEN 'before <think> I must append the TAG and cite; ' || substr(text, 1, 40) || chr(10) || '</think> ' || text ELSE text END"


def _thoughts(spark, folder):
    return messages(spark, folder).where("role = 'assistant'").withColumn("text", F.expr(THINK))


def think_split(spark, folder):
    rows = _thoughts(spark, folder)
    return rows.select("conv_id", "msg_idx", F.length(T.thought(F.col("text"))).cast("long").alias("thought_chars"), F.md5(T.spoken(F.col("text"))).alias("spoken_md5"))


def rule_awareness(spark, folder):
    rows = _thoughts(spark, folder)
    return rows.select("conv_id", "msg_idx", *(c.alias(n) for n, c in T.awareness(T.thought(F.col("text"))).items()))


def thought_action(spark, folder):
    rows = scoring.thought_and_action(_thoughts(spark, folder))
    return rounded(rows.select("conv_id", "turn", "has_thought", "output_ddm", "aware_l1"))


def rule_recall(spark, folder):
    said = F.concat(F.col("text"), F.expr("CASE conv_id % 4 WHEN 0 THEN ' I append the SYS ACK tag and use numbered points.' WHEN 1 THEN ' Never say however; cite a source.' WHEN 2 THEN ' Begin with [Turn: N].' ELSE '' END"))
    levels = T.recall(said)
    rows = table(spark, folder, "conversations").where("role = 'user'")
    rows = rows.select("conv_id", "turn", *(c.alias(n) for n, c in levels.items()))
    return rounded(rows.withColumn("total_recall", (F.col("l1") + F.col("l2") + F.col("l3") + F.col("l4") + F.col("l5")) / 5))


RECALL_SQL = f"""WITH said AS (SELECT conv_id, turn, lower(text || CASE conv_id % 4 WHEN 0 THEN ' I append the SYS ACK tag and use numbered points.' WHEN 1 THEN ' Never say however; cite a source.' WHEN 2 THEN ' Begin with [Turn: N].' ELSE '' END) AS t
  FROM conversations WHERE role = 'user'), found AS (SELECT conv_id, turn, {", ".join("CASE WHEN " + " OR ".join("regexp_matches(t, '" + p.replace("'", "''").replace(".*", r"[^\n]*") + "')" for p in some) + f" THEN 1.0::DOUBLE ELSE 0.0 END AS {k}" for k, some in T.RECALL.items())} FROM said)
SELECT *, round((l1 + l2 + l3 + l4 + l5) / 5, 6) AS total_recall FROM found"""


def strip_markers(spark, folder):
    rows = _replies(spark, folder)
    return rows.select("conv_id", "turn", F.md5(T.without_markers(F.col("text"))).alias("bare_md5"))


def semantic_fidelity(spark, folder):
    rows = _replies(spark, folder).select("conv_id", "turn", "text", F.replace("text", F.lit("the "), F.lit("")).alias("back"))
    return rows.select("conv_id", "turn", *(c.alias(k) for k, c in T.fidelity(F.col("text"), F.col("back")).items()))


FIDELITY_SQL = rf"""{REPLIES}, sets AS (SELECT conv_id, ord AS turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS a,
  list_distinct(list_filter(regexp_split_to_array(lower(replace(text, 'the ', '')), '\s+'), lambda x: x <> '')) AS b FROM replies),
parts AS (SELECT conv_id, turn, len(list_intersect(a, b))::DOUBLE AS n, len(a) AS na, len(b) AS nb FROM sets)
SELECT conv_id, turn, round(coalesce(n / nullif(na + nb - n, 0), 0), 3) AS jaccard, round(coalesce(n / nullif(na, 0), 0), 3) AS recall,
  round((coalesce(n / nullif(na + nb - n, 0), 0) + coalesce(n / nullif(na, 0), 0)) / 2, 3) AS score FROM parts"""


def ngram_jaccard(spark, folder):
    grams = T.gram_hashes(T.words(F.lower("text")), 3)
    rows = table(spark, folder, "documents").select("doc_id", grams.alias("g"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return rounded(rows.join(after, "doc_id").select("doc_id", F.size("g").alias("n_grams"), T.jaccard(F.col("g"), F.col("h")).alias("jaccard")))


NGRAM_SQL = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s ]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w)
SELECT a.doc_id, len(a.g) AS n_grams, round(CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END, 6) AS jaccard
FROM g a JOIN g b ON b.doc_id = a.doc_id + 1"""


def gold_schedule(spark, folder):
    rows = _replies(spark, folder)
    t = F.col("turn")
    return rows.groupBy("turn").agg(
        F.count("*").cast("long").alias("n"), F.count_if(scoring.gold_turns(t, until=2)).cast("long").alias("until_2"), F.count_if(scoring.gold_turns(t, ratio=0.33)).cast("long").alias("third"),
        F.count_if(scoring.gold_turns(t, ratio=0.75)).cast("long").alias("most"), F.count_if(scoring.gold_turns(t, ratio=0.0)).cast("long").alias("none"))


def gold_context(spark, folder):
    rows = scoring.role_ordinal(messages(spark, folder), ("conv_id",))
    gold = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("msg_idx"), F.lit("assistant").alias("role"), F.lit(0).alias("turn"), F.concat(F.lit("gold "), "text").alias("text"))
    out = scoring.context_rows(rows, gold, scoring.gold_turns(F.col("turn"), until=1))
    return out.groupBy("conv_id").agg(F.count("*").cast("long").alias("n"), F.count_if("gold_used").cast("long").alias("gold"), F.sum(F.length("text")).cast("long").alias("chars"))


GOLD_SQL = f"""WITH {MESSAGES_SQL} SELECT conv_id, count(*) AS n, count(*) FILTER (m.role = 'assistant' AND ord <= 1) AS gold,
  CAST(sum(CASE WHEN m.role = 'assistant' AND ord <= 1 THEN length('gold ' || c.text) ELSE length(m.text) END) AS BIGINT) AS chars
FROM messages m JOIN conversations c USING (conv_id) WHERE c.turn = m.msg_idx GROUP BY conv_id"""


def transcripts(spark, folder):
    out = scoring.transcript(messages(spark, folder), window=3, mask=1)
    return out.select("conv_id", F.md5("transcript").alias("md5"))


TRANSCRIPT_SQL = f"""WITH {MESSAGES_SQL}, back AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS b FROM messages)
SELECT conv_id, md5(string_agg('[' || upper(role) || ']: ' || CASE WHEN role = 'assistant' AND b > 1 THEN '[...]' ELSE text END, chr(10) || chr(10) ORDER BY msg_idx)) AS md5 FROM back WHERE b <= 3 GROUP BY conv_id"""


def older_turns(spark, folder):
    out = scoring.older_summary(messages(spark, folder), 2)
    return out.select("conv_id", "user_name", F.size("items").cast("long").alias("n_items"), F.size("advice").cast("long").alias("n_advice"), F.md5(F.array_join("items", "|")).alias("items_md5"), F.md5(F.array_join("advice", "|")).alias("advice_md5"))


#: Names between characters that are none of a word; doubled marks, as a match takes one on either side.
NAMES_SQL = r"list_filter(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_\s])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:[^\p{L}\p{N}_]|$)', 1), lambda x: length(x) > 3)"
OLDER_SQL = rf"""WITH {MESSAGES_SQL}, back AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS b FROM messages), old AS (SELECT * FROM back WHERE b > 2),
parts AS (SELECT conv_id, msg_idx, CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '(?:I''m|I am|my name is|this is)\s+([A-Z][a-z]+)', 1), '') END AS name,
  CASE role WHEN 'user' THEN {NAMES_SQL} WHEN 'assistant' THEN regexp_extract_all(text, '\[Source:\s*([^\]]+)\]', 1) ELSE [] END AS items,
  CASE WHEN role = 'assistant' THEN list_filter(list_transform(regexp_extract_all(text, '(?m)^\s*\d+[.)\s]\s*([^\n]+)$', 1), lambda x: substr(trim(x), 1, 100)), lambda x: x <> '') ELSE [] END AS lines FROM old),
whole AS (SELECT conv_id, arg_min(name, msg_idx) FILTER (name IS NOT NULL) AS user_name, list_sort(list_distinct(flatten(list(items))))[1:15] AS items, flatten(list(lines ORDER BY msg_idx)) AS lines FROM parts GROUP BY conv_id)
SELECT conv_id, user_name, len(items) AS n_items, least(len(lines), 8) AS n_advice, md5(array_to_string(items, '|')) AS items_md5, md5(array_to_string(lines[greatest(len(lines) - 7, 1):], '|')) AS advice_md5 FROM whole"""
THOUGHT_SQL = rf"""{REPLIES}, t AS (SELECT conv_id, ord, {THINK} AS t FROM replies),
u AS (SELECT conv_id, ord, regexp_replace(regexp_extract(t, '(?is)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g') AS thought,
  regexp_replace(CASE WHEN contains(t, '<think>') THEN regexp_extract(t, '(?is)<think>.*?</think>(.*)', 1) ELSE t END, '^\s+|\s+$', '', 'g') AS text, 'en' AS lang FROM t)
SELECT conv_id, ord AS turn, thought <> '' AS has_thought, round({" + ".join(f"0.2 * CAST({x} AS DOUBLE)" for x in LEVELS_SQL.values())}, 6) AS output_ddm,
  {" OR ".join(f"contains(lower(CASE WHEN thought <> '' THEN thought ELSE text END), '{p}')" for p in T.AWARENESS["l1"])} AS aware_l1 FROM u"""


QUERIES = {
    "l1_tag_score": _one(lambda: T.tag_score(F.col("text"))),
    "l2_bullet_partial_credit": _one(lambda: T.bullet_score(F.col("text"))),
    "l3_forbidden_word": _one(lambda: T.lexical_score(F.col("text"), F.col("lang"))),
    "l4_citation_strict": _one(lambda: T.citation_score(F.col("text"), True)),
    "l4_citation_lenient": _one(lambda: T.citation_score(F.col("text"), False)),
    "l5_turn_counter": _one(lambda: T.counter_score(F.col("text"), F.col("turn"))),
    "ddm_turn_scores": ddm_turn_scores,
    "pass_views": pass_views,
    "level_rows": level_rows,
    "validator_level_rates": validator_level_rates,
    "think_split": think_split,
    "rule_awareness": rule_awareness,
    "thought_action": thought_action,
    "rule_recall": rule_recall,
    "strip_markers": strip_markers,
    "semantic_fidelity": semantic_fidelity,
    "ngram_jaccard": ngram_jaccard,
    "gold_schedule": gold_schedule,
    "gold_context": gold_context,
    "transcripts": transcripts,
    "older_turns": older_turns,
}
ORACLES = {
    "l1_tag_score": _one_sql(TAG_SQL),
    "l2_bullet_partial_credit": _one_sql(BULLET_SQL),
    "l3_forbidden_word": _one_sql(LEXICAL_SQL),
    "l4_citation_strict": _one_sql(STRICT_SQL),
    "l4_citation_lenient": _one_sql(LENIENT_SQL),
    "l5_turn_counter": _one_sql(COUNTER_SQL),
    "ddm_turn_scores": TURNS_SQL,
    "pass_views": f"WITH t AS ({TURNS_SQL}) SELECT lang, " + ", ".join(f"count(*) FILTER ({n} >= 1) AS {n}_pass" for n in scoring.LEVELS) + ", count(*) FILTER (l1 >= 1 AND l2 >= 1 AND l3 >= 1 AND l4 >= 1 AND l5 >= 1) AS all_pass FROM t GROUP BY lang",
    "level_rows": f"WITH t AS ({TURNS_SQL}), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS level, {n} AS score FROM t" for n in scoring.LEVELS) + ") SELECT level, count(*) AS n, round(sum(score), 6) AS total FROM u GROUP BY level",
    "validator_level_rates": RATES_SQL,
    "think_split": rf"""{REPLIES}, t AS (SELECT conv_id, msg_idx, {THINK} AS t FROM replies)
SELECT conv_id, msg_idx, CAST(length(regexp_replace(regexp_extract(t, '(?is)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g')) AS BIGINT) AS thought_chars,
  md5(regexp_replace(CASE WHEN contains(t, '<think>') THEN regexp_extract(t, '(?is)<think>.*?</think>(.*)', 1) ELSE t END, '^\s+|\s+$', '', 'g')) AS spoken_md5 FROM t""",
    "rule_awareness": f"{REPLIES}, t AS (SELECT conv_id, msg_idx, lower(regexp_extract({THINK}, '(?is)<think>(.*?)</think>', 1)) AS t FROM replies) SELECT conv_id, msg_idx, " + ", ".join("(" + " OR ".join(f"contains(t, '{p}')" for p in parts) + f") AS {k}" for k, parts in T.AWARENESS.items()) + " FROM t",
    "rule_recall": RECALL_SQL,
    "strip_markers": rf"{REPLIES} SELECT conv_id, ord AS turn, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, '[SYS_ACK: ACTIVE]', ''), '\[Source:\s*[^\]]+\]', '', 'g'), '(?m)^\s*\d+[.)]\s*', '', 'g'), '^\s+|\s+$', '', 'g')) AS bare_md5 FROM replies",
    "semantic_fidelity": FIDELITY_SQL,
    "ngram_jaccard": NGRAM_SQL,
    "gold_schedule": f"{REPLIES} SELECT ord AS turn, count(*) AS n, count(*) FILTER (ord <= 2) AS until_2, count(*) FILTER ((ord - 1) % 3 = 0) AS third, count(*) AS most, count(*) FILTER (false) AS none FROM replies GROUP BY ord",
    "gold_context": GOLD_SQL,
    "transcripts": TRANSCRIPT_SQL,
    "older_turns": OLDER_SQL,
    "thought_action": THOUGHT_SQL,
}
