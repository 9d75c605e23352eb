"""Small functions that have no query elsewhere: what is read out of texts, verdicts, quick checks, and two rules that need texts which break them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import tokens
from tideline.operators import scenarios, translation, validate
from tideline.plans.frames import LANG, MODEL, rounded, table
from tideline.plans.frames import messages as marked
from tideline.plans.rule_queries import LONG_SQL, N_BULLETS, N_CITES, ORDS, TARGET_SQL, _target, long_talks
from tideline.sources import tables
from tideline.sources.shared import place

OTHER = "CASE conv_id % 3 WHEN 0 THEN replace(text, 'e', 'E') WHEN 1 THEN '  ' || replace(text, ' ', '   ') ELSE text || 'x' END"
SAID = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'I finally sorted it, ' || text WHEN 1 THEN 'The desk is clean. ' || text ELSE text END"
NOTED = "CASE (conv_id + turn) % 3 WHEN 0 THEN text || ' {\"turn\": ' || CAST(turn AS VARCHAR(9)) || ', \"x\": {}} so' WHEN 1 THEN '} {' ELSE text END"
BACK = "CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, CAST(floor(length(text) / 2) AS INT)) ELSE 'x y z' END"
NAME = "'  ' || c_name || ' ' || c_mktsegment || '/' || CAST(c_custkey AS VARCHAR(9)) || '.JSON '"


def _talk(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def same_texts(spark, folder):
    return _talk(spark, folder).select("conv_id", "turn", T.same(F.col("text"), F.expr(OTHER)).alias("same"))


def batch_messages(spark, folder):
    """A conversation as one reply: with marks, or line by line."""
    line = F.expr("CASE WHEN conv_id % 2 = 0 THEN '[MSG ' || CAST(turn + 1 AS VARCHAR(9)) || '] ' || text ELSE text END")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\n")
    found = _talk(spark, folder).groupBy("conv_id").agg(said.alias("reply")).select("conv_id", F.explode(T.messages_of(F.col("reply"))).alias("m"))
    return rounded(found.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("m")).alias("chars")))


def resolved_notes(spark, folder):
    return _talk(spark, folder).select("conv_id", "turn", T.resolved(F.expr(SAID)).alias("note"))


def sentence_counts(spark, folder):
    return rounded(table(spark, folder, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n")))


def file_names(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", T.file_name(F.expr(NAME)).alias("name"))


def json_objects(spark, folder):
    return _talk(spark, folder).select("conv_id", "turn", T.json_object(F.expr(NOTED)).alias("found"))


def drift_verdicts(spark, folder):
    deltas = table(spark, folder, "events").groupBy("user_id").agg((F.avg("value") - 50).alias("delta"))
    return rounded(deltas.select("user_id", F.round("delta", 6).alias("delta"), scenarios.real_drift(F.col("delta")).alias("verdict")))


def expansion_targets(spark, folder):
    rows = _talk(spark, folder).select("conv_id", "turn", tokens.count_tokens(F.col("text"), "whitespace").alias("en_tokens"), F.expr("1 + conv_id % 5 / 10.0D").alias("tfr"), F.expr("0.9D + turn % 4 / 100.0D").alias("similarity"))
    out = scenarios.paraphrase_targets(rows)
    return rounded(out.select("conv_id", "turn", "target_tokens", scenarios.expansion_success(F.col("en_tokens") + 9, F.col("target_tokens"), F.col("similarity")).alias("success")))


def back_translation(spark, folder):
    out = translation.back_translation(_talk(spark, folder).withColumn("back", F.expr(BACK)))
    return rounded(out.select("conv_id", "turn", "fidelity_score", "needs_retry", "approved"))


def tv_quick(spark, folder):
    pairs = marked(spark, folder).select("conv_id", "msg_idx", F.col("text").alias("s")).where("conv_id % 6 <> 0").join(_target(spark, folder).select("conv_id", "msg_idx", F.col("text").alias("t")), ["conv_id", "msg_idx"])
    return pairs.select("conv_id", "msg_idx", F.array_join(translation.quick_check(F.col("s"), F.col("t")), ",").alias("broken"))


#: Long conversations whose replies say the same phrases again, and cite an almanac for money.
WORN = "CASE msg_idx % 8 WHEN 1 THEN 'The single most important action: ' || text WHEN 3 THEN 'Alternatively, ' || text ELSE text END || CASE WHEN msg_idx % 5 = 0 THEN ' A budget. [Source: Almanac]' ELSE '' END"
CITATIONS = {"(?i)budget": r"\[Source: Almanac\]"}


def v_worn_phrases(spark, folder):
    rows = long_talks(spark, folder).withColumn("text", F.expr(WORN))
    found = validate.phrase_spam(rows).union(validate.odd_citations(rows, CITATIONS))
    return rounded(found.select("conv_id", "turn", "rule", "message"))


def profile_round_trip(spark, folder):
    """Attention profiles in a folder for each model and language, read back."""
    rows = table(spark, folder, "embeddings").select(F.expr(MODEL.format("vec_id")).alias("model"), F.expr(LANG.format("vec_id")).alias("lang"), F.col("vec_id").alias("conv_id"), F.posexplode("embedding").alias("turn", "share"))
    at = place(spark, "profiles")
    tables.write_profiles(rows, at)
    back = spark.read.schema("conv_id long, turn int, share double, model string, lang string").json(at)
    return rounded(back.groupBy("model", "lang").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"), F.sum(F.col("share").cast("float").cast("double")).alias("share")), 4)


WORDS = lambda x: rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> ''))"
PLAIN = lambda x: rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
SOLVED = "|".join(T.RESOLVED)
QUERIES = {f.__name__: f for f in (same_texts, batch_messages, resolved_notes, sentence_counts, file_names, json_objects, drift_verdicts, expansion_targets, back_translation, tv_quick, v_worn_phrases, profile_round_trip)}
ORACLES = {
    "same_texts": f"SELECT conv_id, turn, {PLAIN('text')} = {PLAIN(OTHER)} AS same FROM conversations",
    "batch_messages": r"""WITH l AS (SELECT conv_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS m, conv_id % 2 = 0 AS marked FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN text ELSE unnest(string_split(text, chr(10))) END AS x FROM conversations WHERE conv_id % 2 = 1
  UNION ALL SELECT conv_id, text FROM conversations WHERE conv_id % 2 = 0))
SELECT conv_id, count(*) AS n, CAST(sum(length(m)) AS BIGINT) AS chars FROM l WHERE CASE WHEN marked THEN m <> '' ELSE length(m) > 10 END GROUP BY conv_id""",
    "resolved_notes": f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(x), '{SOLVED}') THEN trim(substr(x, 1, 60)) END AS note FROM (SELECT conv_id, turn, {SAID} AS x FROM conversations)",
    "sentence_counts": r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS n FROM documents",
    "file_names": f"SELECT c_custkey, regexp_replace(replace(lower(trim({NAME})), ' ', '_'), '[^A-Za-z0-9_]', '', 'g') AS name FROM customer",
    "json_objects": rf"SELECT conv_id, turn, nullif(regexp_extract({NOTED}, '(?s)\{{.*\}}', 0), '') AS found FROM conversations",
    "drift_verdicts": "SELECT user_id, round(d, 6) AS delta, CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 3 THEN 'drift is real' ELSE 'drift is an artefact' END AS verdict FROM (SELECT user_id, avg(value) - 50 AS d FROM events GROUP BY user_id)",
    "expansion_targets": r"WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n, CAST(floor(len(regexp_extract_all(text, '\S+')) * (1 + conv_id % 5 / 10.0::DOUBLE)) AS BIGINT) AS target_tokens FROM conversations) SELECT conv_id, turn, target_tokens, n + 9 >= target_tokens AND 0.9::DOUBLE + turn % 4 / 100.0::DOUBLE >= 0.92::DOUBLE AS success FROM t",
    "back_translation": f"""WITH w AS (SELECT conv_id, turn, length(text) AS k, {WORDS('text')} AS a, {WORDS(BACK)} AS b FROM conversations), f AS (SELECT *, len(list_intersect(a, b))::DOUBLE AS n FROM w),
s AS (SELECT *, round((coalesce(n / nullif(len(a) + len(b) - n, 0), 0) + coalesce(n / nullif(len(a), 0), 0)) / 2, 3) AS score FROM f) SELECT conv_id, turn, score AS fidelity_score, score < 0.35 AND k > 50 AS needs_retry, score >= 0.3 AS approved FROM s""",
    "tv_quick": f"""{TARGET_SQL}, q AS (SELECT s.conv_id, s.msg_idx, s.text AS s, t.text AS t FROM messages s JOIN target t USING (conv_id, msg_idx) WHERE s.conv_id % 6 <> 0)
SELECT conv_id, msg_idx, array_to_string(list_filter([CASE WHEN contains(s, '[SYS_ACK: ACTIVE]') AND NOT contains(t, '[SYS_ACK: ACTIVE]') THEN 'FMT_SYS_ACK' END, CASE WHEN {N_CITES("s")} > {N_CITES("t")} THEN 'FMT_SOURCE' END, CASE WHEN {N_BULLETS("s")} > 0 AND {N_BULLETS("t")} = 0 THEN 'FMT_BULLETS' END], lambda x: x IS NOT NULL), ',') AS broken FROM q""",
    "v_worn_phrases": f"""WITH {LONG_SQL}, {ORDS}, r AS (SELECT conv_id, ord, {WORN} AS text FROM ords WHERE role = 'assistant'),
p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (contains(substr(lower(text), 1, 100), 'the single most important action')) AS a, count(*) FILTER (contains(substr(lower(text), 1, 100), 'alternatively')) AS b FROM r GROUP BY conv_id)
SELECT conv_id, -1 AS turn, 'QUAL_PHRASE_SPAM' AS rule, 'the single most important action ' || a || ' times' AS message FROM p WHERE n >= 5 AND a > 2 UNION ALL SELECT conv_id, -1, 'QUAL_PHRASE_SPAM', 'alternatively ' || b || ' times' FROM p WHERE n >= 5 AND b > 2
UNION ALL SELECT conv_id, ord, 'QUAL_CITATION_DOMAIN', 'source doesn''t suit' FROM r WHERE regexp_matches(text, '(?i)budget') AND contains(text, '[Source: Almanac]')""",
    "profile_round_trip": f"""WITH e AS (SELECT {MODEL.format("vec_id")} AS model, {LANG.format("vec_id")} AS lang, embedding, vec_id FROM embeddings), x AS (SELECT model, lang, unnest(range(0, len(embedding))) AS turn, unnest(embedding) AS share FROM e)
SELECT model, lang, count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns, round(sum(share::DOUBLE), 4) + 0.0::DOUBLE AS share FROM x GROUP BY model, lang""",
}
