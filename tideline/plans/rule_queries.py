"""Validators, translation rules, repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import repair, scoring, translation, validate
from tideline.plans.frames import MESSAGES_SQL, messages, rounded, table
from tideline.plans.score_queries import REPLIES, V_SQL

BASE = f"WITH {MESSAGES_SQL}"
LONG = """CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END"""
#: Documents of a source as one long conversation: repeats, near copies and lists for the rules that need many messages.
LONG_SQL = f"long AS (SELECT CAST(substr(source, 4) AS BIGINT) AS conv_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS msg_idx, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, text FROM documents)"
ORDS = "ords AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY msg_idx) - 1 AS ord FROM long)"
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\s ]+'), lambda x: x <> '')"


def long_talks(spark, folder):
    from pyspark.sql.window import Window

    rows = table(spark, folder, "documents").select(F.expr("CAST(substr(source, 4) AS BIGINT)").alias("conv_id"), "doc_id", "text")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("doc_id")) - 1
    rows = rows.withColumn("msg_idx", at.cast("long"))
    return rows.select("conv_id", "msg_idx", F.when(F.col("msg_idx") % 2 == 0, "user").otherwise("assistant").alias("role"), "text")


def v_levels(spark, folder):
    return rounded(validate.level_issues(messages(spark, folder)).select("conv_id", "turn", "rule", "severity"))


def v_structure(spark, folder):
    rows = messages(spark, folder).withColumn("text", F.expr("CASE WHEN (conv_id + msg_idx) % 13 = 0 THEN '  ' WHEN (conv_id + msg_idx) % 17 = 0 THEN 'ok' WHEN (conv_id + msg_idx) % 19 = 0 THEN repeat(text, 40) ELSE text END"))
    return rounded(validate.structure_issues(rows).select("conv_id", "turn", "rule", "severity"))


STRUCTURE = lambda text: rf"""{BASE}, odd AS (SELECT conv_id, msg_idx, role, {text} AS text FROM messages)
SELECT conv_id, msg_idx AS turn, 'STRUCT_ROLE' AS rule, 'error' AS severity FROM odd WHERE role <> CASE WHEN msg_idx % 2 = 0 THEN 'user' ELSE 'assistant' END
UNION ALL SELECT conv_id, msg_idx, 'STRUCT_EMPTY', 'error' FROM odd WHERE trim(text) = ''
UNION ALL SELECT conv_id, msg_idx, 'STRUCT_LENGTH_MIN', 'warning' FROM odd WHERE trim(text) <> '' AND ((role = 'user' AND length(text) < 3) OR (role = 'assistant' AND length(text) < 100))
UNION ALL SELECT conv_id, msg_idx, 'STRUCT_LENGTH_MAX', 'warning' FROM odd WHERE length(text) > 5000"""  # noqa: E731
STRUCTURE_SQL = STRUCTURE("CASE WHEN (conv_id + msg_idx) % 13 = 0 THEN '  ' WHEN (conv_id + msg_idx) % 17 = 0 THEN 'ok' WHEN (conv_id + msg_idx) % 19 = 0 THEN repeat(text, 40) ELSE text END")


def near_duplicate_band(spark, folder):
    """A source's documents in order of their texts, all as replies: near copies that share a beginning are neighbours."""
    from pyspark.sql.window import Window

    rows = table(spark, folder, "documents").select(F.expr("CAST(substr(source, 4) AS BIGINT)").alias("conv_id"), "doc_id", "text", F.lit("assistant").alias("role"))
    rows = rows.withColumn("msg_idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("text", "doc_id")))
    return rounded(validate.near_repeats(rows, most=0.2))


NEAR_SQL = f"""WITH ords AS (SELECT CAST(substr(source, 4) AS BIGINT) AS conv_id, 'assistant' AS role, row_number() OVER (PARTITION BY source ORDER BY text, doc_id) - 1 AS ord, text FROM documents), g AS (SELECT conv_id, ord, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM (SELECT *, {WORDS} AS w FROM ords WHERE role = 'assistant')),
p AS (SELECT a.conv_id, a.ord AS i, b.ord AS j, len(list_intersect(a.g, b.g))::DOUBLE AS n, len(a.g) AS x, len(b.g) AS y FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.ord BETWEEN a.ord + 1 AND a.ord + 4)
SELECT conv_id, i, j, round(n / (x + y - n), 6) AS similarity FROM p WHERE x > 0 AND y > 0 AND n / (x + y - n) > 0.2"""


#: Pairs of rows as pairs of classes, which have equal sets, and every row's class (a; b is the row), from which all pairs of rows follow.
CLASSED = """, r AS (SELECT conv_id, ord, len(g) AS n, min(ord) OVER (PARTITION BY conv_id, list_sort(g)) AS rep FROM g)
SELECT p.conv_id, 'pair' AS kind, least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, shared, CASE WHEN x.rep <= y.rep THEN n_i ELSE n_j END AS n_a, CASE WHEN x.rep <= y.rep THEN n_j ELSE n_i END AS n_b, count(*) AS n_pairs
FROM p JOIN r x ON x.conv_id = p.conv_id AND x.ord = i JOIN r y ON y.conv_id = p.conv_id AND y.ord = j"""
MEMBERS_OF = "UNION ALL SELECT conv_id, 'member', rep, ord, NULL, NULL, NULL, NULL FROM r WHERE n >= {0} AND (SELECT count(*) FROM g c WHERE c.conv_id = r.conv_id) >= {1}"


def _classed(pairs, belong):
    none = (F.lit(None).cast("long").alias(c) for c in ("shared", "n_a", "n_b", "n_pairs"))
    pairs = pairs.select("conv_id", F.lit("pair").alias("kind"), "a", "b", "shared", "n_a", "n_b", "n_pairs")
    return rounded(pairs.union(belong.select("conv_id", F.lit("member"), "rep", "ord", *none)))


def far_overlap_pairs(spark, folder):
    return _classed(*validate.verbatim_classes(long_talks(spark, folder), most=0.1))


FAR_SQL = f"""WITH {LONG_SQL}, {ORDS}, g AS (SELECT conv_id, ord, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT *, {WORDS} AS w FROM ords WHERE role = 'user')),
p AS (SELECT a.conv_id, a.ord AS i, b.ord AS j, len(list_intersect(a.g, b.g)) AS shared, len(a.g) AS n_i, len(b.g) AS n_j FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.ord >= a.ord + 5)
{CLASSED} WHERE shared > 0 AND shared / least(n_i, n_j)::DOUBLE > 0.1 AND (SELECT count(*) FROM g c WHERE c.conv_id = p.conv_id) >= 10 GROUP BY ALL {MEMBERS_OF.format(1, 10)}"""


def topic_repeat_pairs(spark, folder):
    rows = long_talks(spark, folder).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("1. "), F.regexp_replace(x, r"[^A-Za-z0-9 ]", " "))), "\n"))
    return _classed(*validate.topic_classes(rows, most=0.2))


TOPIC_SQL = f"""WITH {LONG_SQL}, {ORDS}, t AS (SELECT conv_id, ord, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[^A-Za-z0-9 ]', ' ', 'g')) AS lines, count(*) OVER (PARTITION BY conv_id) AS k FROM ords WHERE role = 'assistant'),
g AS (SELECT conv_id, ord, list_distinct(flatten(list_transform(lines, lambda x: regexp_extract_all(lower(x), '[a-z]{{6,}}')[1:5]))) AS g FROM t WHERE k >= 20),
p AS (SELECT a.conv_id, a.ord AS i, b.ord AS j, len(list_intersect(a.g, b.g)) AS shared, len(a.g) AS n_i, len(b.g) AS n_j FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.ord >= a.ord + 10 WHERE len(a.g) >= 3 AND len(b.g) >= 3)
{CLASSED} WHERE shared > 0 AND shared / (n_i + n_j - shared)::DOUBLE > 0.2 GROUP BY ALL {MEMBERS_OF.format(3, 0)}"""


def v_diversity(spark, folder):
    return rounded(validate.diversity(long_talks(spark, folder)))


def v_opening_mode(spark, folder):
    return rounded(validate.openings(long_talks(spark, folder)))


def v_length_cv(spark, folder):
    return rounded(validate.length_variation(long_talks(spark, folder)))


def v_meta_language(spark, folder):
    rows = validate.users(messages(spark, folder))
    return rows.groupBy("conv_id").agg(F.count_if(T.is_meta(F.col("text"))).cast("long").alias("n"))


def v_intro_repeat(spark, folder):
    return rounded(validate.repeated_intros(long_talks(spark, folder), least=2))


INTRO_SQL = rf"""WITH {LONG_SQL}, {ORDS}, s AS (SELECT conv_id, lower(regexp_replace(split_part(text, '.', 1), '^\s+|\s+$', '', 'g')) AS intro, count(*) OVER (PARTITION BY conv_id) AS k FROM ords WHERE role = 'assistant'),
c AS (SELECT conv_id, intro, count(*) AS n FROM s WHERE k >= 5 AND intro <> '' GROUP BY ALL HAVING count(*) >= 2) SELECT conv_id, intro, n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, intro) = 1"""


def v_echo(spark, folder):
    return rounded(validate.echoes(messages(spark, folder), least=1))


ECHO_TERMS = lambda drop: r"list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')), lambda x: regexp_full_match(x, '[a-z]{7,}') AND x NOT IN (" + ", ".join(f"'{w}'" for w in drop) + "))"
ECHO_SQL = f"""{BASE}, a AS (SELECT conv_id, ord, {ECHO_TERMS(T.COMMON_TERMS)} AS t FROM messages WHERE role = 'assistant'), u AS (SELECT conv_id, ord, {ECHO_TERMS(T.TOPIC_TERMS)} AS t FROM messages WHERE role = 'user')
SELECT u.conv_id, u.ord - 1 AS ord, len(list_intersect(a.t, u.t)) AS echoed FROM u JOIN a ON a.conv_id = u.conv_id AND u.ord = a.ord + 1 WHERE len(list_intersect(a.t, u.t)) >= 1"""


def phantom_reference_anti(spark, folder):
    return validate.phantoms(messages(spark, folder))


PHANTOM_SQL = rf"""{BASE}, r AS (SELECT conv_id, msg_idx, trim(unnest(regexp_extract_all(lower(text), 'you\s+(?:mentioned|said|suggested|told\s+me|recommended|asked\s+me)\s+([^\n]{{10,80}}?)(?:\.|,|\?|!|$)', 1))) AS reference FROM messages WHERE role = 'user'),
t AS (SELECT *, regexp_extract_all(reference, '[a-z]{{5,}}') AS terms FROM r WHERE length(reference) >= 5)
SELECT DISTINCT conv_id, msg_idx, reference FROM t WHERE len(terms) > 0 AND EXISTS (SELECT 1 FROM messages m WHERE m.conv_id = t.conv_id AND m.role = 'assistant' AND m.msg_idx < t.msg_idx)
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(terms) AS term) x JOIN messages m ON m.conv_id = t.conv_id AND m.role = 'assistant' AND m.msg_idx < t.msg_idx AND contains(lower(m.text), x.term))"""


def prev_assistant_pair(spark, folder):
    before = validate.replies(messages(spark, folder)).select("conv_id", (F.col("ord") + 1).alias("ord"), F.length("text").alias("reply_chars"))
    return rounded(validate.users(messages(spark, folder)).select("conv_id", "ord", F.length("text").alias("user_chars")).join(before, ["conv_id", "ord"]))


def v_report(spark, folder):
    rows = messages(spark, folder)
    return rounded(validate.report(rows, validate.level_issues(rows).union(validate.structure_issues(rows))))


REPORT_SQL = f"""{BASE}, v AS (SELECT *, {", ".join(f"{x} AS {k}" for k, x in V_SQL.items())} FROM messages),
i AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN CAST(5 - l1 - l2 - l3 - l4 - l5 AS INT) ELSE 0 END + CASE WHEN role <> CASE WHEN msg_idx % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 1 ELSE 0 END + CASE WHEN trim(text) = '' THEN 1 ELSE 0 END AS e,
  CASE WHEN trim(text) <> '' AND ((role = 'user' AND length(text) < 3) OR (role = 'assistant' AND length(text) < 100)) THEN 1 ELSE 0 END + CASE WHEN length(text) > 5000 THEN 1 ELSE 0 END AS w FROM v)
SELECT conv_id, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings, sum(e) = 0 AS passed FROM i GROUP BY conv_id"""


def v_issues(spark, folder):
    return rounded(validate.issues(messages(spark, folder)).groupBy("rule", "severity").agg(F.count("*").alias("n")))


def echo_audit(spark, folder):
    return rounded(validate.echo_audit(messages(spark, folder)))


SAFE_SQL = " OR ".join(f"contains(x, '{p}')" for p in T.SAFE_ECHOES)
ECHO_PATTERNS = [p.removeprefix("(?dU)").replace("'", "''").replace(".{", "[^\\n]{").replace(r"[\w\s]", r"[\p{L}\p{M}\p{N}_\s]") for p in T.ECHOES]
START = r"list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')[1:4]"
AUDIT_SQL = rf"""{BASE}, u AS (SELECT u.conv_id, lower(a.text) AS said, list_filter(list_transform(flatten([{", ".join(f"regexp_extract_all(lower(u.text), '{p}', 1)" for p in ECHO_PATTERNS)}]), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 4) AS refs
  FROM messages u LEFT JOIN messages a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.ord = u.ord - 1 WHERE u.role = 'user' AND u.ord > 1),
b AS (SELECT conv_id, said IS NOT NULL AND len(list_filter(refs, lambda x: NOT ({SAFE_SQL}) AND (contains(said, x) OR len({START}) >= 3 AND contains(said, array_to_string({START}, ' '))))) > 0 AS bad FROM u),
c AS (SELECT conv_id, count(*) AS total, count(*) FILTER (bad) AS violations FROM b GROUP BY conv_id)
SELECT conv_id, total, violations, round(violations * 100.0::DOUBLE / total, 6) AS pct, CASE WHEN violations * 100.0::DOUBLE / total <= 5 THEN 'PASS' WHEN violations * 100.0::DOUBLE / total <= 20 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM c"""


# --- translations: a conversation and a changed copy of it


def _target(spark, folder):
    rows = messages(spark, folder)
    text = F.expr("CASE WHEN (conv_id + msg_idx) % 7 = 0 THEN replace(text, '[SYS_ACK: ACTIVE]', '') WHEN (conv_id + msg_idx) % 7 = 1 THEN replace(text, '[Source: Almanac', '[Source: Almanach') WHEN (conv_id + msg_idx) % 7 = 2 THEN substr(text, 1, 30)"
                  " WHEN (conv_id + msg_idx) % 7 = 3 THEN text || text || text WHEN (conv_id + msg_idx) % 7 = 4 THEN '  ' ELSE replace(text, 'the ', 'zu ') END")
    return rows.withColumns({"text": text, "role": F.when(F.expr("(conv_id + msg_idx) % 31 = 0"), "system").otherwise(F.col("role"))}).where("conv_id % 6 <> 0 or msg_idx > 0")


TARGET_SQL = f"""{BASE}, target AS (SELECT conv_id, msg_idx, CASE WHEN (conv_id + msg_idx) % 31 = 0 THEN 'system' ELSE role END AS role, CASE WHEN (conv_id + msg_idx) % 7 = 0 THEN replace(text, '[SYS_ACK: ACTIVE]', '') WHEN (conv_id + msg_idx) % 7 = 1 THEN replace(text, '[Source: Almanac', '[Source: Almanach')
  WHEN (conv_id + msg_idx) % 7 = 2 THEN substr(text, 1, 30) WHEN (conv_id + msg_idx) % 7 = 3 THEN text || text || text WHEN (conv_id + msg_idx) % 7 = 4 THEN '  ' ELSE replace(text, 'the ', 'zu ') END AS text FROM messages WHERE conv_id % 6 <> 0 OR msg_idx > 0),
pairs AS (SELECT s.conv_id, s.msg_idx, s.role AS s_role, t.role AS t_role, s.text AS s, t.text AS t FROM messages s JOIN target t USING (conv_id, msg_idx) WHERE s.conv_id % 6 <> 0)"""
CITES = lambda c: rf"regexp_extract_all({c}, '\[Source:\s*([^\]]+)\]', 1)"
N_CITES = lambda c: rf"len(regexp_extract_all({c}, '\[Source:\s*[^\]]+\]'))"
N_BULLETS = lambda c: rf"len(regexp_extract_all({c}, '(?m)^\s*\d+[.)]\s'))"
TV_SQL = f"""{TARGET_SQL}, full_ AS (SELECT * FROM pairs WHERE trim(t) <> ''), a AS (SELECT * FROM full_ WHERE s_role = 'assistant')
SELECT DISTINCT conv_id, -1 AS turn, 'STRUCT_LENGTH' AS rule, 'error' AS severity FROM messages WHERE conv_id % 6 = 0 UNION ALL SELECT conv_id, msg_idx, 'FMT_ROLE', 'error' FROM pairs WHERE s_role <> t_role
UNION ALL SELECT conv_id, msg_idx, 'CONTENT_EMPTY', 'error' FROM pairs WHERE trim(t) = '' UNION ALL SELECT conv_id, msg_idx, 'FMT_SYS_ACK', 'error' FROM a WHERE contains(s, '[SYS_ACK: ACTIVE]') AND NOT contains(t, '[SYS_ACK: ACTIVE]')
UNION ALL SELECT conv_id, msg_idx, 'FMT_SOURCE', CASE WHEN {N_CITES("t")} = 0 THEN 'error' ELSE 'warning' END FROM a WHERE {N_CITES("t")} < {N_CITES("s")}
UNION ALL SELECT conv_id, msg_idx, 'FMT_BULLETS', CASE WHEN {N_BULLETS("t")} = 0 THEN 'error' ELSE 'warning' END FROM a WHERE {N_BULLETS("t")} < {N_BULLETS("s")}
UNION ALL SELECT conv_id, msg_idx, 'FMT_SOURCE_TRANSLATED', 'warning' FROM (SELECT conv_id, msg_idx, unnest({CITES("s")}) AS c, {CITES("t")} AS cs FROM a) WHERE len(cs) > 0 AND NOT list_contains(cs, c)"""


def tv_format(spark, folder):
    found = translation.issues(messages(spark, folder), _target(spark, folder), "de")
    return rounded(found.where(~F.col("rule").startswith("LEN_") & (F.col("rule") != "CONTENT_UNTRANSLATED")).select("conv_id", "turn", "rule", "severity"))


def tv_length_ratio(spark, folder):
    found = translation.issues(messages(spark, folder), _target(spark, folder), "de")
    return rounded(found.where(F.col("rule").startswith("LEN_")).select("conv_id", "turn", "rule", "severity"))


LEN_SQL = f"""{TARGET_SQL}, r AS (SELECT conv_id, msg_idx, length(t) / length(s)::DOUBLE AS r FROM pairs WHERE trim(t) <> '' AND length(s) >= 20)
SELECT conv_id, msg_idx AS turn, CASE WHEN r < 0.5::DOUBLE * 0.85::DOUBLE OR r > 1.5::DOUBLE * 1.7::DOUBLE THEN 'LEN_EXTREME' ELSE 'LEN_RATIO' END AS rule, CASE WHEN r < 0.5::DOUBLE * 0.85::DOUBLE OR r > 1.5::DOUBLE * 1.7::DOUBLE THEN 'error' ELSE 'warning' END AS severity FROM r WHERE r < 0.85 OR r > 1.7"""


def tv_untranslated(spark, folder):
    found = translation.issues(messages(spark, folder), _target(spark, folder), "de")
    return rounded(found.where("rule = 'CONTENT_UNTRANSLATED'").select("conv_id", "turn"))


BARE = lambda c: rf"regexp_replace(regexp_replace(replace({c}, '[SYS_ACK: ACTIVE]', ''), '\[Source:\s*[^\]]+\]', '', 'g'), '(?m)^\s*\d+[.)]\s*', '', 'g')"
UNTRANSLATED_SQL = rf"""{TARGET_SQL}, w AS (SELECT conv_id, msg_idx, list_distinct(list_filter(regexp_split_to_array(lower({BARE("s")}), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower({BARE("t")}), '\s+'), lambda x: x <> '')) AS b FROM pairs WHERE trim(t) <> '')
SELECT conv_id, msg_idx AS turn FROM w WHERE len(a) > 10 AND len(list_intersect(a, b)) / len(a)::DOUBLE > 0.8"""


def tv_metrics(spark, folder):
    return rounded(translation.metrics(messages(spark, folder), _target(spark, folder)))


TVM_SQL = f"""{TARGET_SQL} SELECT conv_id, count(*) AS n, round(avg(length(t) / length(s)::DOUBLE), 6) AS avg_ratio, round(min(length(t) / length(s)::DOUBLE), 6) AS min_ratio, round(max(length(t) / length(s)::DOUBLE), 6) AS max_ratio,
  round(avg(contains(t, '[SYS_ACK: ACTIVE]')::INT) FILTER (s_role = 'assistant' AND contains(s, '[SYS_ACK: ACTIVE]')), 6) AS tag_kept, round(avg(({N_CITES("t")} > 0)::INT) FILTER (s_role = 'assistant' AND {N_CITES("s")} > 0), 6) AS citations_kept,
  round(avg(({N_BULLETS("t")} > 0)::INT) FILTER (s_role = 'assistant' AND {N_BULLETS("s")} > 0), 6) AS bullets_kept FROM pairs GROUP BY conv_id"""


def citation_reinsert(spark, folder):
    rows = translation.aligned(messages(spark, folder), _target(spark, folder)).where("whole and s_role = 'assistant'")
    out = translation.repaired(rows)
    return out.select("conv_id", "msg_idx", F.col("fixed").contains(T.TAG).alias("tag"), F.col("fixed").contains("[Source: Almanac").alias("source"), (F.length("fixed") - F.length("t")).cast("long").alias("added"))


REINSERT_SQL = rf"""{TARGET_SQL}, f AS (SELECT conv_id, msg_idx, s, t, CASE WHEN contains(s, '[SYS_ACK: ACTIVE]') AND NOT contains(t, '[SYS_ACK: ACTIVE]') THEN rtrim(t, ' ') || chr(10) || chr(10) || '[SYS_ACK: ACTIVE]' ELSE t END AS g,
  CASE WHEN {N_CITES("t")} < {N_CITES("s")} THEN list_filter(regexp_extract_all(s, '\[Source:\s*[^\]]+\]'), lambda c: NOT list_contains(regexp_extract_all(t, '\[Source:\s*[^\]]+\]'), c)) ELSE [] END AS lost FROM pairs WHERE s_role = 'assistant'),
x AS (SELECT *, CASE WHEN len(lost) = 0 THEN g WHEN contains(g, '[SYS_ACK: ACTIVE]') THEN replace(g, '[SYS_ACK: ACTIVE]', array_to_string(lost, chr(10)) || chr(10) || chr(10) || '[SYS_ACK: ACTIVE]') ELSE g || chr(10) || array_to_string(lost, chr(10)) END AS fixed FROM f)
SELECT conv_id, msg_idx, contains(fixed, '[SYS_ACK: ACTIVE]') AS tag, contains(fixed, '[Source: Almanac') AS source, length(fixed) - length(t) AS added FROM x"""


# --- repairs


def force_fix(spark, folder):
    rows = scoring.role_ordinal(messages(spark, folder).where("role = 'assistant'"), ("conv_id",))
    return rows.select("conv_id", "turn", F.md5(repair.force_fix(F.col("text"), F.col("turn"))).alias("fixed_md5"))


SOURCE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(d), '{w}')" for w in words) + f" THEN '{source}'" for words, source in repair.SOURCES) + f" ELSE '{repair.OTHER_SOURCE}' END"
OPENING_SQL = "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in repair.REPLACEMENTS) + "][1 + ord % 8] || ' '"
FIX_SQL = rf"""{REPLIES}, a AS (SELECT conv_id, ord, regexp_replace(regexp_replace(regexp_replace(text, '[Tt]he single most important action(?:\s+is)?\s+(?:to\s+)?', {OPENING_SQL}), '[Tt]he key is to\s+', {OPENING_SQL}), '[Tt]he most important thing(?:\s+is)?\s+(?:to\s+)?', {OPENING_SQL}) AS a FROM replies),
b AS (SELECT *, '[Turn: ' || ord || '] ' || regexp_replace(regexp_replace(a, '^\s*\[Turn:\s*\d+\]\s*', ''), '^\s+', '') AS b FROM a), c AS (SELECT *, CASE WHEN contains(b, '[SYS_ACK: ACTIVE]') THEN b ELSE regexp_replace(b, '\s+$', '') || chr(10) || chr(10) || '[SYS_ACK: ACTIVE]' END AS c FROM b),
d AS (SELECT *, regexp_replace(c, '(?i)\bhowever\b', 'that said', 'g') AS d FROM c),
e AS (SELECT *, CASE WHEN contains(d, '[Source:') THEN d WHEN regexp_matches(d, '(?m)^\s*1[.)\s]') THEN regexp_replace(d, '(?m)^(\s*1[.)\s])', '[Source: ' || {SOURCE_SQL} || ']' || chr(10) || '\1') ELSE replace(d, '[SYS_ACK: ACTIVE]', '[Source: ' || {SOURCE_SQL} || ']' || chr(10) || chr(10) || '[SYS_ACK: ACTIVE]') END AS e FROM d)
SELECT conv_id, ord AS turn, md5(e) AS fixed_md5 FROM e"""


def filler_counts(spark, folder):
    rows = repair.filler_counts(messages(spark, folder).withColumn("conv_id", F.floor(F.col("conv_id") / 10)).withColumn("msg_idx", F.col("msg_idx") + 100 * F.col("conv_id")))
    return rounded(rows.groupBy("conv_id").agg(F.max("f5").alias("key_uses"), F.max("f0").alias("wrong_uses"), F.count("*").alias("n")))


def filler_strip_running_count(spark, folder):
    rows = repair.strip_fillers(messages(spark, folder), allowed=0)
    return rounded(rows.select("conv_id", "turn", F.length("fixed").alias("n_chars")))


TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
STRIPPED = "text"
for _p in repair.FILLERS:
    _q = _p.replace("'", "''")
    STRIPPED = f"CASE WHEN regexp_matches(text, '(?i){_q}') THEN {TRIM(f"regexp_replace({STRIPPED}, '(?i){_q}', '')")} ELSE {STRIPPED} END"
STRIP_SQL = rf"""{REPLIES}, s AS (SELECT conv_id, ord, {STRIPPED} AS t FROM replies), p AS (SELECT *, regexp_extract(t, '(?s)^(\[Turn:\s*\d+\])', 1) AS tag, regexp_extract(t, '(?s)^\[Turn:\s*\d+\]\s*(.*)$', 1) AS core FROM s)
SELECT conv_id, ord AS turn, CASE WHEN tag = '' THEN length(t) ELSE length(tag) + 1 + length(regexp_replace(regexp_replace(regexp_replace(core, '^[\s,\-—–:]+', ''), '(?i)^(?:and|is that|is|that|but|so|or)\s+', ''), '^[\s,\-—–:]+', '')) END AS n_chars FROM p"""


def safety_net(spark, folder):
    return repair.safety_net(messages(spark, folder)).select("conv_id", "turn", F.md5("fixed").alias("fixed_md5"))


OFTEN = "text"
for _i, _p in enumerate(repair.FILLERS):
    _q = _p.replace("'", "''")
    OFTEN = f"CASE WHEN h{_i} AND n{_i} > 2 THEN {TRIM(f"regexp_replace({OFTEN}, '(?i){_q}', '')")} ELSE {OFTEN} END"
HITS = ", ".join(f"regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') AS h{i}" for i, p in enumerate(repair.FILLERS))
USES = ", ".join(f"count(*) FILTER (h{i}) OVER (PARTITION BY conv_id ORDER BY ord) AS n{i}" for i in range(len(repair.FILLERS)))
NET_SQL = rf"""{REPLIES}, hits AS (SELECT *, {HITS} FROM replies), uses AS (SELECT *, {USES} FROM hits), s AS (SELECT conv_id, ord, {OFTEN} AS t FROM uses),
p AS (SELECT *, regexp_extract(t, '(?s)^(\[Turn:\s*\d+\])', 1) AS tag, regexp_replace(regexp_replace(regexp_replace(regexp_extract(t, '(?s)^\[Turn:\s*\d+\]\s*(.*)$', 1), '^[\s,\-—–:]+', ''), '(?i)^(?:and|is that|is|that|but|so|or)\s+', ''), '^[\s,\-—–:]+', '') AS core FROM s),
q AS (SELECT *, length(regexp_extract(core, '^([^\p{{L}}\p{{N}}_]*)[a-z]', 1)) AS k, regexp_matches(core, '^[^\p{{L}}\p{{N}}_]*[a-z]') AS low FROM p),
polished AS (SELECT conv_id, ord, CASE WHEN tag = '' THEN t ELSE tag || ' ' || CASE WHEN low THEN substr(core, 1, k) || upper(substr(core, k + 1, 1)) || substr(core, k + 2) ELSE core END END AS text FROM q)""" + FIX_SQL.removeprefix(REPLIES).replace("FROM replies)", "FROM polished)")

MEMBERS = lambda of, n: f"list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT conv_id, ord - 1 AS ord, {WORDS} AS w FROM messages WHERE role = '{of}')"
WHOLE = lambda rule, rows: f"SELECT '{rule}' AS rule, 'warning' AS severity FROM ({rows})"
SAID = "SELECT conv_id, ord - 1 AS ord, text FROM messages WHERE role = "
ISSUE_PARTS = [
    WHOLE("QUAL_REPETITION", f"WITH g AS (SELECT conv_id, ord, {MEMBERS('assistant', 3)}) SELECT 1 FROM (SELECT len(list_intersect(a.g, b.g))::DOUBLE AS n, len(a.g) AS x, len(b.g) AS y FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.ord BETWEEN a.ord + 1 AND a.ord + 4) WHERE x > 0 AND y > 0 AND n / (x + y - n) > 0.6"),
    WHOLE("QUAL_DIVERSITY", f"SELECT conv_id FROM (SELECT conv_id, unnest({WORDS}) AS w FROM messages WHERE role = 'assistant') GROUP BY conv_id HAVING count(*) >= 100 AND count(DISTINCT w) / count(*)::DOUBLE < 0.15"),
    WHOLE("QUAL_USER_LENGTH_VARIANCE", "SELECT conv_id FROM messages WHERE role = 'user' GROUP BY conv_id HAVING count(*) >= 5 AND stddev_pop(length(text)) / avg(length(text)) < 0.2"),
    WHOLE("QUAL_META_LANGUAGE", "SELECT conv_id FROM messages WHERE role = 'user' AND regexp_matches(lower(text), '" + "|".join(T.META) + "') GROUP BY conv_id HAVING count(*) > 2"),
    WHOLE("QUAL_INTRO_REPETITION", rf"SELECT DISTINCT conv_id FROM (SELECT conv_id, lower(trim(split_part(regexp_replace(text, '^\s*\[Turn:\s*\d+\]\s*', ''), '.', 1))) AS intro, count(*) OVER (PARTITION BY conv_id) AS k FROM messages WHERE role = 'assistant') WHERE k >= 5 AND intro <> '' GROUP BY conv_id, intro HAVING count(*) >= 3"),
    WHOLE("QUAL_ASSISTANT_VARIETY", rf"WITH o AS (SELECT conv_id, lower(regexp_replace(substr(regexp_extract(regexp_replace(text, '^\s*\[Turn:\s*\d+\]\s*', ''), '^([^\n]*?)(?:\.|\d+[.)]|\n|$)', 1), 1, 80), '^\s+|\s+$', '', 'g')) AS o FROM messages WHERE role = 'assistant'), c AS (SELECT conv_id, o, count(*) AS c FROM o GROUP BY ALL) SELECT conv_id FROM c GROUP BY conv_id HAVING sum(c) >= 5 AND coalesce(max(c) FILTER (o <> ''), 0) / sum(c)::DOUBLE > 0.4"),
    *(WHOLE("QUAL_PHRASE_SPAM", f"SELECT conv_id FROM messages WHERE role = 'assistant' GROUP BY conv_id HAVING count(*) >= 5 AND count(*) FILTER (contains(substr(lower(text), 1, 100), '{p}')) > 2") for p in validate.SPAM),
    WHOLE("QUAL_USER_VERBATIM", f"WITH g AS (SELECT conv_id, ord, {MEMBERS('user', 5)}), p AS (SELECT a.conv_id, len(list_intersect(a.g, b.g)) AS n, least(len(a.g), len(b.g)) AS m FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.ord >= a.ord + 5) SELECT conv_id FROM p WHERE n > 0 AND n / m::DOUBLE > 0.5 AND (SELECT count(*) FROM g c WHERE c.conv_id = p.conv_id) >= 10 GROUP BY conv_id HAVING count(*) > 3"),
    WHOLE("CATD_ECHO", f"SELECT conv_id FROM ({ECHO_SQL.replace('>= 1', '>= 3')}) GROUP BY conv_id HAVING count(*) > 2"),
    WHOLE("COHER_PHANTOM_REF", PHANTOM_SQL),
    WHOLE("QUAL_TOPIC_REPEAT", rf"WITH t AS (SELECT conv_id, ord, list_distinct(flatten(list_transform(regexp_extract_all(text, '(?m)^\s*\d+[.)\s]\s*([^\n]+)$', 1), lambda x: regexp_extract_all(lower(x), '[a-z]{{6,}}')[1:5]))) AS g, count(*) OVER (PARTITION BY conv_id) AS k FROM messages WHERE role = 'assistant'), g AS (SELECT * FROM t WHERE k >= 20 AND len(g) >= 3) SELECT 1 FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.ord >= a.ord + 10 WHERE len(list_intersect(a.g, b.g)) / nullif(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 0)::DOUBLE > 0.4"),
]


QUERIES = {f.__name__: f for f in (
    v_levels, v_structure, near_duplicate_band, far_overlap_pairs, topic_repeat_pairs, v_diversity, v_opening_mode, v_length_cv, v_meta_language, v_intro_repeat, v_echo, phantom_reference_anti, prev_assistant_pair, v_report,
    v_issues, echo_audit, tv_format, tv_length_ratio, tv_untranslated, tv_metrics, citation_reinsert, force_fix, filler_counts, filler_strip_running_count, safety_net)}
ORACLES = {
    "v_levels": f"{REPLIES}, v AS (SELECT conv_id, ord - 1 AS turn, {', '.join(f'{x} AS {k}' for k, x in V_SQL.items())} FROM replies) " + " UNION ALL ".join(f"SELECT conv_id, turn, 'DDM_{k.upper()}' AS rule, 'error' AS severity FROM v WHERE {k} < 1" for k in V_SQL),
    "v_structure": STRUCTURE_SQL, "near_duplicate_band": NEAR_SQL, "far_overlap_pairs": FAR_SQL, "topic_repeat_pairs": TOPIC_SQL,
    "v_opening_mode": rf"WITH {LONG_SQL}, {ORDS}, o AS (SELECT conv_id, lower(regexp_replace(substr(regexp_extract(regexp_replace(text, '^\s*\[Turn:\s*\d+\]\s*', ''), '^([^\n]*?)(?:\.|\d+[.)]|\n|$)', 1), 1, 80), '^\s+|\s+$', '', 'g')) AS o FROM ords WHERE role = 'assistant'), "
    "c AS (SELECT conv_id, o, count(*) AS c FROM o GROUP BY ALL), s AS (SELECT conv_id, CAST(sum(c) AS BIGINT) AS n, coalesce(max(c) FILTER (o <> ''), 0) AS top FROM c GROUP BY conv_id) SELECT conv_id, n, top, round(1 - top / n::DOUBLE, 3) AS diversity FROM s WHERE n >= 5",
    "v_diversity": f"WITH {LONG_SQL}, w AS (SELECT conv_id, unnest({WORDS}) AS w FROM long WHERE role = 'assistant') SELECT conv_id, count(*) AS n_words, round(CASE WHEN count(*) >= 100 THEN count(DISTINCT w) / count(*)::DOUBLE END, 6) AS ttr FROM w GROUP BY conv_id",
    "v_length_cv": f"WITH {LONG_SQL} SELECT conv_id, count(*) AS n, round(stddev_pop(length(text)) / avg(length(text)), 6) AS cv FROM long WHERE role = 'user' GROUP BY conv_id HAVING count(*) >= 5",
    "v_meta_language": BASE + r" SELECT conv_id, count(*) FILTER (regexp_matches(lower(text), '" + "|".join(T.META) + "')) AS n FROM messages WHERE role = 'user' GROUP BY conv_id",
    "echo_audit": AUDIT_SQL, "filler_strip_running_count": STRIP_SQL,
    "v_intro_repeat": INTRO_SQL, "v_echo": ECHO_SQL, "phantom_reference_anti": PHANTOM_SQL,
    "prev_assistant_pair": f"{BASE} SELECT u.conv_id, u.ord - 1 AS ord, length(u.text) AS user_chars, length(a.text) AS reply_chars FROM messages u JOIN messages a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND u.role = 'user' AND u.ord = a.ord + 1",
    "v_report": REPORT_SQL, "tv_format": TV_SQL, "tv_length_ratio": LEN_SQL, "tv_untranslated": UNTRANSLATED_SQL, "tv_metrics": TVM_SQL, "citation_reinsert": REINSERT_SQL, "force_fix": FIX_SQL,
    "filler_counts": f"{REPLIES} SELECT conv_id // 10 AS conv_id, count(*) FILTER (regexp_matches(text, '(?i)The key is to\\s+')) AS key_uses, 0 AS wrong_uses, count(*) AS n FROM replies GROUP BY conv_id // 10",
}
ORACLES["v_issues"] = f"{BASE}, i AS (SELECT rule, severity FROM ({ORACLES['v_levels']}) UNION ALL SELECT rule, severity FROM ({STRUCTURE('text')}) UNION ALL " + " UNION ALL ".join(ISSUE_PARTS) + ") SELECT rule, severity, count(*) AS n FROM i GROUP BY ALL"
ORACLES["safety_net"] = NET_SQL
