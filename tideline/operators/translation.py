"""Rules on translations: source and target messages side by side, and what must have survived.

Both: conv_id, msg_idx, role, text. A conversation whose sides differ in length has that issue and no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators.validate import _issue

# Target over source length, by target language.
RATIOS = {"it": (0.8, 1.5), "es": (0.8, 1.5), "fr": (0.85, 1.6), "de": (0.85, 1.7)}
ANY_RATIO = (0.5, 2.0)
CITATION = r"(?dU)\[Source:\s*[^\]]+\]"
CITED = r"(?dU)\[Source:\s*([^\]]+)\]"
BULLET = r"(?mdU)^\s*\d+[.)]\s"


def aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """conv_id, msg_idx, both sides (null where one is missing), and whole: both sides are equally long."""
    left = source.select("conv_id", "msg_idx", F.col("role").alias("s_role"), F.col("text").alias("s"))
    right = target.select("conv_id", "msg_idx", F.col("role").alias("t_role"), F.col("text").alias("t"))
    sizes = left.groupBy("conv_id").agg(F.count("*").alias("n_s")).join(right.groupBy("conv_id").agg(F.count("*").alias("n_t")), "conv_id", "full_outer")
    return left.join(right, ["conv_id", "msg_idx"], "full_outer").join(sizes, "conv_id").withColumn("whole", F.col("n_s").eqNullSafe(F.col("n_t")))


def issues(source: DataFrame, target: DataFrame, lang: str, tag: str = T.TAG) -> DataFrame:
    both = aligned(source, target)
    uneven = both.where("not whole").select("conv_id").distinct()
    out = _issue(uneven, F.lit(-1), "STRUCT_LENGTH", "error", F.lit("sides differ in length"))
    rows = both.where("whole and s is not null and t is not null")
    at = F.col("msg_idx")
    out = out.union(_issue(rows.where("s_role <> t_role"), at, "FMT_ROLE", "error", F.concat_ws(" ", "s_role", "t_role")))
    blank = T.strip(F.col("t")) == ""
    out = out.union(_issue(rows.where(blank), at, "CONTENT_EMPTY", "error", F.lit("empty")))
    rows = rows.where(~blank)
    reply = rows.where("s_role = 'assistant'")
    out = out.union(_issue(reply.where(F.col("s").contains(tag) & ~F.col("t").contains(tag)), at, "FMT_SYS_ACK", "error", F.lit("tag lost")))
    for rule, pattern in (("FMT_SOURCE", CITATION), ("FMT_BULLETS", BULLET)):
        n, m = F.regexp_count("s", F.lit(pattern)), F.regexp_count("t", F.lit(pattern))
        lost = reply.where(m < n)
        out = out.union(_issue(lost, at, rule, F.when(m == 0, "error").otherwise("warning"), F.concat_ws(" of ", m.cast("string"), n.cast("string"))))
    bodies = lambda c: F.transform(F.regexp_extract_all(c, F.lit(CITED), F.lit(1)), T.plain)
    changed = reply.where(F.size(bodies("t")) > 0).select("conv_id", "msg_idx", F.explode(bodies("s")).alias("body"), bodies("t").alias("theirs")).where(~F.array_contains("theirs", F.col("body")))
    out = out.union(_issue(changed, at, "FMT_SOURCE_TRANSLATED", "warning", F.col("body")))
    return out.union(length_issues(rows, lang)).union(untranslated(rows, tag))


def length_issues(rows: DataFrame, lang: str) -> DataFrame:
    low, high = RATIOS.get(lang, ANY_RATIO)
    sized = rows.where(F.length("s") >= 20).withColumn("ratio", F.length("t") / F.length("s"))
    r = F.col("ratio")
    extreme = (r < 0.5 * low) | (r > 1.5 * high)
    odd = sized.where((r < low) | (r > high))
    return _issue(odd, F.col("msg_idx"), F.when(extreme, "LEN_EXTREME").otherwise("LEN_RATIO"), F.when(extreme, "error").otherwise("warning"), F.round(r, 3).cast("string"))


def untranslated(rows: DataFrame, tag: str = T.TAG) -> DataFrame:
    """Targets with over 80 % of the more than ten words of their source."""
    a, b = (T.word_set(T.without_markers(F.col(c), tag)) for c in ("s", "t"))
    part = rows.select("conv_id", "msg_idx", a.alias("a"), b.alias("b")).where(F.size("a") > 10)
    return _issue(part.where(F.size(F.array_intersect("a", "b")) / F.size("a") > 0.8), F.col("msg_idx"), "CONTENT_UNTRANSLATED", "error", F.lit("source words kept"))


def metrics(source: DataFrame, target: DataFrame, tag: str = T.TAG) -> DataFrame:
    """Length ratios and the shares of replies that kept the tag, citations and numbered lines."""
    rows = aligned(source, target).where("whole")
    ratio = F.length("t") / F.when(F.length("s") > 0, F.length("s"))
    has = {"tag": lambda c: F.col(c).contains(tag), "citations": lambda c: F.col(c).rlike(CITATION), "bullets": lambda c: F.col(c).rlike(BULLET)}
    kept = [F.avg(F.when((F.col("s_role") == "assistant") & f("s"), f("t").cast("int"))).alias(f"{k}_kept") for k, f in has.items()]
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(ratio).alias("avg_ratio"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"), *kept)


def repaired(rows: DataFrame, tag: str = T.TAG) -> DataFrame:
    """rows (s, t) with t given the tag and the citations that it lost, before the tag."""
    lost = F.array_except(F.regexp_extract_all("s", F.lit(CITATION), F.lit(0)), F.regexp_extract_all("t", F.lit(CITATION), F.lit(0)))
    lost = F.when(F.regexp_count("t", F.lit(CITATION)) < F.regexp_count("s", F.lit(CITATION)), lost).otherwise(F.array().cast("array<string>"))
    tagged = F.when(F.col("s").contains(tag) & ~F.col("t").contains(tag), F.concat(F.rtrim("t"), F.lit(f"\n\n{tag}"))).otherwise(F.col("t"))
    cites = F.array_join(lost, "\n")
    put = F.when(tagged.contains(tag), F.replace(tagged, F.lit(tag), F.concat(cites, F.lit(f"\n\n{tag}")))).otherwise(F.concat(tagged, F.lit("\n"), cites))
    return rows.withColumn("fixed", F.when(F.size(lost) > 0, put).otherwise(tagged))


def back_translation(rows: DataFrame, retry_below: float = 0.35, approve_from: float = 0.3) -> DataFrame:
    """rows (text, back): fidelity, whether a text of over 50 characters should be tried once more, and whether it passes."""
    out = rows.withColumns({f"fidelity_{k}": c for k, c in T.fidelity(F.col("text"), F.col("back")).items()})
    score = F.col("fidelity_score")
    return out.withColumns({"needs_retry": (score < retry_below) & (F.length("text") > 50), "approved": score >= approve_from})


def quick_check(source: Column, target: Column) -> Column:
    """The rules of format that a translated message breaks: its tag is gone, it has fewer citations, all its numbered lines are gone."""
    cites = lambda c: F.regexp_count(c, F.lit(r"(?dU)\[Source:\s*[^\]]+\]"))
    points = lambda c: F.regexp_count(c, F.lit(r"(?mdU)^\s*\d+[.)]\s"))
    rules = {
        "FMT_SYS_ACK": source.contains(T.TAG) & ~target.contains(T.TAG),
        "FMT_SOURCE": cites(source) > cites(target),
        "FMT_BULLETS": (points(source) > 0) & (points(target) == 0),
    }
    return F.array_compact(F.array(*(F.when(broken, rule) for rule, broken in rules.items())))
