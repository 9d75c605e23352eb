"""Rules on generated conversations, as one table of issues: conv_id, turn, rule, severity, message.

messages: conv_id, msg_idx (from 0), role, text. `turn` of an issue is the reply's ordinal from 0 for level rules, the
message's index for structure rules, and -1 for a conversation as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import text as T
from tideline.operators.scoring import LEVELS, role_ordinal
from tideline.sources.shared import place, stored

LENGTHS = {"user": 3, "assistant": 100}
LONGEST = 5000
SPAM = ("the single most important action", "alternatively")
CONV = ("conv_id",)


def _issue(rows: DataFrame, turn: Column, rule: Column | str, severity: Column | str, message: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("conv_id", turn.cast("int").alias("turn"), lit(rule).alias("rule"), lit(severity).alias("severity"), message.alias("message"))


def replies(messages: DataFrame) -> DataFrame:
    """Assistant messages with ord, from 0."""
    return role_ordinal(messages.where("role = 'assistant'"), CONV).withColumn("ord", F.col("turn") - 1)


def users(messages: DataFrame) -> DataFrame:
    return role_ordinal(messages.where("role = 'user'"), CONV).withColumn("ord", F.col("turn") - 1)


def level_issues(messages: DataFrame, tag: str = T.TAG) -> DataFrame:
    rows = replies(messages)
    scores = T.validator_scores(F.col("text"), F.col("turn"), tag)
    said = rows.select("conv_id", "ord", *(c.alias(n) for n, c in scores.items()), F.col("text").rlike(r"(?dU)^\s*\[Turn:\s*\d+\]").alias("counted"))
    each = said.unpivot(["conv_id", "ord", "counted"], list(LEVELS), "level", "score").where("score < 1")
    kind = F.when((F.col("level") == "l5") & F.col("counted"), "wrong turn number").when(F.col("level") == "l5", "no turn number").otherwise("level not met")
    return _issue(each, F.col("ord"), F.concat(F.lit("DDM_"), F.upper("level")), "error", kind)


def structure_issues(messages: DataFrame) -> DataFrame:
    wanted = F.when(F.col("msg_idx") % 2 == 0, "user").otherwise("assistant")
    role = _issue(messages.where(~F.col("role").eqNullSafe(wanted)), F.col("msg_idx"), "STRUCT_ROLE", "error", F.concat(F.lit("expected "), wanted))
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    empty = _issue(messages.where(blank), F.col("msg_idx"), "STRUCT_EMPTY", "error", F.lit("empty message"))
    full = messages.where(~blank).withColumn("n", F.length("text"))
    least = F.when(F.col("role") == "user", LENGTHS["user"]).when(F.col("role") == "assistant", LENGTHS["assistant"])
    short = _issue(full.where(F.col("n") < least), F.col("msg_idx"), "STRUCT_LENGTH_MIN", "warning", F.concat(F.col("n").cast("string"), F.lit(" characters")))
    long = _issue(full.where(F.col("n") > LONGEST), F.col("msg_idx"), "STRUCT_LENGTH_MAX", "warning", F.concat(F.col("n").cast("string"), F.lit(" characters")))
    return role.union(empty).union(short).union(long)


#: Replies of a conversation that one task compares with those after them.
SLICE = 512


def near_repeats(messages: DataFrame, ahead: int = 4, most: float = 0.6) -> DataFrame:
    """conv_id, i, j, similarity of replies at most `ahead` apart whose word trigrams are too alike. A conversation is cut into slices by
    position; the first `ahead` replies of a slice are handed to the one before as well, so that a window over a slice sees all
    neighbours and no task holds a conversation."""
    rows = replies(messages).select("conv_id", "ord", T.ngrams(T.words(F.lower("text")), 3).alias("grams"))
    own = F.floor(F.col("ord") / SLICE)
    handed = F.when((F.col("ord") % SLICE < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = rows.withColumn("slice", F.explode(handed)).withColumn("mine", F.col("slice") == own)
    order = Window.partitionBy("conv_id", "slice").orderBy("ord")
    later = {f"p{k}": F.struct(F.lead("ord", k).over(order).alias("j"), F.lead("grams", k).over(order).alias("other")) for k in range(1, ahead + 1)}
    pairs = rows.withColumns(later).where("mine").select("conv_id", F.col("ord").alias("i"), "grams", F.explode(F.filter(F.array(*later), lambda p: p.j.isNotNull())).alias("p"))
    return pairs.select("conv_id", "i", F.col("p.j").alias("j"), T.jaccard(F.col("grams"), F.col("p.other")).alias("similarity")).where(F.col("similarity") > most)


#: Classes of a block, and members that they may hold together: two blocks are compared by one task.
BLOCK, HELD = 4096, 1 << 22
#: Members whose classes are counted in one go.
AT_ONCE = 1 << 20
PAIRS = "conv_id long, a long, b long, shared long, n_a long, n_b long"


def set_classes(rows: DataFrame, members: str) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, ord, members) of a conversation with equal sets of members are a class: classes (conv_id, rep, members; rep is
    the least ord), and who is in which (conv_id, rep, ord). Empty sets are in none. Members are numbers from here on, hashes of 64 bits:
    of a billion in one conversation two would be taken for one with a chance of 1 in 40."""
    keyed = rows.where(F.size(members) > 0).withColumn(members, F.array_sort(F.transform(members, lambda x: F.xxhash64(x))))
    keyed = keyed.withColumn("name_", F.sha2(F.array_join(F.col(members).cast("array<string>"), "\n"), 256))
    keyed = stored(keyed, place(rows.sparkSession, "sets"))  # read several times from here on
    named = keyed.groupBy("conv_id", "name_").agg(F.min("ord").alias("rep"))
    belong = keyed.select("conv_id", "name_", "ord").join(named, ["conv_id", "name_"]).select("conv_id", "rep", "ord")
    reps = keyed.join(named, ["conv_id", "name_"]).where(F.col("ord") == F.col("rep")).select("conv_id", "rep", F.col(members).alias("members"))
    return reps, belong


def class_pairs(classes: DataFrame, enough) -> DataFrame:
    """conv_id, a, b (a < b), shared, n_a, n_b of classes that share a member, and enough of them (of shared, the smaller n and the larger).

    Members that one class alone has are dropped first. A conversation's classes are cut into blocks, each two blocks meet in a cell, and a
    cell counts what its classes share in memory: sets are shuffled, once for each block, and pairs are not, but for those that are found."""

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        one = bool(pdf["x"].iloc[0] == pdf["y"].iloc[0])
        left, right = pdf[pdf["own"] == pdf["x"].iloc[0]], pdf[pdf["own"] == pdf["y"].iloc[0]]
        held = np.concatenate([np.zeros(0, np.int64), *right["members"]])
        of = np.repeat(np.arange(len(right)), np.array([len(m) for m in right["members"]], np.int64))
        order = np.argsort(held, kind="stable")
        held, of = held[order], of[order]
        reps, n = right["rep"].to_numpy(), right["n"].to_numpy()
        out = []
        for rep, size, members in zip(left["rep"].to_numpy(), left["n"].to_numpy(), left["members"], strict=True):
            first, last = np.searchsorted(held, members, "left"), np.searchsorted(held, members, "right")
            first, count = first[last > first], (last - first)[last > first]
            shared = np.zeros(len(reps), np.int64)
            for some in np.split(np.arange(len(count)), np.flatnonzero(np.diff(np.cumsum(count) // AT_ONCE)) + 1):
                upto = np.cumsum(count[some])
                at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first[some] - upto + count[some], count[some])
                shared += np.bincount(of[at], minlength=len(reps))
            k = np.flatnonzero((shared > 0) & ((reps > rep) if one else True))
            k = k[enough(shared[k], np.minimum(n[k], size), np.maximum(n[k], size))]
            if len(k):
                swap = reps[k] < rep
                out.append(np.stack([np.minimum(reps[k], rep), np.maximum(reps[k], rep), shared[k], np.where(swap, n[k], size), np.where(swap, size, n[k])], 1))
        found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0] if len(found) else pd.Series(dtype="int64"), **{c.split()[0]: found[:, i] for i, c in enumerate(PAIRS.split(", ")[1:])}})

    held = classes.select("conv_id", "rep", F.size("members").alias("n"), F.explode("members").alias("member"))
    often = held.groupBy("conv_id", "member").agg(F.count("*").alias("k")).where("k > 1").select("conv_id", "member")
    kept = held.join(often, ["conv_id", "member"]).groupBy("conv_id", "rep").agg(F.first("n").alias("n"), F.collect_list("member").alias("members"))
    kept = stored(kept, place(classes.sparkSession, "kept"))
    sized = kept.groupBy("conv_id").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("members")) / HELD)).cast("int").alias("blocks"))
    dealt = kept.join(F.broadcast(sized), "conv_id").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))  # a row for each conversation
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("x"), F.greatest(k, F.col("own")).alias("y")))
    each = dealt.select("conv_id", F.col("rep").cast("long").alias("rep"), F.col("n").cast("long").alias("n"), "members", "own", F.explode(cells).alias("cell"))
    each = each.select("conv_id", "rep", "n", "members", "own", "cell.x", "cell.y")
    pairs = each.groupBy("conv_id", "x", "y").applyInPandas(met, PAIRS.replace("conv_id long", f"conv_id {dict(classes.dtypes)['conv_id']}"))
    return stored(pairs, place(classes.sparkSession, "pairs"))


def alike_classes(rows: DataFrame, members: str, gap: int, enough) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes that are alike and have rows at least `gap` apart: conv_id, a, b, shared, n_a, n_b, n_pairs (such pairs of rows; a = b:
    within a class); and who is in which class. A passage in a third of a conversation's rows is one class, not the square of its rows. enough: of
    shared, the smaller n and the larger, whether that is alike."""
    classes, belong = set_classes(rows, members)
    counts = belong.groupBy("conv_id", "rep").agg(F.count("*").alias("size"))
    n = F.size("members")
    alone = classes.join(counts.where("size > 1"), ["conv_id", "rep"]).select("conv_id", F.col("rep").alias("a"), F.col("rep").alias("b"), n.cast("long").alias("shared"), n.alias("n_a"), n.alias("n_b"))
    pairs = class_pairs(classes, enough).select(alone.columns).union(alone.where(enough(F.col("shared"), F.col("n_a"), F.col("n_b"))))
    # Of all pairs of rows those nearer than gap don't count: each row meets the few before it.
    near = belong.select("conv_id", F.col("rep").alias("p"), F.explode(F.sequence(F.col("ord") + 1, F.col("ord") + gap - 1)).alias("ord"))
    near = near.join(belong, ["conv_id", "ord"]).groupBy("conv_id", F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")).agg(F.count("*").alias("near"))
    size = lambda k: counts.select("conv_id", F.col("rep").alias(k), F.col("size").alias(f"size_{k}"))
    both = pairs.join(size("a"), ["conv_id", "a"]).join(size("b"), ["conv_id", "b"]).join(near, ["conv_id", "a", "b"], "left")
    every = F.when(F.col("a") == F.col("b"), F.expr("size_a * (size_a - 1) div 2")).otherwise(F.col("size_a") * F.col("size_b"))
    return both.select("conv_id", "a", "b", "shared", "n_a", "n_b", (every - F.coalesce("near", F.lit(0))).alias("n_pairs")).where("n_pairs > 0"), belong


def of_rows(pairs: DataFrame, belong: DataFrame, gap: int) -> DataFrame:
    """conv_id, i, j (j >= i + gap), shared, n_i, n_j: the rows of pairs of classes, as many as there are."""
    side = lambda k, name: belong.select("conv_id", F.col("rep").alias(k), F.col("ord").alias(name))
    both = pairs.join(side("a", "x"), ["conv_id", "a"]).join(side("b", "y"), ["conv_id", "b"])
    both = both.where((F.abs(F.col("x") - F.col("y")) >= gap) & ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))))
    swap = F.col("x") > F.col("y")
    return both.select("conv_id", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "shared", F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_i"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_j"))


def verbatim_classes(messages: DataFrame, gap: int = 5, most: float = 0.5, least_messages: int = 10) -> tuple[DataFrame, DataFrame]:
    rows = users(messages)
    many = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_messages).select("conv_id")
    grams = rows.join(many, "conv_id").select("conv_id", "ord", T.ngrams(T.words(F.lower("text")), 5).alias("grams"))
    return alike_classes(grams, "grams", gap, lambda n, small, large: n / small > most)


def topic_classes(messages: DataFrame, gap: int = 10, most: float = 0.4, least_messages: int = 20) -> tuple[DataFrame, DataFrame]:
    rows = replies(messages)
    many = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_messages).select("conv_id")
    marks = rows.join(many, "conv_id").select("conv_id", "ord", T.bullet_terms(F.col("text")).alias("terms")).where(F.size("terms") >= 3)
    return alike_classes(marks, "terms", gap, lambda n, small, large: n / (small + large - n) > most)


def topic_pairs(messages: DataFrame, gap: int = 10, most: float = 0.4, least_messages: int = 20) -> DataFrame:
    return of_rows(*topic_classes(messages, gap, most, least_messages), gap)


def diversity(messages: DataFrame) -> DataFrame:
    """conv_id, n_words, ttr (distinct words over words, of 100 words or more) of the assistant's texts."""
    said = messages.where("role = 'assistant'").select("conv_id", F.explode(T.words(F.lower("text"))).alias("w"))
    counts = said.groupBy("conv_id", "w").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.sum("n").alias("n_words"), F.count("*").alias("kinds"))
    return counts.select("conv_id", "n_words", F.when(F.col("n_words") >= 100, F.col("kinds") / F.col("n_words")).alias("ttr"))


def openings(messages: DataFrame) -> DataFrame:
    """conv_id, n, top (how often the commonest opening occurs) and diversity, of five replies or more."""
    counts = replies(messages).select("conv_id", T.opening(F.col("text")).alias("o")).groupBy("conv_id", "o").agg(F.count("*").alias("c"))
    out = counts.groupBy("conv_id").agg(F.sum("c").alias("n"), F.max(F.when(F.col("o") != "", F.col("c"))).alias("top")).where("n >= 5")
    return out.select("conv_id", "n", F.coalesce("top", F.lit(0)).alias("top"), F.round(1 - F.coalesce("top", F.lit(0)) / F.col("n"), 3).alias("diversity"))


def length_variation(messages: DataFrame, least: int = 5) -> DataFrame:
    """conv_id, n, cv: population deviation of the users' text lengths over their mean."""
    out = users(messages).groupBy("conv_id").agg(F.count("*").alias("n"), F.try_divide(F.stddev_pop(F.length("text")), F.avg(F.length("text"))).alias("cv"))
    return out.where(F.col("n") >= least)


def repeated_intros(messages: DataFrame, least: int = 3) -> DataFrame:
    """conv_id, intro, n: the first sentence that the assistant repeats most (of equals the least)."""
    rows = replies(messages).withColumn("n_replies", F.count("*").over(Window.partitionBy("conv_id"))).where("n_replies >= 5")
    counts = rows.select("conv_id", T.first_sentence(F.col("text")).alias("intro")).where("intro <> ''").groupBy("conv_id", "intro").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "intro")).alias("m")).select("conv_id", "m.intro", (-F.col("m.k")).alias("n"))


def echoes(messages: DataFrame, least: int = 3) -> DataFrame:
    """conv_id, ord, echoed: users' messages that take up distinctive words of the reply before."""
    before = replies(messages).select("conv_id", (F.col("ord") + 1).alias("ord"), T.terms(F.col("text"), 7, T.COMMON_TERMS).alias("theirs"))
    mine = users(messages).select("conv_id", "ord", T.terms(F.col("text"), 7, T.TOPIC_TERMS).alias("mine"))
    n = F.size(F.array_intersect("theirs", "mine"))
    return mine.join(before, ["conv_id", "ord"]).select("conv_id", "ord", n.alias("echoed")).where(F.col("echoed") >= least)


#: Terms that a reply is searched for in one go.
TERMS = 256


def phantoms(messages: DataFrame) -> DataFrame:
    """conv_id, msg_idx, reference: what a user says was said before, and no earlier reply has a word of it.

    Each term that a conversation's references use is looked for once in each reply, TERMS at a time, and its first reply kept; a
    reference then asks whether one of its terms has come before. No reference meets a reply."""
    asked = messages.where("role = 'user'").select("conv_id", "msg_idx", F.explode(T.references(F.col("text"))).alias("reference")).distinct()
    asked = asked.withColumn("terms", F.array_distinct(F.regexp_extract_all("reference", F.lit(r"[a-z]{5,}"), F.lit(0)))).where(F.size("terms") > 0)
    each = asked.select("conv_id", "msg_idx", "reference", F.explode("terms").alias("term"))
    known = each.select("conv_id", "term").distinct()
    blocks = known.groupBy("conv_id").agg(F.ceil(F.count("*") / TERMS).alias("blocks"))
    dealt = known.join(blocks, "conv_id").groupBy("conv_id", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")).agg(F.collect_list("term").alias("terms"))
    said = messages.where("role = 'assistant'").select("conv_id", F.col("msg_idx").alias("at"), F.lower("text").alias("said"))
    met = said.join(dealt, "conv_id").select("conv_id", "at", F.explode(F.filter("terms", lambda t: F.col("said").contains(t))).alias("term"))
    first = met.groupBy("conv_id", "term").agg(F.min("at").alias("first"))
    begun = said.groupBy("conv_id").agg(F.min("at").alias("begun"))  # before the first reply nothing can have been said
    found = each.join(first, ["conv_id", "term"], "left").groupBy("conv_id", "msg_idx", "reference").agg(F.min("first").alias("first"))
    lost = found.join(begun, "conv_id").where("begun < msg_idx and (first is null or first >= msg_idx)")
    return lost.select("conv_id", "msg_idx", "reference")


def phrase_spam(messages: DataFrame, phrases: tuple[str, ...] = SPAM) -> DataFrame:
    """Issues of conversations of five replies or more in which more than two begin with one of the phrases, in their first 100 characters."""
    head = F.substring(F.lower("text"), 1, 100)
    counts = replies(messages).groupBy("conv_id").agg(F.count("*").alias("n"), *(F.count_if(head.contains(p)).alias(f"s{i}") for i, p in enumerate(phrases))).where("n >= 5")
    said = F.array(*(F.struct(F.lit(p).alias("phrase"), F.col(f"s{i}").alias("times")) for i, p in enumerate(phrases)))
    often = counts.select("conv_id", F.explode(F.filter(said, lambda x: x.times > 2)).alias("x"))
    return _issue(often, F.lit(-1), "QUAL_PHRASE_SPAM", "warning", F.concat_ws(" ", F.col("x.phrase"), F.col("x.times").cast("string"), F.lit("times")))


def odd_citations(messages: DataFrame, citations: dict[str, str]) -> DataFrame:
    """Issues of replies that match a topic's pattern and that of a source that doesn't suit it."""
    rows = replies(messages)
    odd = F.array_compact(F.array(*(F.when(F.col("text").rlike(topic) & F.col("text").rlike(source), 1) for topic, source in citations.items()), F.lit(None).cast("int")))
    return _issue(rows.select("conv_id", "ord", F.explode(odd)), F.col("ord"), "QUAL_CITATION_DOMAIN", "warning", F.lit("source doesn't suit"))


def quality_issues(messages: DataFrame, citations: dict[str, str] | None = None) -> DataFrame:
    """citations: patterns of replies against sources that don't suit them; none by default."""
    turn, whole = (lambda c: F.col(c)), F.lit(-1)
    say = lambda *parts: F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    out = _issue(near_repeats(messages), turn("j"), "QUAL_REPETITION", "warning", say("like reply", F.col("i")))
    out = out.union(_issue(diversity(messages).where("ttr < 0.15"), whole, "QUAL_DIVERSITY", "warning", say("few words")))
    out = out.union(_issue(openings(messages).where("top / n > 0.4"), whole, "QUAL_ASSISTANT_VARIETY", "warning", say("one opening", F.col("top"), "times")))
    out = out.union(_issue(length_variation(messages).where("cv < 0.2"), whole, "QUAL_USER_LENGTH_VARIANCE", "warning", say("even lengths")))
    meta = users(messages).where(T.is_meta(F.col("text"))).groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 2")
    out = out.union(_issue(meta, whole, "QUAL_META_LANGUAGE", "warning", say(F.col("n"), "messages")))
    out = out.union(_issue(repeated_intros(messages), whole, "QUAL_INTRO_REPETITION", "warning", say(F.col("n"), "times")))
    out = out.union(phrase_spam(messages)).union(odd_citations(messages, citations or {}))
    often = verbatim_classes(messages)[0].groupBy("conv_id").agg(F.sum("n_pairs").alias("n")).where("n > 3")
    out = out.union(_issue(often, whole, "QUAL_USER_VERBATIM", "warning", say(F.col("n"), "pairs")))
    echo = echoes(messages).groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 2")
    out = out.union(_issue(echo, whole, "CATD_ECHO", "warning", say(F.col("n"), "messages")))
    out = out.union(_issue(phantoms(messages), turn("msg_idx"), "COHER_PHANTOM_REF", "warning", F.col("reference")))
    return out.union(_issue(topic_pairs(messages), turn("j"), "QUAL_TOPIC_REPEAT", "warning", say("like reply", F.col("i"))))


def issues(messages: DataFrame, tag: str = T.TAG) -> DataFrame:
    return level_issues(messages, tag).union(structure_issues(messages)).union(quality_issues(messages))


def report(messages: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, errors, warnings, passed of every conversation."""
    counts = found.groupBy("conv_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = messages.select("conv_id").distinct().join(counts, "conv_id", "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("passed", F.col("errors") == 0)


def metrics(messages: DataFrame, tag: str = T.TAG) -> DataFrame:
    """Counts, lengths by role and the levels' pass rates of each conversation."""
    mine, theirs = F.col("role") == "user", F.col("role") == "assistant"
    n = F.length("text")
    rows = role_ordinal(messages, CONV)
    scores = T.validator_scores(F.col("text"), F.col("turn"), tag)
    rates = [F.round(F.coalesce(F.avg(F.when(theirs, c)), F.lit(0.0)), 3).alias(f"{k}_rate") for k, c in scores.items()]
    out = rows.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(mine).alias("users"), F.count_if(theirs).alias("replies"), F.round(F.avg(F.when(mine, n))).alias("avg_user"), F.min(F.when(mine, n)).alias("min_user"),
        F.max(F.when(mine, n)).alias("max_user"), F.round(F.avg(F.when(theirs, n))).alias("avg_reply"), F.min(F.when(theirs, n)).alias("min_reply"), F.max(F.when(theirs, n)).alias("max_reply"), F.sum(n).alias("chars"), *rates)
    return out.withColumn("mean_rate", F.round(sum((F.col(f"{k}_rate") for k in LEVELS), F.lit(0.0)) / 5, 3))


def echo_audit(messages: DataFrame) -> DataFrame:
    """conv_id, total, violations, pct, verdict: users who repeat phrases of the reply before."""
    before = replies(messages).select("conv_id", (F.col("ord") + 1).alias("ord"), F.col("text").alias("said"))
    mine = users(messages).where("ord > 0").select("conv_id", "ord", "text").join(before, ["conv_id", "ord"], "left")
    bad = F.size(T.echoed(F.col("text"), F.coalesce("said", F.lit("")))) > 0
    out = mine.groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(bad & F.col("said").isNotNull()).alias("violations"))
    pct = F.col("violations") * 100.0 / F.col("total")
    return out.withColumn("pct", pct).withColumn("verdict", F.when(F.col("pct") <= 5, "PASS").when(F.col("pct") <= 20, "WARN").otherwise("FAIL"))
