"""Chat formatting by prefix-target expansion, on DataFrame functions alone.

Every assistant turn becomes an example: the turns before it as context, then its reply, which alone is trainable.
A turn is written `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Control strings inside a text are escaped reversibly: `<|`,
also with backslashes between, gets one backslash more (`<\\|`), so an escaped text never holds `<|`. A role writes
a backslash as `\\s` and a line end as `\\n`. What follows the last reply (or all of a conversation without one)
is an example without a target, so the turns of every conversation can be read back from the output.

A conversation is the unit of the result: its turns meet in one row, as an example of it must hold them. Examples
are as many characters as their prefixes together; that is the method's output, not a join.

Edge cases: a null text or role is empty. Turns with equal or null numbers go by turn (null first), role and text; repeated
rows are turns of their own. Texts of any length are written whole. Columns beside the four that are read can have any names. Rows with a null conv_id are one conversation. An empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start (0-based code points), loss_chars (0: nothing to train on)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    part = lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t.role), F.lit("\n")).alias("head"), escape(t.text).alias("body"), (t.role == TARGET_ROLE).alias("target"))
    whole = whole.select("conv_id", F.transform("turns", part).alias("turns"))
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("turns", i).target | (i == last))
    each = whole.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    goal = F.element_at("turns", F.col("upto"))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto") - 1), lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    each = each.select("conv_id", "example", F.concat(context, goal.head).alias("before"), goal.body.alias("body"), goal.target.alias("target"))
    return each.select(
        "conv_id", "example", F.concat("before", "body", F.lit(END)).alias("formatted"), F.length("before").alias("loss_start"),
        F.when(F.col("target"), F.length("body")).otherwise(0).alias("loss_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples of a conversation say, read back from them: its turns from the longest, its replies under the masks."""
    reply = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    gathered = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", reply.alias("reply")))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    pieces = F.filter(F.split("longest", r"<\|im_end\|>\n"), lambda p: p != "")
    said = lambda p: F.substring(p, len(START) + 1, 2147483647)
    role = lambda p: F.substring_index(said(p), "\n", 1)
    text = lambda p: F.substring(said(p), F.length(role(p)) + 2, F.length(p))
    turns = F.transform(pieces, lambda p: F.concat(unescape_role(role(p)), F.lit("\n"), unescape(text(p)), F.lit("\n")))
    loss = F.array_join(F.transform("replies", lambda r: r.reply), "")
    return gathered.select(
        "conv_id", F.size(pieces).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
