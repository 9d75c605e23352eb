"""The library from the command line.

python -m tideline list
python -m tideline run QUERY FOLDER [OUT]
python -m tideline run_all FOLDER OUT [--queries NAME...] [--dry-run]
python -m tideline drift | validate | fertility | expand CONVERSATIONS OUT [--langs LANG...] [--max-convs N] [--dry-run]
python -m tideline study CONVERSATIONS OUT [--phases NAME...] [--langs LANG...] [--max-convs N] [--dry-run]
python -m tideline sample

run, run_all: a registered query over a folder of tables, shown without OUT; or several, all of them without --queries. The others read JSONL conversations (a pattern of
paths, folders naming tier and language): drift writes turn scores and curve summaries, validate issues and a report,
fertility token ratios to the English texts, expand the texts brought to the longest language's number of words.
study runs the phases of a whole study that OUT/study does not hold yet, and what they need.
--max-convs keeps so many conversations of each tier and language, --dry-run two.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = [
    (0, "user", "How do I plan a week of meals?"),
    (1, "assistant", "[Turn: 1] Start small.\n1. List what you have.\n2. Pick three dishes. [Source: Dietary Guidelines]\n\n[SYS_ACK: ACTIVE]"),
    (2, "user", "And on a budget?"),
    (3, "assistant", "[Turn: 2] Buy in bulk. However, store it well.\n1. Beans\n2. Rice\n\n[SYS_ACK: ACTIVE]"),
    (4, "user", "Thanks."),
    (5, "assistant", "You are welcome."),
]
KEY = ("tier", "lang", "conv_id")
DRY = 2


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def conversations(spark: SparkSession, pattern: str, langs: list[str] | None = None, most: int | None = None) -> DataFrame:
    from tideline.operators.cohorts import first_n
    from tideline.sources import tables

    rows = tables.read_conversations(spark, pattern).withColumn("tier", F.coalesce("tier", F.lit("")))
    if langs:
        rows = rows.where(F.col("lang").isin(langs))
    if most is None:
        return rows
    return rows.join(first_n(rows.select(*KEY).distinct(), ["tier", "lang"], "conv_id", most), list(KEY), "left_semi")


def drift(rows: DataFrame, out: str) -> None:
    from tideline.operators import curves, scoring

    scoring.score_turns(rows, KEY).write.mode("overwrite").parquet(f"{out}/turns")
    turns = rows.sparkSession.read.parquet(f"{out}/turns")
    curves.drift_summary(turns, KEY).write.mode("overwrite").parquet(f"{out}/summary")


def validate(rows: DataFrame, out: str) -> None:
    from tideline.operators import validate as V

    rows = rows.withColumn("conv_id", F.concat_ws("/", *KEY))  # a conversation is one in its tier and language
    V.issues(rows).write.mode("overwrite").parquet(f"{out}/issues")
    V.report(rows, rows.sparkSession.read.parquet(f"{out}/issues")).write.mode("overwrite").parquet(f"{out}/report")


def fertility(rows: DataFrame, out: str) -> None:
    from tideline.functions import tokens
    from tideline.operators import cohorts

    pairs = cohorts.parallel_pairs(rows, ("tier", "conv_id", "msg_idx"))
    count = lambda c: tokens.count_tokens(F.col(c), "whitespace")
    counted = pairs.select("lang", F.lit("whitespace").alias("model"), count("text").alias("tokens"), count("en_text").alias("en_tokens"))
    cohorts.fertility(counted, ["model", "lang"]).write.mode("overwrite").parquet(f"{out}/fertility")


def expand(rows: DataFrame, out: str) -> None:
    from tideline.functions import tokens
    from tideline.operators import expansion

    sized = rows.withColumn("n", tokens.count_tokens(F.col("text"), "whitespace"))
    target = sized.groupBy("tier", "conv_id", "msg_idx").agg(F.max("n").alias("target"))
    both = expansion.expander("cri")(sized.join(target, ["tier", "conv_id", "msg_idx"]))
    both.select(*KEY, "msg_idx", "role", F.col("expanded").alias("text")).write.mode("overwrite").parquet(f"{out}/expanded")


VERBS = {f.__name__: f for f in (drift, validate, fertility, expand)}


def run(name: str, folder: str, out: str | None = None) -> None:
    from tideline.plans import registry

    found = registry.QUERIES[name](session(), folder)
    found.write.mode("overwrite").parquet(out) if out else found.show(50, truncate=60)


def sample(spark: SparkSession) -> None:
    from tideline.operators.curves import curve_summary
    from tideline.operators.scoring import score_turns

    scored = score_turns(spark.createDataFrame([(1, *m) for m in SAMPLE], "conv_id int, msg_idx int, role string, text string"))
    scored.orderBy("turn").show()
    curve_summary(scored, ("conv_id",)).show()


def main(args: list[str]) -> int:
    from tideline.plans import registry

    parser = argparse.ArgumentParser(prog="tideline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=["list", "run", "run_all", "study", "sample", *VERBS])
    parser.add_argument("places", nargs="*")
    parser.add_argument("--queries", nargs="+", choices=sorted(registry.QUERIES), metavar="NAME")
    parser.add_argument("--phases", nargs="+", metavar="NAME")
    parser.add_argument("--langs", nargs="+")
    parser.add_argument("--max-convs", type=int)
    parser.add_argument("--dry-run", action="store_true")
    given = parser.parse_args(args)
    verb, places = given.verb, given.places
    if verb == "list":
        print("\n".join(sorted(registry.QUERIES)))
    elif verb == "sample":
        sample(session())
    elif verb == "run" and len(places) in (2, 3) and places[0] in registry.QUERIES:
        run(places[0], *places[1:])
    elif verb == "run_all" and len(places) == 2:
        for name in given.queries or sorted(registry.QUERIES):
            run(name, places[0], None if given.dry_run else f"{places[1]}/{name}")
    elif verb in VERBS and len(places) == 2:
        most = given.max_convs if given.max_convs is not None else DRY if given.dry_run else None
        VERBS[verb](conversations(session(), places[0], given.langs, most), places[1])
    elif verb == "study" and len(places) == 2:
        from tideline.operators import study

        most = given.max_convs if given.max_convs is not None else DRY if given.dry_run else None
        rows = conversations(session(), places[0], given.langs, most).withColumn("model", F.lit("none"))
        print("\n".join(f"{name}: {done}" for name, done in study.run(rows, f"{places[1]}/study", given.phases)))
    else:
        parser.print_usage()
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
