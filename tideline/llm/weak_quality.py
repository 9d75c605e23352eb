"""Quality classifier from weak labels: a label model over heuristic labellers, and a hashed linear scorer.

Labellers are column expressions that vote bad (1) or good (0) on a whole text, in two aspects: low quality and toxic. The
label model counts the vote patterns of all documents in Spark (at most 2 to the number of labellers, whatever the corpus) and runs
expectation-maximisation over them: each labeller's rate of bad votes on bad and on good documents, the share of bad ones, and so the
posterior of a pattern. A training sample, of at most TRAIN_ROWS documents expected, drawn by a hash of id and text, holds each
document as a bad one by the weight of its posterior and as a good one by what is left of it, so a doubtful label teaches little;
a logistic regression with an L1 penalty over hashed tokens learns from it and scores every document. Texts are read once:
votes and hashed tokens are stored, and all that follows reads those.

Edge cases: texts of any length are read whole; a document has as many features as distinct tokens. Only doc_id (a whole number)
and text are read, so other columns can have any names. A null text is empty: it has no tokens, gets the scorer's prior, and is not kept, as nothing can be learnt from
it. Repeated rows count each. Where all labels of an aspect agree, the posterior of that label is everybody's score. An
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored

#: Documents that train a scorer, as expected by the sampling.
TRAIN_ROWS = 20_000
BUCKETS = 1 << 17
ROUNDS = 100
L1 = 5e-4
#: Labels of less weight teach nothing.
LEAST_WEIGHT = 1e-3

# Insults, in lists that vote apart.
INSULTS = {
    "insult_mind": (
        "idiot", "idiots", "moron", "morons", "moronic", "stupid", "stupidity", "imbecile", "dumb", "dumbass", "fool", "fools", "foolish", "cretin", "dimwit", "halfwit", "nitwit", "brainless",
        "retard", "retarded", "dummkopf", "dumm", "blöd", "trottel", "estúpido", "tonto", "imbécil", "débile", "stupide", "crétin"),
    "insult_person": (
        "scum", "trash", "loser", "losers", "clown", "clowns", "pig", "pigs", "vermin", "bastard", "bastards", "asshole", "jerk", "creep", "freak", "rat", "rats", "parasite", "parasites", "bitch",
        "whore", "arschloch", "abschaum", "schwein", "basura", "cabrón", "escoria", "connard", "salaud", "ordure"),
    "insult_worth": (
        "worthless", "pathetic", "disgusting", "filthy", "useless", "hateful", "vile", "despicable", "repulsive", "shameful", "revolting", "subhuman", "inferior", "wertlos", "erbärmlich",
        "widerlich", "inútil", "asqueroso", "patético", "dégoûtant", "minable", "pathétique"),
}


def _any_word(words: tuple[str, ...]) -> Column:
    return F.arrays_overlap("tokens", F.array(*map(F.lit, words)))


def _signals(docs: DataFrame) -> DataFrame:
    """text (null: empty), tokens, and the shares that labellers look at."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", text.alias("text"), words.alias("words"))
    n = F.greatest(F.size("words"), F.lit(1))
    return own.select(
        "doc_id", "text", "words", F.size("words").alias("n"),
        (F.regexp_count("text", F.lit(r"[#*$%&|<>]")) / n).alias("symbols"),
        (F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.length("text"), F.lit(1))).alias("capitals"),
        (F.regexp_count("text", F.lit("!")) / n).alias("shouts"),
        (F.regexp_count("text", F.lit(r" [|/>] ")) / n).alias("separators"),
        (F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))) / n).alias("bare_marks"),
        (F.size(F.array_distinct("words")) / n).alias("variety"),
        (F.length("text") / n).alias("length"))


def labellers() -> dict[str, dict[str, Column]]:
    low = {
        "symbols": F.col("symbols") > 0.3,
        "capitals": F.col("capitals") > 0.3,
        "shouts": F.col("shouts") > 0.3,
        "long_words": (F.col("n") >= 20) & (F.col("length") > 7.5),
        "separators": F.col("separators") > 0.2,
        "bare_marks": F.col("bare_marks") > 0.2,
        "repeats": (F.col("n") >= 50) & (F.col("variety") < 0.2),
        "monotone": (F.col("n") >= 20) & (F.col("variety") < 0.1),
    }
    return {"low": low, "toxic": {name: _any_word(words) for name, words in INSULTS.items()}}


@dataclass(frozen=True)
class LabelModel:
    """prior: share of bad documents; rates[labeller, class]: chance of a bad vote on good (0) and bad (1) documents."""

    prior: float
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        bad, good = (votes @ np.log(r) + (1 - votes) @ np.log(1 - r) for r in (self.rates[:, 1], self.rates[:, 0]))
        return 1 / (1 + np.exp(np.clip(good + np.log(1 - self.prior) - bad - np.log(self.prior), -700, 700)))


def fit_labels(votes: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their counts. It starts from the belief that a document
    with a bad vote is likely bad: labellers are written to be right more often than not."""
    p = 1 - 0.9 * 0.2 ** votes.sum(axis=1)
    model = LabelModel(0.5, np.full((votes.shape[1], 2), 0.5))
    for _ in range(rounds):
        bad, good = weight * p, weight * (1 - p)
        rates = np.column_stack([(votes.T @ good + 0.1) / (good.sum() + 1), (votes.T @ bad + 0.5) / (bad.sum() + 1)])
        model = LabelModel(float(np.clip(bad.sum() / max(weight.sum(), 1), 1e-6, 1 - 1e-6)), rates)
        now = model.posterior(votes)
        if np.abs(now - p).max(initial=0) < 1e-9:
            break
        p = now
    return model


def label_models(rows: DataFrame) -> tuple[dict[str, LabelModel], int]:
    """Each aspect's label model, and the number of documents, from prepared() rows."""
    seen = rows.groupBy(*(f"{a}_{name}" for a, some in labellers().items() for name in some)).agg(F.count("*").alias("n"))
    patterns = seen.collect()  # at most 2 ** labellers
    count = np.array([r["n"] for r in patterns], float)
    out = {}
    for aspect, some in labellers().items():
        votes = np.array([[r[f"{aspect}_{name}"] for name in some] for r in patterns], float).reshape(len(patterns), len(some))
        out[aspect] = fit_labels(votes, count)
    return out, int(count.sum())


def posterior_column(aspect: str, model: LabelModel) -> Column:
    """The label model's posterior of a row with the labellers' votes."""
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, (good, bad) in zip(labellers()[aspect], model.rates, strict=True):
        odds = odds + F.when(F.col(f"{aspect}_{name}"), float(np.log(bad / good))).otherwise(float(np.log((1 - bad) / (1 - good))))
    return 1 / (1 + F.exp(-odds))


def _tokens() -> Column:
    """Distinct words and runs of marks, lower case, and a token for each share's step."""
    said = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
    steps = [F.concat(F.lit(f"~{c} "), F.floor(F.col(c) * 10).cast("string")) for c in ("symbols", "capitals", "shouts", "bare_marks", "variety")]
    return F.array_distinct(F.concat(said, F.array(*steps, F.concat(F.lit("~length "), F.floor("length").cast("string")))))


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, n (words), drawn (a hash), a vote of each labeller as ASPECT_LABELLER, and features, as a stored table."""
    votes = [F.coalesce(v, F.lit(False)).alias(f"{a}_{name}") for a, some in labellers().items() for name, v in some.items()]
    rows = _signals(docs).withColumn("tokens", _tokens()).select("doc_id", "n", F.xxhash64("doc_id", "text", F.lit(9)).alias("drawn"), *votes, "tokens")
    return stored(HashingTF(numFeatures=BUCKETS, binary=True, inputCol="tokens", outputCol="features").transform(rows).drop("tokens"), "prepared")


def train(rows: DataFrame, models: dict[str, LabelModel], total: int, most: int = TRAIN_ROWS) -> dict[str, LogisticRegressionModel | float]:
    """A scorer for each aspect, or the posteriors' mean where they all agree. rows: prepared, `total` of them."""
    sample = rows.where(F.pmod("drawn", F.lit(max(1, -(-total // most)))) == 0)
    known = stored(sample.select("features", *(posterior_column(a, m).alias(a) for a, m in models.items())).coalesce(12), "sample")
    ends = known.agg(*(f(a).alias(f"{a}_{f.__name__}") for a in models for f in (F.min, F.avg, F.max))).first()
    out: dict[str, LogisticRegressionModel | float] = {}
    for aspect in models:
        least, mean, most_ = (ends[f"{aspect}_{x}"] for x in ("min", "avg", "max"))
        if mean is None or most_ < LEAST_WEIGHT or least > 1 - LEAST_WEIGHT:
            out[aspect] = float(mean or 0.0)
            continue
        each = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col(aspect).alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col(aspect)).alias("weight"))))
        labelled = known.select("features", each.alias("x")).select("features", "x.label", "x.weight").where(F.col("weight") >= LEAST_WEIGHT)
        fit = LogisticRegression(weightCol="weight", featuresCol="features", regParam=L1, elasticNetParam=1.0, maxIter=40, standardization=False, aggregationDepth=2)
        out[aspect] = fit.fit(labelled)
    return out


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, low and toxic (chances), quality (what is left of both) and kept, a row for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = prepared(docs)
    for aspect, scorer in train(rows, *label_models(rows)).items():
        if isinstance(scorer, float):
            rows = rows.withColumn(aspect, F.lit(scorer))
            continue
        scorer.setProbabilityCol("chance").setRawPredictionCol("").setPredictionCol("")
        rows = scorer.transform(rows).withColumn(aspect, vector_to_array("chance")[1]).drop("chance")
    kept = (F.col("n") > 0) & (F.col("low") < 0.5) & (F.col("toxic") < 0.5)
    return rows.select("doc_id", "low", "toxic", ((1 - F.col("low")) * (1 - F.col("toxic"))).alias("quality"), kept.alias("kept"))
