"""A slot for calls that leave the engine: models that generate, translate or judge, and embedders.

The caller hands in a factory; it runs once in each Python worker, and what it returns takes a batch of texts and gives a
reply for each: a text, or a Reply with the tokens that it cost. The engine has no network default. Failures are rows
with an error, never lost rows: a batch that fails is tried again text by text, so one bad text costs only itself.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Reply(NamedTuple):
    text: str | None
    prompt_tokens: int = 0
    completion_tokens: int = 0


Batch = Callable[[list[str]], list[str | Reply]]
_made: dict[str, Batch] = {}


def client(name: str, factory: Callable[[], Batch]) -> Batch:
    """What the factory makes, once in a worker. The driver names it: places in memory are used again, names are not."""
    if name not in _made:
        _made[name] = factory()
    return _made[name]


def with_retries(call: Batch, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Batch:
    """The call again after a failure, waiting twice as long each time."""

    def tried(texts: list[str]) -> list[str | Reply]:
        for k in range(attempts):
            try:
                return call(texts)
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(wait * 2**k)
        return []

    return tried


def _alone(call: Batch, text: str, attempts: int, wait: float) -> tuple[Reply, int, str | None]:
    """Reply, failed attempts and last error of one text."""
    error = None
    for k in range(attempts):
        try:
            (said,) = call([text])
            return said if isinstance(said, Reply) else Reply(said), k, None
        except Exception as problem:  # the row says so
            error = f"{type(problem).__name__}: {problem}"
            if k + 1 < attempts:
                time.sleep(wait * 2**k)
    return Reply(None), attempts, error


def respond(rows: DataFrame, text: str, factory: Callable[[], Batch], out: str = "response", attempts: int = 1, wait: float = 1.0) -> DataFrame:
    """rows with `out` and `error` (null where the call succeeded) for each row's text, and what it cost: prompt_tokens,
    completion_tokens, and retries, the attempts at this text alone that failed."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client(name, factory)
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            try:
                said = call(texts)
                if len(said) != len(texts):
                    raise ValueError(f"{len(said)} replies to {len(texts)} texts")
                found = [(s if isinstance(s, Reply) else Reply(s), 0, None) for s in said]
            except Exception:
                found = [_alone(call, t, attempts, wait) for t in texts]
            costs = {"prompt_tokens": [r.prompt_tokens for r, _, _ in found], "completion_tokens": [r.completion_tokens for r, _, _ in found], "retries": [k for _, k, _ in found]}
            yield batch.assign(**{out: [r.text for r, _, _ in found], "error": [e for _, _, e in found]}, **costs)

    return rows.mapInPandas(run, f"{fields}, `{out}` string, error string, prompt_tokens long, completion_tokens long, retries long")


#: What is counted of an agent in a phase.
ACCOUNT = {
    "calls": lambda own: F.count_if(own & F.col("error").isNull()),
    "prompt_tokens": lambda own: F.coalesce(F.sum(F.when(own, F.col("prompt_tokens"))), F.lit(0)),
    "completion_tokens": lambda own: F.coalesce(F.sum(F.when(own, F.col("completion_tokens"))), F.lit(0)),
    "errors": lambda own: F.count_if(own & F.col("error").isNotNull()),
    "retries": lambda own: F.coalesce(F.sum(F.when(own, F.col("retries"))), F.lit(0)),
}


def observed(rows: DataFrame, agents: list[str], phases: list[str]) -> tuple[DataFrame, Observation]:
    """rows (agent, phase, and what respond adds) as they are, and an observation that counts calls, tokens, errors and retries of the named
    agents by phase while an action writes the rows: no second scan, and as many numbers as agents times phases."""
    seen = Observation(f"calls-{uuid.uuid4().hex}")
    own = lambda a, p: (F.col("agent") == agents[a]) & (F.col("phase") == phases[p])
    each = [count(own(a, p)).cast("long").alias(f"{name}_{a}_{p}") for a in range(len(agents)) for p in range(len(phases)) for name, count in ACCOUNT.items()]
    return rows.observe(seen, *each), seen


def accounts(seen: Observation, agents: list[str], phases: list[str]) -> list[tuple]:
    """agent, phase and the counts of ACCOUNT, for what was called at all. To be asked when the rows' action has ended."""
    found = seen.get
    rows = [(agent, phase, *(found[f"{name}_{a}_{p}"] for name in ACCOUNT)) for a, agent in enumerate(agents) for p, phase in enumerate(phases)]
    return [r for r in rows if r[2] or r[5]]
