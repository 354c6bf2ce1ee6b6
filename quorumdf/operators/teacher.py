"""Asking teachers: each distinct text once, only what the store does not hold, results written before use."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumdf.functions.text import cache_key, parse_answers, parse_label
from quorumdf.operators.tables import keep_last
from quorumdf.plans.skew import cut, path_exists

WAITS = (2, 8, 30)
ANSWER_TOKENS = 12


class Store:
    """An append-only table of replies by key; the last one written counts.  A plain folder of parquet files."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        shape = "key string, response string, model string, created_at timestamp"
        if not path_exists(self.spark, self.path):  # nothing was written yet; any other failure to read is an error, else all would be asked again
            return self.spark.createDataFrame([], shape)
        return keep_last(self.spark.read.schema(shape).parquet(self.path), ["key"], "created_at")

    def put(self, rows: DataFrame) -> None:
        rows.select("key", "response", "model", F.current_timestamp().alias("created_at")).write.mode("append").parquet(self.path)

    def misses(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.read().select("key"), "key", "left_anti")

    def get(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.read().select("key", "response"), "key", "left")


def temperature(votes: int) -> float:
    return 0.0 if votes == 1 else 0.7


def patiently(call: Callable[[str, str], str], waits: tuple[float, ...] = WAITS, transient: tuple = (ConnectionError, TimeoutError)) -> Callable[[str, str], str]:
    """Retry transient failures after the given waits, with jitter; any other failure passes through."""

    def run(prompt: str, text: str) -> str:
        for wait in (*waits, None):
            try:
                return call(prompt, text)
            except transient:
                if wait is None:
                    raise
                time.sleep(wait * random.uniform(0.75, 1.25))
        raise AssertionError

    return run


def ask(texts: DataFrame, call: Callable[[str, str], str], model: str, prompt: str, store: Store, votes: int = 1, tasks: int = 8) -> DataFrame:
    """(text, vote_idx, response): replies to each distinct text, ``votes`` each.

    Known keys are read from the store; the rest is asked in ``tasks`` parallel streams and written to the
    store before anything reads it, so a re-run or a second branch never asks again.
    """
    keys = texts.select("text").filter("text is not null").distinct().select("text", F.explode(F.sequence(F.lit(0), F.lit(votes - 1))).alias("vote_idx"))
    wanted = keys.withColumn("key", cache_key(F.lit(model), F.lit(prompt), F.col("text"), F.lit(f"{temperature(votes):g}"), F.col("vote_idx"), F.lit(0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "response": [call(prompt, t) for t in frame["text"]], "model": model})

    new = store.misses(wanted).repartition(tasks, "key").mapInPandas(run, "key string, response string, model string")
    store.put(new)
    return store.get(wanted).select("text", "vote_idx", "response")


def label_texts(texts: DataFrame, call, model: str, prompt: str, labels: list[str], store: Store, votes: int = 1) -> DataFrame:
    """``texts`` with label and confidence: majority of the votes, fanned out to repeated texts."""
    from quorumdf.operators.votes import majority

    ballots = ask(texts, call, model, prompt, store, votes).withColumn("label", parse_label(F.col("response"), labels))
    return texts.join(majority(ballots, ["text"], "label", "vote_idx"), "text", "left")


def judge_texts(texts: DataFrame, call, model: str, prompt: str, questions: DataFrame, store: Store) -> DataFrame:
    """(text, question, p): all questions of a text in one call; a question the reply leaves out has a null vector."""
    asked = json.dumps([{"id": r["question"], "kind": r["kind"], "options": list(r["options"])} for r in questions.select("question", "kind", "options").orderBy("question").collect()])
    replies = cut(ask(texts, call, model, prompt, store).withColumn("got", parse_answers(F.col("response"), F.lit(asked))).select("text", "got"))
    ids = F.array(*[F.lit(q["id"]) for q in json.loads(asked)])
    flat = replies.select("text", F.explode(ids).alias("question"), "got")
    return flat.select("text", "question", F.element_at("got", F.col("question")).alias("p"))


def estimate(texts: DataFrame, prompt: str, price_in: float | None, price_out: float | None, votes: int = 1, store: Store | None = None, model: str = "") -> DataFrame:
    """(calls, prompt_tokens, answer_tokens, cost): what is not in the store yet, at four characters a token; an unknown price gives a null cost."""
    keys = texts.select("text").filter("text is not null").distinct().select("text", F.explode(F.sequence(F.lit(0), F.lit(votes - 1))).alias("vote_idx"))
    if store is not None:
        keys = store.misses(keys.withColumn("key", cache_key(F.lit(model), F.lit(prompt), F.col("text"), F.lit(f"{temperature(votes):g}"), F.col("vote_idx"), F.lit(0))))
    sums = keys.agg(F.count("*").alias("calls"), F.coalesce(F.floor(F.sum(F.lit(len(prompt)) + F.length("text")) / 4), F.lit(0)).alias("prompt_tokens"))
    sums = sums.withColumn("answer_tokens", F.col("calls") * ANSWER_TOKENS)
    cost = F.lit(None).cast("double") if price_in is None or price_out is None else F.round(F.col("prompt_tokens") * F.lit(price_in) + F.col("answer_tokens") * F.lit(price_out), 4)
    return sums.withColumn("cost", cost)
