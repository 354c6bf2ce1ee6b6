"""A second opinion on a head: per-option entailment scores, weighed in log space, kept only where it helps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A

RIDGE, CLIP, MARGIN, LEAST_ROWS = 1e-3, 1e-9, 0.02, 40


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(loss_and_gradient, x: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Gradient descent with halving steps; smooth and small problems only."""
    rate = 1.0
    value, slope = loss_and_gradient(x)
    for _ in range(rounds):
        new = x - rate * slope
        v, g = loss_and_gradient(new)
        if v < value:
            done = value - v < 1e-12
            x, value, slope, rate = new, v, g, rate * 1.5
            if done:
                break
        else:
            rate /= 2
            if rate < 1e-10:
                break
    return x


def fit(head: np.ndarray, second: np.ndarray, y: np.ndarray) -> dict:
    """{bias, weights}: a centred bias per option of the second scores, then the two weights; both of least penalised log loss."""
    logs, other = np.log(np.clip(head, CLIP, 1)), np.log(np.clip(second, CLIP, 1))
    n, k = head.shape
    hot = np.eye(k)[y]

    def bias_loss(b):
        p = _softmax(other + b)
        return -np.log(np.clip(p[np.arange(n), y], 1e-300, 1)).mean() + RIDGE * (b @ b), (p - hot).mean(axis=0) + 2 * RIDGE * b

    bias = _descend(bias_loss, np.zeros(k))
    bias -= bias.mean()
    shifted = other + bias

    def weight_loss(w):
        p = _softmax(w[0] * logs + w[1] * shifted)
        gap = (p - hot) / n
        return -np.log(np.clip(p[np.arange(n), y], 1e-300, 1)).mean() + RIDGE * (w @ w), np.array([(gap * logs).sum(), (gap * shifted).sum()]) + 2 * RIDGE * w

    return {"bias": bias.tolist(), "weights": _descend(weight_loss, np.array([1.0, 0.0])).tolist()}


def combine(head: Column, second: Column, params: dict) -> Column:
    """softmax(w0 ln head + w1 (ln second + bias)); the head alone where there is no second opinion."""
    logs = lambda p: F.transform(p, lambda x: F.ln(F.least(F.greatest(x, A.lit(CLIP)), A.lit(1))))
    w0, w1 = params["weights"]
    shifted = F.zip_with(logs(second), F.array(*map(A.lit, params["bias"])), lambda a, b: a + b)
    return F.when(second.isNull(), head).otherwise(A.softmax(F.zip_with(logs(head), shifted, lambda a, b: a * A.lit(w0) + b * A.lit(w1))))


def combine_numpy(head: np.ndarray, second: np.ndarray, params: dict) -> np.ndarray:
    w0, w1 = params["weights"]
    return _softmax(w0 * np.log(np.clip(head, CLIP, 1)) + w1 * (np.log(np.clip(second, CLIP, 1)) + np.array(params["bias"])))


def keep(before: float | None, after: float | None, rows: int) -> bool:
    """Whether the gain on hand-labelled rows pays: more than ``MARGIN`` on at least ``LEAST_ROWS``."""
    return before is not None and after is not None and rows >= LEAST_ROWS and after - before > MARGIN


def score(docs: DataFrame, key: str, scorer: Callable[[list[str], list[str]], np.ndarray], options: dict[str, dict[str, str]], text: str = "text") -> DataFrame:
    """(key, question, p): the scorer's value of each option's sentence, rows scaled to 1.

    ``scorer(texts, sentences)`` gives a matrix; it runs on batches of each partition.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = list(frame["text"])
            for q, sentences in options.items():
                m = np.clip(np.asarray(scorer(texts, list(sentences.values())), float), CLIP, None) if texts else np.zeros((0, len(sentences)))
                m = m / m.sum(axis=1, keepdims=True)
                yield pd.DataFrame({key: frame[key], "question": q, "p": [row.tolist() for row in m]})

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, question string, p array<double>")
