"""Routing with a guarantee: answer locally only above a score whose disagreement with the teacher is bounded."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.plans.ranks import running


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X ≤ k), summed in logarithms from the largest term down."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    mode = min(k, int((n + 1) * p))
    log_at = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    first = log_at(mode)
    total, term = 1.0, 1.0
    for i in range(mode, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-18 * total:
            break
    term = 1.0
    for i in range(mode + 1, k + 1):
        term *= (n - i + 1) * p / (i * (1 - p))
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, math.exp(first) * total)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound of a rate after ``k`` of ``n``, by bisection."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def lower_bound(k: int, n: int, delta: float) -> float:
    return 0.0 if k == 0 or n == 0 else 1.0 - upper_bound(n - k, n, delta)


def most_errors(n: int, budget: float, delta: float) -> int:
    """The largest number of disagreements among ``n`` that still certifies the budget; -1 if none does.

    The upper bound of k of n is within the budget exactly if P(X ≤ k; n, budget) ≤ delta.
    """
    low, high = -1, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if binomial_cdf(mid, n, budget) <= delta else (low, mid - 1)
    return low


def document_scores(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): the smallest top probability over a document's questions."""
    return answers.groupBy(*keys).agg(F.min(A.top(F.col("p"))).alias("score"))


def document_checks(student: DataFrame, teacher: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, disagree): for every document of the student its smallest top probability over all its questions, as it is
    served, and whether the teacher says otherwise on any question that both answered.

    A document without any answer of the teacher stays, as one without disagreement: it is served all the same, and counts in n.
    """
    said = teacher.filter("p is not null").select(*keys, "question", A.argmax(F.col("p")).alias("truth"))
    both = student.join(said, [*keys, "question"], "left")
    differs = F.coalesce((A.argmax(F.col("p")) != F.col("truth")).cast("int"), F.lit(0))
    return both.groupBy(*keys).agg(F.min(A.top(F.col("p"))).alias("score"), F.max(differs).alias("disagree"))


def threshold(checks: DataFrame, budget: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(budget, delta, n, threshold, coverage, disagreements, bound): one row.

    Scores are tried from the highest down, equal ones together, and the first failure ends the test.
    Disagreements only add up, so that is a filter: keep the scores whose running count stays within what ``n`` rows allow.
    The number of rows above a score decides the bound of the result, not the test, which is fixed at n.
    """
    spark = checks.sparkSession
    n = checks.count()
    allowed = most_errors(n, budget, delta)
    folded = checks.groupBy("score").agg(F.count("*").alias("rows"), F.sum("disagree").alias("bad"))
    ranked = running(folded, [], [("score", False)], {"above": "rows", "errors": "bad"})
    best = ranked.filter(F.col("errors") <= allowed).agg(F.min("score").alias("t"), F.max("above").alias("kept"), F.max("errors").alias("bad")).first()
    kept, bad = int(best["kept"] or 0), int(best["bad"] or 0)
    row = (budget, delta, n, best["t"], kept / n if n else 0.0, bad, round(upper_bound(bad, n, delta), 4) if best["t"] is not None else None)
    return spark.createDataFrame([row], "budget double, delta double, n long, threshold double, coverage double, disagreements long, bound double")


def curve(checks: DataFrame, budgets: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1), delta: float = 0.05) -> DataFrame:
    """:func:`threshold` for several budgets from one ranking."""
    spark = checks.sparkSession
    n = checks.count()
    folded = checks.groupBy("score").agg(F.count("*").alias("rows"), F.sum("disagree").alias("bad"))
    ranked = running(folded, [], [("score", False)], {"above": "rows", "errors": "bad"})
    allowed = {b: most_errors(n, b, delta) for b in budgets}
    aggs = []
    for i, b in enumerate(budgets):
        ok = F.col("errors") <= allowed[b]
        aggs += [F.min(F.when(ok, F.col("score"))).alias(f"t{i}"), F.max(F.when(ok, F.col("above"))).alias(f"k{i}"), F.max(F.when(ok, F.col("errors"))).alias(f"e{i}")]
    got = ranked.agg(*aggs).first()
    rows = []
    for i, b in enumerate(budgets):
        t, kept, bad = got[f"t{i}"], int(got[f"k{i}"] or 0), int(got[f"e{i}"] or 0)
        rows.append((b, delta, n, t, kept / n if n else 0.0, bad, round(upper_bound(bad, n, delta), 4) if t is not None else None))
    return spark.createDataFrame(rows, "budget double, delta double, n long, threshold double, coverage double, disagreements long, bound double")


def naive_threshold(checks: DataFrame, key: str, budget: float = 0.02) -> DataFrame:
    """(budget, threshold): the loosest score whose running rate of disagreement is within the budget, for comparison; it guarantees nothing."""
    ranked = running(checks, [], [("score", False), (key, True)], {"errors": "disagree"})
    return ranked.filter(F.col("errors") / F.col("row_no") <= budget).agg(F.lit(budget).alias("budget"), F.min("score").alias("threshold"))


def rebudget(held: DataFrame, budget: float, delta: float = 0.05) -> DataFrame:
    """A new threshold from stored held-out scores, without training again."""
    return threshold(held, budget, delta)


def local(df: DataFrame, limit: float | None, score: str = "score") -> DataFrame:
    """Adds ``local``: whether a document is answered by the student.  Without a threshold none is."""
    return df.withColumn("local", F.lit(False) if limit is None else F.coalesce(F.col(score) >= F.lit(limit), F.lit(False)))


def routing_check(checks: DataFrame, limit: float | None) -> DataFrame:
    """(n, n_local, coverage, local_error): what a threshold does on other rows."""
    rows = local(checks, limit)
    return rows.agg(F.count("*").alias("n"), F.count_if("local").alias("n_local"), F.avg(F.col("local").cast("double")).alias("coverage"), F.avg(F.when(F.col("local"), F.col("disagree").cast("double"))).alias("local_error"))
