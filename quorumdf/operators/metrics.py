"""Scores of predictions against the truth, all as distributed aggregates.

Predictions are (group columns, id, p, y).  Binned and ranked metrics number rows over a
range-partitioned order (:mod:`quorumdf.plans.ranks`), so no group is held by one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.plans.ranks import running, tile
from quorumdf.plans.skew import cut


def stated(df: DataFrame) -> DataFrame:
    """Adds ``conf`` and ``hit``: of two options P(second) and whether it is true, else the top entry and whether it is right."""
    two = F.size("p") == 2
    conf = F.when(two, F.get("p", F.lit(1))).otherwise(A.top(F.col("p")))
    hit = F.when(two, F.col("y") == 1).otherwise(A.argmax(F.col("p")) == F.col("y"))
    return df.withColumn("conf", conf).withColumn("hit", hit.cast("double"))


def binned(df: DataFrame, group: list[str], key: str, bins: int = 10) -> DataFrame:
    """(group, bin, low, high, n, stated, actual): bins of equal size by confidence, rows of equal confidence by key."""
    ranked = running(stated(df).select(*group, key, "conf", "hit"), group, [("conf", True), (key, True)])
    placed = ranked.withColumn("bin", tile(F.col("row_no"), F.col("group_n"), bins))
    return placed.groupBy(*group, "bin").agg(F.min("conf").alias("low"), F.max("conf").alias("high"), F.count("*").alias("n"), F.avg("conf").alias("stated"), F.avg("hit").alias("actual"))


def ece(df: DataFrame, group: list[str], key: str, bins: int = 10) -> DataFrame:
    """(group, ece): mean distance of stated and actual accuracy over the bins, weighted by size."""
    b = binned(df, group, key, bins)
    return b.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("stated") - F.col("actual"))) / F.sum("n")).alias("ece"))


def scoring_rules(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, accuracy, mean_confidence, nll, brier, spherical, rps)."""
    p, y = F.col("p"), F.col("y")
    return stated(df).groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg((A.argmax(p) == y).cast("double")).alias("accuracy"),
        F.avg("conf").alias("mean_confidence"),
        F.avg(A.nll(p, y)).alias("nll"),
        F.avg(A.brier(p, y)).alias("brier"),
        F.avg(A.spherical_loss(p, y)).alias("spherical"),
        F.avg(A.rps(p, y)).alias("rps"),
    )


def murphy(df: DataFrame, group: list[str], key: str, bins: int = 10) -> DataFrame:
    """(group, reliability, resolution, uncertainty, share): the parts of the Brier score, one option against the rest, summed."""
    flat = df.select(*group, key, "y", F.posexplode("p").alias("option_idx", "x")).withColumn("o", (F.col("y") == F.col("option_idx")).cast("double"))
    ranked = running(flat, [*group, "option_idx"], [("x", True), (key, True)])
    b = ranked.withColumn("bin", tile(F.col("row_no"), F.col("group_n"), bins)).groupBy(*group, "option_idx", "bin").agg(F.count("*").alias("n"), F.avg("x").alias("f"), F.avg("o").alias("a"), F.sum("o").alias("s"))
    base = b.groupBy(*group, "option_idx").agg((F.sum("s") / F.sum("n")).alias("base"))
    joined = b.join(base, [*group, "option_idx"])
    per = joined.groupBy(*group, "option_idx").agg(
        (F.sum(F.col("n") * F.pow(F.col("f") - F.col("a"), A.lit(2))) / F.sum("n")).alias("rel"),
        (F.sum(F.col("n") * F.pow(F.col("a") - F.col("base"), A.lit(2))) / F.sum("n")).alias("res"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("unc"),
    )
    out = per.groupBy(*group).agg(F.sum("rel").alias("reliability"), F.sum("res").alias("resolution"), F.sum("unc").alias("uncertainty"))
    return out.withColumn("share", F.when(F.col("uncertainty") > 0, F.col("resolution") / F.col("uncertainty")))


def aurc(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, aurc): mean error over the prefixes by falling confidence; rows of equal confidence by key."""
    rows = df.select(*group, key, A.top(F.col("p")).alias("conf"), (A.argmax(F.col("p")) != F.col("y")).cast("double").alias("err"))
    ranked = running(rows, group, [("conf", False), (key, True)], {"errors": "err"})
    return ranked.groupBy(*group).agg(F.avg(F.col("errors") / F.col("row_no")).alias("aurc"))


def auroc(df: DataFrame, group: list[str], score: str, truth: str) -> DataFrame:
    """(group, auroc): Mann-Whitney with mean ranks for ties; null if one class is absent.

    Equal scores are folded first; what is ranked is one row per distinct score.
    """
    t = F.col(truth).cast("double")
    folded = df.groupBy(*group, score).agg(F.count("*").cast("double").alias("n"), F.sum(t).alias("pos"))
    ranked = running(folded, group, [(score, True)], {"upto": "n"})
    mean_rank = F.col("upto") - (F.col("n") - 1) / 2
    out = ranked.groupBy(*group).agg(F.sum(F.col("pos") * mean_rank).alias("ranks"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return out.select(*group, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auroc"))


def selective(df: DataFrame, group: list[str], coverages: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.5)) -> DataFrame:
    """(group, coverage, threshold, kept, accuracy): accuracy on the most confident rows, cut at the (interpolated) quantile of the confidence."""
    rows = df.select(*group, A.top(F.col("p")).alias("conf"), (A.argmax(F.col("p")) == F.col("y")).cast("double").alias("hit"))
    folded = rows.groupBy(*group, "conf").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    # Equal confidences stand at the places upto - n + 1 .. upto of the ascending order.
    ranked = cut(running(folded, group, [("conf", True)], {"upto": "n"}))
    whole = ranked.groupBy(*group).agg(F.max("upto").alias("rows"))
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group], F.lit(True))
    both = ranked.alias("r").join(whole.alias("w"), same("r", "w"))
    both = both.select("r.*", "w.rows")
    at = [(F.col("rows") - 1) * A.lit(1 - c) for c in coverages]
    inside = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("conf")))
    ends = both.groupBy(*group).agg(F.max("rows").alias("rows"), *[e for i, x in enumerate(at) for e in (inside(F.floor(x)).alias(f"lo{i}"), inside(F.ceil(x)).alias(f"hi{i}"))])
    limits = [F.struct(A.lit(c).alias("coverage"), (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (x - F.floor(x))).alias("cutoff")) for i, (c, x) in enumerate(zip(coverages, at))]
    cuts = ends.select(*group, F.array(*limits).alias("cuts"))
    met = ranked.alias("r").join(cuts.alias("c"), same("r", "c")).select(*[F.col(f"r.{g}") for g in group], "r.conf", "r.n", "r.hits", F.inline("c.cuts")).filter(F.col("conf") >= F.col("cutoff") - 1e-12)
    return met.groupBy(*group, "coverage").agg(F.min("conf").alias("threshold"), F.sum("n").alias("kept"), (F.sum("hits") / F.sum("n")).alias("accuracy"))


def confusion(df: DataFrame, labels: DataFrame, gold: str = "gold", said: str = "said") -> DataFrame:
    """(gold, said, n) on the full grid of labels, with a column for answers outside them (``__invalid__``)."""
    known = labels.select("label").filter("label is not null").distinct()
    counts = df.join(known.withColumnRenamed("label", gold), gold, "left_semi").groupBy(gold, said).agg(F.count("*").alias("n"))
    inside = counts.join(known.select(F.col("label").alias("__known")), F.col(said) == F.col("__known"), "left")
    inside = inside.groupBy(gold, F.coalesce("__known", F.lit("__invalid__")).alias(said)).agg(F.sum("n").alias("n"))
    # The grid is labels times labels, whatever the data: each label is given all others.
    every = known.agg(F.array_append(F.array_sort(F.collect_list("label")), F.lit("__invalid__")).alias("all"))
    grid = known.withColumnRenamed("label", gold).join(F.broadcast(every), F.size("all") > 0).select(gold, F.explode("all").alias(said))
    return grid.join(inside, [gold, said], "left").select(gold, said, F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, labels: DataFrame, gold: str = "gold", said: str = "said") -> DataFrame:
    """(label, precision, recall, f1, support); 0 where undefined; an answer outside the labels is only a miss."""
    tp = F.when(F.col(gold) == F.col(said), 1).otherwise(0)
    truth = df.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("support"), F.sum(tp).alias("tp"))
    claims = df.groupBy(F.col(said).alias("label")).agg(F.count("*").alias("claimed"))
    all_ = labels.select("label").distinct().join(truth, "label", "left").join(claims, "label", "left").na.fill(0, ["support", "tp", "claimed"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(A.lit(0))
    return all_.select("label", ratio(F.col("tp"), F.col("claimed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"), "support")


def macro_f1(df: DataFrame, labels: DataFrame, gold: str = "gold", said: str = "said") -> DataFrame:
    return per_class(df, labels, gold, said).agg(F.avg("f1").alias("macro_f1"))


def soft_confusion(votes: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(teacher, question, y, option_idx, mass): sums of the answered vectors by true option."""
    flat = votes.join(gold, [*keys, "question"]).select("teacher", "question", "y", F.posexplode("p").alias("option_idx", "x"))
    return flat.groupBy("teacher", "question", "y", "option_idx").agg(F.sum("x").alias("mass"))


def chi_square(observed: DataFrame, expected: DataFrame, label: str = "label") -> DataFrame:
    """(statistic, cells): Σ (obs - exp)² / exp of label counts against the shares of another set."""
    share = expected.groupBy(label).agg(F.count("*").alias("e"))
    counts = observed.groupBy(label).agg(F.count("*").alias("o"))
    both = share.join(counts, label, "left").select("e", F.coalesce("o", F.lit(0)).alias("o"))
    sums = both.agg(F.sum("e").alias("E"), F.sum("o").alias("O"), F.sum(F.col("o") * F.col("o") / F.col("e").cast("double")).alias("q"), F.count("*").alias("cells"))
    # Σ (o - e O/E)² / (e O/E) = E/O Σ o²/e - O
    return sums.select((F.col("q") * F.col("E") / F.col("O") - F.col("O")).alias("statistic"), "cells")


def level_errors(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, mae, exact, within_one, mean_score, true_mean) of ordinal answers."""
    level = A.expected_level(F.col("p"))
    near = F.abs(A.argmax(F.col("p")) - F.col("y"))
    return df.groupBy(*group).agg(F.avg(F.abs(level - F.col("y"))).alias("mae"), F.avg((near == 0).cast("double")).alias("exact"), F.avg((near <= 1).cast("double")).alias("within_one"), F.avg(level).alias("mean_score"), F.avg(F.col("y").cast("double")).alias("true_mean"))


def consistency(df: DataFrame, rules: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """(rule, violation, share): ``implies`` A ≤ B, ``same`` A = B, on probability columns of wide rows; share of rows off by more than 0.3."""
    out = []
    for name, (kind, a, b) in rules.items():
        gap = F.greatest(a - b, A.lit(0)) if kind == "implies" else F.abs(a - b)
        out.append(F.struct(F.lit(name).alias("rule"), F.avg(gap).alias("violation"), F.avg((gap > 0.3).cast("double")).alias("share")))
    return df.agg(F.array(*out).alias("x")).select(F.inline("x"))


def bootstrap_macro_f1(spark: SparkSession, cells: DataFrame, labels: list[str], rounds: int = 2000, seed: int = 7) -> DataFrame:
    """(low, high, point): percentile interval of the macro-F1 from resampled confusion cells.

    ``cells`` (gold, said, n) is as large as the grid of labels; a resample of all rows is one multinomial draw of its counts.
    """
    import numpy as np

    rows = cells.collect()
    k = len(labels)
    at = {x: i for i, x in enumerate(labels)}
    grid = np.zeros((k, k + 1), np.int64)
    for r in rows:
        if r["gold"] in at:
            grid[at[r["gold"]], at.get(r["said"], k)] += r["n"]

    def f1(m):
        tp = m[..., range(k), range(k)]
        both = m.sum(-1) + m[..., :k].sum(-2)
        return np.where(both > 0, 2 * tp / np.maximum(both, 1), 0).mean(-1)

    n = int(grid.sum())
    draws = np.random.default_rng(seed).multinomial(n, grid.ravel() / max(1, n), rounds).reshape(rounds, k, k + 1) if n else np.zeros((1, k, k + 1))
    low, high = np.quantile(f1(draws), [0.025, 0.975])
    return spark.createDataFrame([(float(low), float(high), float(f1(grid)))], "low double, high double, point double")


def bootstrap_gap(spark: SparkSession, cells: DataFrame, labels: list[str], first: str = "teacher", second: str = "student", rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(low, high, point): percentile interval of the macro-F1 of ``first`` less that of ``second`` on the same rows.

    ``cells`` (gold, first, second, n) is bounded by the grid of labels; a paired resample is one multinomial draw of its counts.
    """
    import numpy as np

    at = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    rows = [r for r in cells.collect() if r["gold"] in at]
    n = np.array([r["n"] for r in rows], np.int64)
    if not len(n):
        return spark.createDataFrame([(0.0, 0.0, 0.0)], "low double, high double, point double")
    gold = np.array([at[r["gold"]] for r in rows])

    def f1(counts: np.ndarray, column: str) -> np.ndarray:
        said = np.array([at.get(r[column], k) for r in rows])
        truth, claimed, hit = (counts @ np.eye(k + 1)[x] for x in (gold, said, np.where(said == gold, gold, k)))
        both = (truth + claimed)[:, :k]
        return np.where(both > 0, 2 * hit[:, :k] / np.maximum(both, 1), 0).mean(axis=1)

    draws = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), rounds)
    gap = f1(draws, first) - f1(draws, second)
    point = f1(n[None, :], first) - f1(n[None, :], second)
    low, high = np.quantile(gap, [0.025, 0.975])
    return spark.createDataFrame([(float(low), float(high), float(point[0]))], "low double, high double, point double")
