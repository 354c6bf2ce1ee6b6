"""Combining several teachers by what they got right on labelled rows.

Choice: one confusion matrix per teacher, shrunk towards equal errors, and a tempered posterior.
Score: the same with errors spread like a normal curve around a bias.  Noul: a logistic
regression on the teachers' log-odds.  Fitted parameters are as large as teachers times
squared options and travel to the rows as literals or a broadcast of that size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.operators.metrics import soft_confusion
from quorumdf.operators.tables import folds
from quorumdf.plans.skew import cut

# Fixed values of the model.
LEAST_ROWS, STRENGTH, FLOOR, CLIP, FOLDS = 30, 4.0, 0.02, 0.005, 5
TEMPERATURES = tuple(round(0.1 * i, 1) for i in range(1, 11))


def shrink(mass: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Row-normalised counts plus ``STRENGTH`` observations of ``shape``, never below ``FLOOR / k``."""
    theta = mass + STRENGTH * shape
    theta = theta / theta.sum(axis=1, keepdims=True)
    return (1 - FLOOR) * theta + FLOOR / len(theta)


def one_coin(mass: np.ndarray) -> np.ndarray:
    """The shape of a teacher with one accuracy and equal errors."""
    k = len(mass)
    a = (np.trace(mass) + 1) / (mass.sum() + 2)
    return np.where(np.eye(k) > 0, a, (1 - a) / max(1, k - 1))


def bell(k: int, bias: float, spread: float) -> np.ndarray:
    g, s = np.mgrid[0:k, 0:k]
    w = np.exp(-((s - g - bias) ** 2) / (2 * spread**2)) + 1e-300
    return w / w.sum(axis=1, keepdims=True)


def fit_bell(mass: np.ndarray) -> np.ndarray:
    """The normal-curve shape (bias, ln spread) of largest penalised likelihood, by a narrowing grid."""
    k = len(mass)

    def loss(b: float, t: float) -> float:
        theta = (1 - FLOOR) * bell(k, b, math.exp(t)) + FLOOR / k
        return -(mass * np.log(theta)).sum() + 0.5 * b * b + 0.5 * t * t

    low, high = [-float(k), math.log(0.2)], [float(k), math.log(k)]
    best = (0.0, 0.0)
    for _ in range(12):
        axes = [np.linspace(a, b, 13) for a, b in zip(low, high)]
        best = min(((b, t) for b in axes[0] for t in axes[1]), key=lambda x: loss(*x))
        widths = [(b - a) / 6 for a, b in zip(low, high)]
        low = [max(l0, x - w) for l0, x, w in zip((-float(k), math.log(0.2)), best, widths)]
        high = [min(h0, x + w) for h0, x, w in zip((float(k), math.log(k)), best, widths)]
    return bell(k, best[0], math.exp(best[1]))


def fit(votes: DataFrame, gold: DataFrame, keys: list[str], question: str, k: int, kind: str = "choice") -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """(θ of each teacher, log prior) from one aggregate of k² sums per teacher; None below ``LEAST_ROWS`` labelled rows or with one class."""
    truth = gold.filter(F.col("question") == question)
    seen = votes.filter(F.col("question") == question).join(truth, [*keys, "question"])
    prior = {r["y"]: r["n"] for r in truth.join(seen.select(*keys).distinct(), keys, "left_semi").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(prior.values())
    if n < LEAST_ROWS or len(prior) < 2:
        return None
    theta: dict[str, np.ndarray] = {}
    for r in soft_confusion(votes.filter(F.col("question") == question), truth, keys).collect():
        theta.setdefault(r["teacher"], np.zeros((k, k)))[r["y"], r["option_idx"]] += r["mass"]
    shape = fit_bell if kind == "score" else one_coin
    return {t: shrink(m, shape(m)) for t, m in sorted(theta.items())}, np.log([(prior.get(i, 0) + 1) / (n + k) for i in range(k)])


def posterior(votes: DataFrame, keys: list[str], question: str, model: tuple[dict[str, np.ndarray], np.ndarray] | None, temperature: float = 1.0) -> DataFrame:
    """(keys, question, p, n): softmax(prior + T Σ v·ln θ); the plain average without a model.

    Each vote is turned into its k log-likelihoods where it lies; the sums combine before the shuffle.
    """
    rows = votes.filter(F.col("question") == question)
    if model is None:
        from quorumdf.operators.votes import average

        return average(rows, [*keys, "question"])
    theta, prior = model
    k = len(prior)
    table = F.create_map(*[x for t, m in theta.items() for x in (F.lit(t), F.array(*[F.array(*[A.lit(v) for v in row]) for row in np.log(m)]))])
    like = F.transform(F.element_at(table, F.col("teacher")), lambda row: A.total(F.zip_with(row, "p", lambda a, b: a * b)))
    scored = rows.select(*keys, "question", like.alias("l")).filter("l is not null")
    sums = scored.groupBy(*keys, "question").agg(F.count("*").cast("int").alias("n"), *[F.sum(F.get("l", F.lit(i))).alias(f"l{i}") for i in range(k)])
    z = F.array(*[A.lit(prior[i]) + A.lit(temperature) * F.col(f"l{i}") for i in range(k)])
    return sums.select(*keys, "question", A.softmax(z).alias("p"), "n")


def _tempered(t: float):
    return lambda a, b: a + t * b


def pick_temperature(votes: DataFrame, gold: DataFrame, keys: list[str], question: str, k: int, kind: str = "choice") -> tuple[float, list[tuple[float, float]]]:
    """The temperature of smallest held-out loss: per fold, θ from the others; fold means are added; the first of equals wins."""
    truth = folds(gold.filter(F.col("question") == question), keys[0], FOLDS)
    totals = dict.fromkeys(TEMPERATURES, 0.0)
    for fold in range(FOLDS):
        model = fit(votes, truth.filter(F.col("fold") != fold).drop("fold"), keys, question, k, kind)
        if model is None:
            continue
        held = truth.filter(F.col("fold") == fold).drop("fold")
        inside = votes.join(held.select(*keys).distinct(), keys, "left_semi")
        # One pass per fold: the untempered log-likelihoods serve every temperature.
        logs = posterior(inside, keys, question, (model[0], np.zeros(k)), 1.0).select(*keys, F.transform("p", lambda x: F.ln(F.greatest(x, A.lit(1e-300)))).alias("l"))
        prior = F.array(*[A.lit(x) for x in model[1]])
        met = logs.join(held, keys)
        means = met.agg(*[F.avg(A.nll(A.softmax(F.zip_with(prior, "l", _tempered(t))), F.col("y"))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
        for i, t in enumerate(TEMPERATURES):
            totals[t] += means[i] or 0.0
    curve = sorted(totals.items())
    return min(curve, key=lambda x: (round(x[1], 12), x[0]))[0], curve


def pattern(votes: DataFrame, keys: list[str], question: str) -> DataFrame:
    """(keys, pattern): the sorted set of teachers that answered, by which fits are kept apart."""
    rows = votes.filter(F.col("question") == question)
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("teacher")), "+").alias("pattern"))


def combine_by_pattern(votes: DataFrame, gold: DataFrame, keys: list[str], question: str, k: int, kind: str = "choice", temperature: float = 1.0) -> DataFrame:
    """(keys, question, p, n, pattern): rows of one set of answering teachers use a fit on labelled rows that the whole set answered.

    Every set has its own fit.  The labelled rows are summed once per set, teacher and true option; the sums of a set
    and of all sets that contain it make its fit on the driver, and the fits are broadcast: a row per set and teacher.
    """
    from quorumdf.operators.votes import average

    tagged = cut(votes.filter(F.col("question") == question).join(pattern(votes, keys, question), keys))
    truth = gold.filter(F.col("question") == question)
    flat = tagged.join(truth, [*keys, "question"]).select("pattern", "teacher", "y", F.posexplode("p").alias("i", "x"))
    mass: dict[tuple[str, str], np.ndarray] = {}
    for r in flat.groupBy("pattern", "teacher", "y", "i").agg(F.sum("x").alias("x")).collect():
        mass.setdefault((r["pattern"], r["teacher"]), np.zeros((k, k)))[r["y"], r["i"]] += r["x"]
    labelled: dict[str, np.ndarray] = {}
    for r in truth.join(tagged.select(*keys, "pattern").distinct(), keys).groupBy("pattern", "y").agg(F.count("*").alias("n")).collect():
        labelled.setdefault(r["pattern"], np.zeros(k))[r["y"]] += r["n"]
    sets = {r["pattern"]: frozenset(r["pattern"].split("+")) for r in tagged.select("pattern").distinct().collect()}
    shape = fit_bell if kind == "score" else one_coin
    fits, plain = [], []
    for name, teachers in sorted(sets.items()):
        above = [x for x in labelled if teachers <= sets[x]]
        count = sum((labelled[x] for x in above), np.zeros(k))
        if count.sum() < LEAST_ROWS or (count > 0).sum() < 2:
            plain.append(name)
            continue
        prior = np.log((count + 1) / (count.sum() + k)).tolist()
        for t in sorted(teachers):
            m = sum((mass[x, t] for x in above if (x, t) in mass), np.zeros((k, k)))
            fits.append((name, t, np.log(shrink(m, shape(m))).tolist(), prior))
    table = votes.sparkSession.createDataFrame(fits, "pattern string, teacher string, theta array<array<double>>, prior array<double>")
    like = F.transform("theta", lambda row: A.total(F.zip_with(row, "p", lambda a, b: a * b)))
    scored = tagged.join(F.broadcast(table), ["pattern", "teacher"]).select(*keys, "question", "pattern", "prior", like.alias("l"))
    sums = scored.groupBy(*keys, "question", "pattern", "prior").agg(F.count("*").cast("int").alias("n"), *[F.sum(F.get("l", F.lit(i))).alias(f"l{i}") for i in range(k)])
    z = F.array(*[F.get("prior", F.lit(i)) + A.lit(temperature) * F.col(f"l{i}") for i in range(k)])
    fitted = sums.select(*keys, "question", A.softmax(z).alias("p"), "n", "pattern")
    rest = average(tagged.filter(F.col("pattern").isin(plain)), [*keys, "question", "pattern"])
    return fitted.unionByName(rest.select(*fitted.columns))


def cross_fit(votes: DataFrame, gold: DataFrame, keys: list[str], question: str, k: int, kind: str = "choice", temperature: float = 1.0) -> DataFrame:
    """(keys, question, p, n) of the labelled rows, each from a fit that has not seen its fold."""
    truth = folds(gold.filter(F.col("question") == question), keys[0], FOLDS)
    out = None
    for fold in range(FOLDS):
        model = fit(votes, truth.filter(F.col("fold") != fold).drop("fold"), keys, question, k, kind)
        held = truth.filter(F.col("fold") == fold).select(*keys).distinct()
        part = posterior(votes.join(held, keys, "left_semi"), keys, question, model, temperature)
        out = part if out is None else out.unionByName(part)
    return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression with an unpenalised intercept, by Newton's method; the last entry is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (w * (p - y)) + penalty * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-10)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def noul_features(votes: DataFrame, keys: list[str], question: str, teachers: list[str]) -> DataFrame:
    """(keys, x): clipped log-odds of P(yes) of each teacher, in order; rows that all of them answered."""
    yes = F.least(F.greatest(F.get("p", F.lit(1)), A.lit(CLIP)), A.lit(1 - CLIP))
    rows = votes.filter((F.col("question") == question) & F.col("teacher").isin(teachers)).select(*keys, "teacher", F.ln(yes / (1 - yes)).alias("z"))
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("teacher") == t, F.col("z"))).alias(f"z{i}") for i, t in enumerate(teachers)])
    return wide.select(*keys, F.array(*[F.col(f"z{i}") for i in range(len(teachers))]).alias("x")).filter(~F.exists("x", lambda v: v.isNull()))


def fit_noul(features: DataFrame, truth: DataFrame, keys: list[str]):
    """Spark ML logistic regression on the stacked log-odds (ridge of C = 1): (coefficients, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = features.join(truth, keys).select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    n = rows.count()
    model = LogisticRegression(regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, family="binomial").fit(rows)
    return [float(v) for v in model.coefficients], float(model.intercept)


def apply_noul(features: DataFrame, coefficients: list[float], intercept: float) -> Column:
    z = A.total(F.zip_with("x", F.array(*map(A.lit, coefficients)), lambda a, b: a * b)) + intercept
    yes = 1 / (1 + F.exp(-z))
    return F.array(1 - yes, yes)


def cascade(first: DataFrame, panel: DataFrame, keys: list[str], limit: float | None) -> tuple[DataFrame, DataFrame]:
    """(settled, asked): answers of the first teacher on documents at or above the limit, the panel's on the others."""
    scores = first.groupBy(*keys).agg(F.min(A.top(F.col("p"))).alias("score"))
    sure = scores.filter(F.col("score") >= limit) if limit is not None else scores.filter("false")
    return first.join(sure.select(*keys), keys, "left_semi"), panel.join(sure.select(*keys), keys, "left_anti")


def cascade_preview(first: DataFrame, panel: DataFrame, keys: list[str], budget: float = 0.05, delta: float = 0.05) -> dict:
    """{threshold, escalated}: on labelled texts, the first teacher's score above which it rarely differs from the panel, and the share of texts below it."""
    from quorumdf.operators.route import document_checks, threshold

    row = threshold(document_checks(first, panel, keys), budget, delta).first()
    return {"threshold": row["threshold"], "escalated": 1.0 - (row["coverage"] or 0.0)}


def summary(votes: DataFrame, gold: DataFrame, keys: list[str], question: str, k: int, kind: str = "choice") -> dict:
    """What the teachers are worth on the labelled rows: accuracy of each and of the combination (out of fold), temperature, influence, pairs."""
    from quorumdf.operators import votes as V

    own = votes.filter(F.col("question") == question)
    truth = gold.filter(F.col("question") == question)
    right = (A.argmax(F.col("p")) == F.col("y")).cast("double")
    each = {r["teacher"]: r["a"] for r in own.join(truth, [*keys, "question"]).groupBy("teacher").agg(F.avg(right).alias("a")).collect()}
    t, _ = pick_temperature(own, truth, keys, question, k, kind)
    held = cross_fit(own, truth, keys, question, k, kind, t).join(truth, [*keys, "question"]).agg(F.avg(right).alias("a"), F.count("*").alias("n")).first()
    return {
        "n_dev": held["n"],
        "accuracy": each,
        "combined": held["a"],
        "temperature": t,
        "influence": {r["teacher"]: r["influence"] for r in V.influence(own, keys, len(each)).collect()},
        "pairs": [r.asDict() for r in V.pairwise(own, keys).collect()],
    }
