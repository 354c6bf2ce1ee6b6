"""Consensus from several annotators: a competence-and-spamming mixture, fitted by expectation-maximisation.

Each label is either truthful (with the annotator's competence) or drawn from the annotator's
personal guess distribution.  Two additions make it fit annotators that plain guessing
does not describe.  The guess distribution may depend on the true option, drawn towards the
annotator's overall one by ``GUESS_PULL`` observations; an annotator that errs on purpose or mixes
up two options is then informative.  Annotators that repeat another's errors share one vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumdf.plans.skew import cut

ITERATIONS = 40
TOLERANCE = 1e-3
GUESS_PULL = 5.0
#: Agreement of two annotators beyond what their accuracies explain (0 to 1) from which they count as one voice.
ECHO = 0.5
ECHO_ROUNDS = 8
MOST_OPTIONS = 512
#: Model parameters are kept on the driver; they grow with annotators times squared options, not with data.
MOST_ANNOTATORS = 2_000
#: Questions times annotators times squared options, at most; more is an error.
MOST_CELLS = 4_000_000
#: Items that two annotators must both have answered before one can be found to echo the other.
LEAST_COMMON = 30


def annotator_name(column: Column) -> Column:
    """One spelling of a model: no vendor prefix, blanks or capitals."""
    return F.regexp_replace(F.lower(column), r"^.*/|[\s ]+", "")


def usable_label(probs: Column, options: Column) -> Column:
    """Index of the largest probability (the first of equals); null unless a list of finite numbers, one per option, of positive sum."""
    values = F.from_json(probs, "array<double>")
    sound = (
        probs.rlike(r"^\s*\[.*\]\s*$")
        & (F.size(values) == F.size(options))
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & (F.aggregate(values, F.lit(0.0), lambda a, x: a + x) > 0)
    )
    return F.when(sound, F.array_position(values, F.array_max(values)).cast("int") - 1)


def votes(answers: DataFrame, questions: DataFrame, item: str = "pool_id") -> DataFrame:
    """(``item``, question, votes array<struct<model, label>>), one row per item and question with a usable answer.

    Of the answers of one model to one item the latest ``created_at`` counts (of equal times the
    larger label, so the choice never depends on row order; a null time is before all others); it counts even if
    it is unusable.  Deliveries are folded together before the shuffle, so an item that was
    answered very often is no hot key.  Answers with a null item, question or model count for nothing.
    """
    if not questions.filter(F.size("options") >= MOST_OPTIONS).isEmpty():
        raise ValueError(f"a question has {MOST_OPTIONS} options or more")
    kinds = questions.filter("question is not null and size(options) > 0").groupBy("question").agg(F.max("options").alias("options"))
    # Time and label are one number, so that the latest is found by a hash aggregate on plain longs.
    when = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 53)))
    rows = (
        answers.select(item, "question", annotator_name(F.col("model")).alias("model"), "probs", "created_at")
        .filter(f"{item} is not null and question is not null and model is not null")
        .join(kinds, "question")
        .select(item, "question", "model", (when * MOST_OPTIONS + F.coalesce(usable_label(F.col("probs"), F.col("options")) + 1, F.lit(0))).alias("said"))
    )
    latest = rows.groupBy(item, "question", "model").agg(F.max("said").alias("said")).select(item, "question", "model", (F.pmod("said", F.lit(MOST_OPTIONS)) - 1).cast("int").alias("label"))
    return latest.filter("label >= 0").groupBy(item, "question").agg(F.array_sort(F.collect_list(F.struct("model", "label"))).alias("votes"))


@dataclass
class Model:
    """Fitted parameters.  Arrays are (question, annotator, true option, said option), padded to the most options."""

    questions: list[str]
    annotators: list[str]
    options: list[list[str]]
    share: np.ndarray  # of each option
    competence: np.ndarray  # (question, annotator)
    guess: np.ndarray
    seen: np.ndarray  # (question, annotator)
    echo: np.ndarray  # group of each annotator
    rounds: int = 0
    plain: bool = False  # guesses that do not depend on the true option, no echoes

    @property
    def chance(self) -> np.ndarray:
        """P(said | true) of each annotator."""
        c = self.competence[..., None, None]
        return c * np.eye(self.share.shape[1]) + (1 - c) * self.guess

    def posterior(self, q: np.ndarray, row: np.ndarray, who: np.ndarray, said: np.ndarray, n: int) -> np.ndarray:
        """P(true | votes) of ``n`` rows; the votes are flat with their ``row``, in order of it."""
        log_chance = np.log(self.chance + 1e-9)
        weight = self.weights(row, who)
        scores = np.log(self.share + 1e-12)[q]
        np.add.at(scores, row, weight[:, None] * log_chance[q[row], who, :, said])
        scores = np.exp(scores - scores.max(axis=1, keepdims=True)) * (self.share[q] > 0)
        return scores / scores.sum(axis=1, keepdims=True)

    def weights(self, row: np.ndarray, who: np.ndarray) -> np.ndarray:
        """One over the number of votes that a vote's echo group has on its item."""
        code = row * (len(self.annotators) + 1) + self.echo[who]
        _, at, count = np.unique(code, return_inverse=True, return_counts=True)
        return 1.0 / count[at]


def _flat(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = frame["who"].map(len).to_numpy()
    return np.repeat(np.arange(len(frame)), size), np.concatenate(frame["who"].to_numpy()), np.concatenate(frame["said"].to_numpy())


def _counts(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(model.guess)
        for frame in frames:
            if len(frame):
                q = frame["q"].to_numpy()
                row, who, said = _flat(frame)
                post = model.posterior(q, row, who, said, len(frame)) * frame["n"].to_numpy()[:, None]
                np.add.at(total, (q[row], who, slice(None), said), post[row])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "x": total.ravel()[at]})

    return run


def _pair_counts(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chance, out = model.chance, []
        for frame in frames:
            if not len(frame):
                continue
            q, n = frame["q"].to_numpy(), frame["n"].to_numpy()
            row, who, said = _flat(frame)
            post = model.posterior(q, row, who, said, len(frame))
            size = np.bincount(row, minlength=len(frame))
            start = np.cumsum(size) - size
            for gap in range(1, int(size.max())):  # votes that stand ``gap`` apart on one item
                left = np.flatnonzero(np.arange(len(row)) - start[row] + gap < size[row])
                right = left + gap
                i = row[left]
                expected = np.einsum("nt,nts,nts->n", post[i], chance[q[i], who[left]], chance[q[i], who[right]])
                out.append(pd.DataFrame({"a": who[left], "b": who[right], "n": n[i] * 1.0, "same": n[i] * (said[left] == said[right]), "expected": n[i] * expected}))
        if out:
            yield pd.concat(out).groupby(["a", "b"], as_index=False).sum()

    return run


def _step(model: Model, total: np.ndarray) -> float:
    """Maximisation: new parameters from the expected counts; returns the largest change of a competence."""
    k = total.shape[-1]
    truthful = total * (model.competence[..., None, None] * np.eye(k) / (model.chance + 1e-12))
    guessed = total - truthful
    seen = total.sum(axis=(2, 3))
    competence = (truthful.sum(axis=(2, 3)) + 0.5) / (seen + 1.0)
    allowed = (model.share > 0)[:, None, :] * 1.0
    overall = (guessed.sum(axis=2) + 0.1) * allowed
    overall /= overall.sum(axis=-1, keepdims=True)
    guess = guessed * (not model.plain) + GUESS_PULL * overall[:, :, None, :]
    model.guess = guess / guess.sum(axis=-1, keepdims=True)
    change = float(np.abs(competence - model.competence).max(initial=0.0))
    model.competence, model.seen = competence, seen
    share = total.sum(axis=1).sum(axis=-1)  # weighted by votes; options of a question only
    share = (share + 1.0) * allowed[:, 0, :]
    model.share = share / share.sum(axis=1, keepdims=True)
    return change


def _echo_groups(n: int, pairs: pd.DataFrame) -> np.ndarray:
    group = np.arange(n)

    def root(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    excess = (pairs["same"] - pairs["expected"]) / np.maximum(pairs["n"] - pairs["expected"], 1e-9)
    for a, b in pairs.loc[(excess >= ECHO) & (pairs["n"] >= LEAST_COMMON), ["a", "b"]].to_numpy():
        group[root(int(b))] = root(int(a))
    return np.array([root(x) for x in range(n)])


def fit(voted: DataFrame, questions: DataFrame, iterations: int = ITERATIONS, plain: bool = False) -> Model:
    """Fit the mixture to ``voted`` (see :func:`votes`) by full passes over all items.

    ``plain`` is the textbook form: an annotator's guesses do not depend on the true option and every vote counts alike.

    Items with the same votes are one weighted row, combined before the shuffle.  A pass sends back
    one sum per parameter; neither items nor posteriors reach the driver.
    """
    kinds = {r[0]: list(r[1]) for r in questions.filter("question is not null and size(options) > 0").groupBy("question").agg(F.max("options")).collect()}
    patterns = cut(voted.groupBy("question", "votes").agg(F.count("*").alias("n")))
    names = [r[0] for r in patterns.select(F.explode("votes.model").alias("m")).distinct().orderBy("m").take(MOST_ANNOTATORS + 1)]
    if len(names) > MOST_ANNOTATORS:
        raise ValueError(f"more than {MOST_ANNOTATORS} annotators")
    model = start(sorted(kinds), names, [kinds[q] for q in sorted(kinds)])
    model.plain = plain
    coded = cut(code(patterns, model, "n"))
    for k in range(iterations):
        if k == ECHO_ROUNDS and not plain:
            pairs = coded.mapInPandas(_pair_counts(model), "a int, b int, n double, same double, expected double").groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "same", "expected"))).toPandas()
            model.echo = _echo_groups(len(names), pairs)
        sums = coded.mapInPandas(_counts(model), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(model.guess.size)
        total[sums["at"].to_numpy()] = sums["x"].to_numpy()
        change = _step(model, total.reshape(model.guess.shape))
        model.rounds = k + 1
        if k > ECHO_ROUNDS and change < TOLERANCE:
            break
    return model


def start(questions: list[str], annotators: list[str], options: list[list[str]]) -> Model:
    most = max(map(len, options), default=1)
    q, j = len(questions), len(annotators)
    if q * j * most * most > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of questions, annotators and squared options")
    share = np.array([[1.0 / len(o)] * len(o) + [0.0] * (most - len(o)) for o in options]).reshape(q, most)
    guess = np.broadcast_to(share[:, None, None, :], (q, j, most, most)).copy()
    return Model(questions, annotators, options, share, np.full((q, j), 0.5), guess, np.zeros((q, j)), np.arange(j))


def code(voted: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Votes with numbers in place of names."""
    spark = voted.sparkSession
    ids = {name: i for i, name in enumerate(model.annotators)}
    asked = {name: i for i, name in enumerate(model.questions)}
    shared = spark.sparkContext.broadcast(ids)
    types = dict(voted.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[list(keep)].copy()
            out["q"] = frame["question"].map(asked).astype(np.int32)
            out["who"] = [np.array([shared.value[v["model"]] for v in vs], np.int32) for vs in frame["votes"]]
            out["said"] = [np.array([v["label"] for v in vs], np.int32) for vs in frame["votes"]]
            yield out

    return voted.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", q int, who array<int>, said array<int>")


def decide(voted: DataFrame, model: Model, item: str = "pool_id") -> DataFrame:
    """(``item``, question, answer, confidence, agreement, answers): the consensus of every item.

    ``confidence`` is the posterior of the answer, ``agreement`` the share of the votes (echoes counting once)
    that named it.  Of equally likely options the first in the question's order wins.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            q = frame["q"].to_numpy()
            row, who, said = _flat(frame)
            post = model.posterior(q, row, who, said, len(frame))
            best = post.argmax(axis=1)
            weight = model.weights(row, who)
            agree = np.bincount(row, weight * (said == best[row]), len(frame)) / np.bincount(row, weight, len(frame))
            yield pd.DataFrame(
                {item: frame[item], "question": [model.questions[x] for x in q], "answer": [model.options[a][b] for a, b in zip(q, best)], "confidence": post[np.arange(len(q)), best], "agreement": agree, "answers": np.bincount(row, minlength=len(frame)).astype(np.int32)}
            )

    shape = f"{item} {dict(voted.dtypes)[item]}, question string, answer string, confidence double, agreement double, answers int"
    return code(voted, model, item).mapInPandas(run, shape)


def consensus(answers: DataFrame, questions: DataFrame, item: str = "pool_id", plain: bool = False) -> DataFrame:
    """The agreed option of every item and question with a usable answer, see :func:`decide` and, for ``plain``, :func:`fit`."""
    voted = cut(votes(answers, questions, item))
    return decide(voted, fit(voted, questions, plain=plain), item)


def reliability(answers: DataFrame, questions: DataFrame, item: str = "pool_id") -> DataFrame:
    """(question, model, reliability, accuracy, guesses, answers, echo_of): what the fit says of each annotator.

    ``accuracy`` is the chance of a right label and ``reliability`` how far it is above that of an annotator who says the same
    labels without looking (1: always right, 0: no better than that, below 0: worse).  Both come from the chances of each label
    given the true option, which the votes identify; how these split into competence and guesses is not identified where guesses
    may depend on the true option, so no competence is reported.  ``guesses`` is the distribution of labels that were guessed,
    ``echo_of`` the first of the annotators that vote as one with it; below ``LEAST_COMMON`` common items no echo is looked for.
    """
    voted = cut(votes(answers, questions, item))
    model = fit(voted, questions)
    rows = []
    for i, q in enumerate(model.questions):
        k = len(model.options[i])
        for j, name in enumerate(model.annotators):
            if model.seen[i, j] > 0:
                right = float(model.share[i, :k] @ model.chance[i, j].diagonal()[:k])
                said = (model.share[i][:, None] * model.chance[i, j]).sum(axis=0)[:k]
                luck = float(model.share[i, :k] @ said)
                guesses = (model.share[i][:, None] * model.guess[i, j]).sum(axis=0)[:k]
                rows.append((q, name, (right - luck) / max(1e-9, 1 - luck), right, [float(x) for x in guesses], int(round(model.seen[i, j])), model.annotators[model.echo[j]]))
    return answers.sparkSession.createDataFrame(rows, "question string, model string, reliability double, accuracy double, guesses array<double>, answers long, echo_of string")
