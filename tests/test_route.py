import numpy as np
import pytest

from quorumdf.operators import route as R


def test_bounds():
    assert R.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert R.upper_bound(5, 5, 0.05) == 1.0 and R.lower_bound(0, 9, 0.05) == 0.0
    for k, n in ((0, 10), (3, 50), (20, 400)):
        assert R.binomial_cdf(k, n, R.upper_bound(k, n, 0.05)) == pytest.approx(0.05, abs=1e-9)
    assert R.binomial_cdf(10, 20, 0.5) == pytest.approx(0.5880985, abs=1e-6)


def test_first_size_that_certifies_two_percent():
    assert next(n for n in range(1, 400) if R.most_errors(n, 0.02, 0.05) >= 0) == 149
    for n in (50, 149, 300, 800):
        k = R.most_errors(n, 0.05, 0.05)
        assert k < 0 or R.upper_bound(k, n, 0.05) <= 0.05 + 1e-9
        assert R.upper_bound(k + 1, n, 0.05) > 0.05


def loop(scores, bad, budget, delta):
    """The sequential test, one distinct score after another."""
    best, errors = None, 0
    for s in sorted(set(scores), reverse=True):
        errors += sum(b for x, b in zip(scores, bad) if x == s)
        if R.upper_bound(errors, len(scores), delta) > budget:
            break
        best = s
    return best


@pytest.mark.parametrize("seed", range(3))
def test_threshold_equals_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(0, 40, 500) / 40
    bad = (rng.random(500) > 0.7 + 0.3 * scores).astype(int)
    rows = spark.createDataFrame([(i, float(s), int(b)) for i, (s, b) in enumerate(zip(scores, bad))], "id long, score double, disagree int")
    got = R.threshold(rows, 0.1, 0.05).first()
    assert got["threshold"] == loop(list(scores), list(bad), 0.1, 0.05)
    assert [r["threshold"] for r in R.curve(rows, (0.1, 0.3)).orderBy("budget").collect()] == [loop(list(scores), list(bad), b, 0.05) for b in (0.1, 0.3)]
    assert got["bound"] is None or got["bound"] <= 0.1


def test_documents_are_scored_as_they_are_served(spark):
    """The score is over all heads; a document that the teacher left unanswered, in part or whole, still counts."""
    p = lambda x: [x, 1 - x]
    student = spark.createDataFrame([(1, "a", p(0.9)), (1, "b", p(0.6)), (2, "a", p(0.8)), (2, "b", p(0.7)), (3, "a", p(0.55)), (3, "b", p(0.95))], "id long, question string, p array<double>")
    teacher = spark.createDataFrame([(1, "a", p(0.2)), (2, "a", p(0.9)), (2, "b", None), (9, "a", p(0.1))], "id long, question string, p array<double>")
    got = {r["id"]: (r["score"], r["disagree"]) for r in R.document_checks(student, teacher, ["id"]).collect()}
    assert got == {1: (0.6, 1), 2: (0.7, 0), 3: (0.55, 0)}


def test_over_budget_draws_stay_below_delta(spark):
    """Documents of several questions, some unanswered: how often a certified threshold lets more disagreement through than budgeted."""
    rng, over, draws = np.random.default_rng(3), 0, 400
    budget, delta = 0.05, 0.05

    def panel(n):
        top = 0.5 + rng.random((n, 3)) / 2
        answered = rng.random((n, 3)) < 0.8
        wrong = (rng.random((n, 3)) < 0.25 * (1 - top)) & answered
        return top.min(axis=1), wrong.any(axis=1)

    score, bad = panel(400_000)
    order = np.argsort(-score)
    rate = np.cumsum(bad[order]) / len(score)  # local and wrong, of all documents
    for _ in range(draws):
        s, b = panel(300)
        at = np.argsort(-s)
        kept = (np.cumsum(b[at]) <= R.most_errors(300, budget, delta)).sum()
        if kept:
            over += rate[max(0, np.searchsorted(-score[order], -s[at][kept - 1], side="right") - 1)] > budget
    assert over / draws <= delta + 0.02


def test_nothing_is_local_without_a_threshold(spark):
    rows = spark.createDataFrame([(1, 0.9, 1)], "id long, score double, disagree int")
    got = R.threshold(rows).first()
    assert got["threshold"] is None and got["coverage"] == 0
    assert not R.local(rows, None).first()["local"]
    empty = R.threshold(rows.filter("false")).first()
    assert empty["n"] == 0 and empty["threshold"] is None


def test_guarantee_holds_in_simulation():
    rng, over = np.random.default_rng(1), 0
    for _ in range(300):
        score = rng.random(300)
        bad = rng.random(300) < 0.12 * (1 - score)
        order = np.argsort(-score)
        errors = np.cumsum(bad[order])
        k = R.most_errors(300, 0.04, 0.05)
        kept = (errors <= k).sum()
        if kept:
            t = score[order][kept - 1]
            # The true share of all rows that are local and disagree: the integral of 0.12 (1 - s) from t to 1.
            over += 0.06 * (1 - t) ** 2 > 0.04
    assert over / 300 <= 0.08


def test_no_budget_no_errors():
    assert R.most_errors(10, 0.0, 0.05) == -1
