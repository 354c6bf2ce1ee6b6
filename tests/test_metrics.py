import numpy as np
import pytest

from quorumdf.operators import metrics as M
from quorumdf.plans.ranks import running


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(4), 333).round(2) + 1e-3
    p /= p.sum(1, keepdims=True)
    y = np.array([rng.choice(4, p=v) for v in p])
    df = spark.createDataFrame([("g", i, [float(x) for x in v], int(t)) for i, (v, t) in enumerate(zip(p, y))], "g string, id long, p array<double>, y int")
    return p, y, df


def test_running_sums_equal_a_window(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{rng.integers(3)}", float(rng.integers(20)), i, int(rng.integers(5))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, id long, v int")
    got = {r["id"]: (r["row_no"], r["group_n"], r["s"]) for r in running(df, ["g"], [("x", False), ("id", True)], {"s": "v"}).collect()}
    for g in {r[0] for r in rows}:
        total = 0
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for k, r in enumerate(mine, 1):
            total += r[3]
            assert got[r[2]] == (k, len(mine), total)


def test_ece_equals_equal_mass_bins(scored):
    p, y, df = scored
    conf, hit = p.max(1), (p.argmax(1) == y).astype(float)
    want = sum(len(b) / len(y) * abs(conf[b].mean() - hit[b].mean()) for b in np.array_split(np.argsort(conf, kind="stable"), 10))
    assert M.ece(df, ["g"], "id").first()["ece"] == pytest.approx(want, abs=1e-12)


def test_scoring_rules(scored):
    p, y, df = scored
    r = M.scoring_rules(df, ["g"]).first()
    hot = np.eye(4)[y]
    assert r["brier"] == pytest.approx(((p - hot) ** 2).sum(1).mean())
    assert r["nll"] == pytest.approx(-np.log(p[range(len(y)), y]).mean())
    assert r["rps"] == pytest.approx(((p.cumsum(1) - hot.cumsum(1)) ** 2)[:, :3].sum(1).mean() / 3)


def test_murphy_adds_up_with_one_row_bins(scored):
    p, y, df = scored
    m = M.murphy(df, ["g"], "id", bins=len(y)).first()
    assert m["reliability"] - m["resolution"] + m["uncertainty"] == pytest.approx(((p - np.eye(4)[y]) ** 2).sum(1).mean(), abs=1e-9)


def test_aurc_and_auroc(spark, scored):
    p, y, df = scored
    order = np.lexsort((np.arange(len(y)), -p.max(1)))
    err = (p.argmax(1) != y)[order]
    assert M.aurc(df, ["g"], "id").first()["aurc"] == pytest.approx((np.cumsum(err) / np.arange(1, len(y) + 1)).mean())
    rng = np.random.default_rng(2)
    s, t = rng.integers(0, 9, 120), rng.integers(0, 2, 120)
    want = np.mean([(a > b) + (a == b) / 2 for a in s[t == 1] for b in s[t == 0]])
    rows = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(s, t)], "g string, s double, t int")
    assert M.auroc(rows, ["g"], "s", "t").first()["auroc"] == pytest.approx(want)
    assert M.auroc(rows.filter("t = 1"), ["g"], "s", "t").first()["auroc"] is None


def test_confusion_grid_and_bootstrap(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    rows = spark.createDataFrame([("a", "a")] * 30 + [("a", "b")] * 5 + [("b", "b")] * 20 + [("b", "zzz"), ("b", None)], "gold string, said string")
    cells = M.confusion(rows, labels)
    assert cells.count() == 12
    got = {(r["gold"], r["said"]): r["n"] for r in cells.collect()}
    assert got["b", "__invalid__"] == 2 and got["c", "a"] == 0
    out = M.bootstrap_macro_f1(spark, cells, ["a", "b", "c"], 500).first()
    assert out["low"] <= out["point"] <= out["high"]
    f1 = {r["label"]: r for r in M.per_class(rows, labels).collect()}
    assert f1["c"]["f1"] == 0 and f1["b"]["recall"] == pytest.approx(20 / 22)


def test_gap_interval_is_paired(spark):
    cells = [("a", "a", "a", 60), ("b", "b", "b", 60), ("a", "a", "b", 12), ("b", "b", "a", 3), ("b", "zz", "b", 1)]
    got = M.bootstrap_gap(spark, spark.createDataFrame(cells, "gold string, teacher string, student string, n long"), ["a", "b"]).first()
    assert 0 < got["low"] < got["point"] < got["high"] < 0.3
    same = M.bootstrap_gap(spark, spark.createDataFrame([("a", "b", "b", 9), ("b", "b", "b", 9)], "gold string, teacher string, student string, n long"), ["a", "b"]).first()
    assert (same["low"], same["high"], same["point"]) == (0, 0, 0)
    assert M.bootstrap_gap(spark, spark.createDataFrame([], "gold string, teacher string, student string, n long"), ["a"]).first()["point"] == 0
