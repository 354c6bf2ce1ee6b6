from pyspark.sql import functions as F

from quorumdf.functions import text as X
from quorumdf.operators import review as R
from quorumdf.operators import tables as O
from quorumdf.operators import votes as V
from quorumdf.operators.combine import fit, pick_temperature, posterior


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape)


def test_keep_first_and_last(spark):
    df = frame(spark, [("x", 1, "a"), ("x", 2, "b"), (None, 3, "c"), (None, 4, None)], "text string, id int, v string")
    assert sorted(r["id"] for r in O.keep_first(df, ["text"], "id").collect()) == [1, 3]
    assert sorted(r["id"] for r in O.keep_last(df, ["text"], "id").collect()) == [2, 4]
    assert O.keep_first(df.filter("false"), ["text"], "id").count() == 0


def test_splits_are_disjoint_stable_and_stratified(spark):
    df = frame(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(100)], "id int, text string, label string")
    one = {r["id"]: r["split"] for r in O.stratified_split(df, "label", "id", 0.35).collect()}
    two = {r["id"]: r["split"] for r in O.stratified_split(df.orderBy(F.desc("id")), "label", "id", 0.35).collect()}
    assert one == two
    assert sum(v == "test" for k, v in one.items() if k % 2) == 18
    h = {r["id"]: r["split"] for r in O.hash_split(df, 0.3).collect()}
    more = {r["id"]: r["split"] for r in O.hash_split(df.unionByName(frame(spark, [(900, "new", "a")], df.schema)), 0.3).collect()}
    assert all(more[k] == v for k, v in h.items())
    assert {r["fold"] for r in O.folds(df, "id").collect()} == set(range(5))


def test_lock_ignores_order_and_sees_changes(spark):
    df = frame(spark, [("a", "x"), ("b", None)], "text string, label string")
    one = O.lock_hash(df).first()
    assert one == O.lock_hash(df.orderBy(F.desc("text"))).first()
    assert one != O.lock_hash(df.withColumn("label", F.lit("x"))).first()


def test_majority(spark):
    rows = [(1, "a", 0), (1, "b", 1), (2, None, 0), (2, None, 1), (3, "b", 0), (3, None, 1), (3, "b", 2)]
    got = {r["id"]: (r["label"], r["confidence"]) for r in V.majority(frame(spark, rows, "id int, label string, at int"), ["id"], "label", "at").collect()}
    assert got == {1: ("a", 0.5), 2: (X.INVALID, 0.0), 3: ("b", 0.67)}


def test_options_merge_and_drop(spark):
    df = frame(spark, [([0.2, 0.3, 0.5],), ([0.0, 0.0, 1.0],)], "p array<double>")
    assert [r[0] for r in df.select(O.merge_options(F.col("p"), 2, 0)).collect()][0] == [0.7, 0.3]
    assert [r[0] for r in df.select(O.drop_option(F.col("p"), 2)).collect()][1] is None
    wide = O.to_wide(df.withColumn("question", F.lit("q")), [], "q", ["x", "y", "z"])
    assert O.from_wide(wide, [], "q", ["x", "y", "z"]).first()["p"] == [0.2, 0.3, 0.5]


def test_review_and_undo(spark):
    pool = frame(spark, [(1, "a", 0.5), (2, "b", 0.4), (3, None, None)], "id int, label string, confidence double")
    ledger = frame(spark, [(1, 1, "c"), (1, 2, "d"), (9, 3, "z")], "id int, seq int, label string")
    got = {r["id"]: (r["label"], r["confidence"]) for r in R.apply_labels(pool, ledger, ["id"]).collect()}
    assert got == {1: ("d", 1.0), 2: ("b", 0.4), 3: (None, None)}
    back = R.undo(ledger, pool.filter("id = 1"), ["id"])
    assert {r["id"]: r["label"] for r in R.apply_labels(pool, back, ["id"]).collect()}[1] == "a"
    assert [r["id"] for r in R.unknown_reviews(ledger, pool, ["id"]).collect()] == [9]
    queue = frame(spark, [(i, 0.1 * i) for i in range(6)], "id int, top double")
    placed = R.interleave(queue, frame(spark, [(100, 1.0), (101, 1.0)], "id int, top double"), "top", "id")
    assert [r["id"] for r in placed.collect()] == [0, 1, 2, 100, 3, 4, 5, 101]


def test_combiner_beats_the_average(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows, gold = [], []
    for i in range(400):
        y = int(rng.integers(3))
        gold.append((i, "q", y))
        for t, acc in (("good", 0.9), ("poor", 0.4), ("bad", 0.4)):
            said = y if rng.random() < acc else (y + 1 + int(rng.integers(2))) % 3
            rows.append((i, "q", t, [0.9 if j == said else 0.05 for j in range(3)]))
    votes = frame(spark, rows, "id int, question string, teacher string, p array<double>")
    truth = frame(spark, gold, "id int, question string, y int")
    model = fit(votes, truth, ["id"], "q", 3)
    from quorumdf.functions import arrays as A

    right = lambda df: df.join(truth, ["id", "question"]).filter(A.argmax(F.col("p")) == F.col("y")).count()
    assert right(posterior(votes, ["id"], "q", model)) > right(V.average(votes, ["id", "question"])) + 20
    assert fit(votes.limit(3), truth.limit(5), ["id"], "q", 3) is None
    best, curve = pick_temperature(votes, truth, ["id"], "q", 3)
    assert best in dict(curve) and len(curve) == 10


def test_lenient_parsing(spark):
    assert X.first_object('well {"a": {"b": 1}} and {"c": 2}') == {"a": {"b": 1}}
    d = X.coerce_distribution
    assert d({"probabilities": {"Yes": 3, "no": 1}}, ["no", "yes"], "noul") == [0.25, 0.75]
    assert d(0.7, ["no", "yes"], "noul")[1] == 0.7
    assert d("true", ["no", "yes"], "noul") == [0.0, 1.0]
    assert d({"2: blocking": 1}, ["0", "1", "2"], "score") == [0.0, 0.0, 1.0]
    assert d("nothing", ["a", "b"], "choice") is None and d(float("nan"), ["a", "b"], "score") is None
    df = frame(spark, [("Yes ", "noul", ["no", "yes"]), ("2.5", "score", ["0", "1", "2", "3"]), ("B", "choice", ["a", "b"]), ("?", "choice", ["a", "b"]), (None, "noul", ["no", "yes"])], "a string, k string, o array<string>")
    assert [r[0] for r in df.select(X.gold_index(F.col("a"), F.col("k"), F.col("o"))).collect()] == [1, 2, 1, None, None]


def test_split_question_and_warnings(spark):
    gold = frame(spark, [(i, q, y) for i in range(10) for q, y in (("even", i % 2), ("rare", int(i == 0)), ("lopsided", int(i < 2)))] + [(0, "part", 1)], "id int, question string, y int")
    assert O.split_question(gold, ["id"]) == "even"
    assert O.split_question(gold.filter("question = 'part'").unionByName(gold.filter("question = 'rare'")), ["id"]) is None
    labels = frame(spark, [("a",), ("b",)], "label string")
    rows = frame(spark, [("a",)] * 30, "label string")
    assert O.small_splits(rows, rows, labels) == ["b has 0 test rows", "the dev split has 30 rows"]


def test_summary_and_preview(spark):
    import numpy as np

    from quorumdf.operators.combine import cascade_preview, summary

    rng = np.random.default_rng(2)
    rows, gold = [], []
    for i in range(200):
        y = int(rng.integers(2))
        gold.append((i, "q", y))
        for t, acc in (("good", 0.95), ("poor", 0.6)):
            said = y if rng.random() < acc else 1 - y
            rows.append((i, "q", t, [0.9, 0.1] if said == 0 else [0.1, 0.9]))
    votes, truth = frame(spark, rows, "id int, question string, teacher string, p array<double>"), frame(spark, gold, "id int, question string, y int")
    s = summary(votes, truth, ["id"], "q", 2)
    assert s["n_dev"] == 200 and s["accuracy"]["good"] > 0.9 > s["accuracy"]["poor"] and s["combined"] > 0.9
    assert s["influence"].keys() == {"good", "poor"} and len(s["pairs"]) == 1
    p = cascade_preview(votes.filter("teacher = 'poor'"), votes.filter("teacher = 'good'"), ["id"])
    assert p == {"threshold": None, "escalated": 1.0}


def test_demo_is_stable(spark):
    from quorumdf.sources.demo import tickets

    a, b = tickets(spark, 50), tickets(spark, 50).repartition(7)
    assert sorted(a.collect()) == sorted(b.collect()) and a.select("label").distinct().count() == 3 and a.filter("text like '%{}%'").count() == 0


def test_every_set_of_teachers_has_its_own_fit(spark):
    import itertools
    import random

    from quorumdf.operators.combine import combine_by_pattern

    r, rows, gold = random.Random(5), [], []
    names = "abcdefg"
    subsets = [c for n in range(1, 8) for c in itertools.combinations(names, n)]
    for i, c in enumerate(subsets * 2):
        y = r.randrange(3)
        gold.append((i, "q", y))
        for j, t in enumerate(c):
            said = y if r.random() < 0.3 + 0.08 * j + 0.05 * len(c) else r.randrange(3)
            rows.append((i, "q", t, [0.8 if o == said else 0.1 for o in range(3)], "+".join(c)))
    votes = spark.createDataFrame(rows, "id int, question string, teacher string, p array<double>, own string").cache()
    gold = spark.createDataFrame(gold, "id int, question string, y int").cache()
    got = {x["id"]: x for x in combine_by_pattern(votes.drop("own"), gold, ["id"], "q", 3).collect()}
    assert len(got) == 2 * len(subsets) and len({x["pattern"] for x in got.values()}) == 127
    for name in ("a", "f+g", "c+e+g"):
        own = name.split("+")
        whole = votes.filter(F.forall(F.array(*map(F.lit, own)), lambda t: F.array_contains(F.split("own", "[+]"), t)) & F.col("teacher").isin(own)).drop("own")
        for x in posterior(votes.filter(F.col("own") == name).drop("own"), ["id"], "q", fit(whole, gold, ["id"], "q", 3)).collect():
            assert got[x["id"]]["pattern"] == name and got[x["id"]]["n"] == x["n"]
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[x["id"]]["p"], x["p"]))
