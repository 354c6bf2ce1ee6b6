import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumdf.functions import questions as Q
from quorumdf.operators import stack
from quorumdf.operators.project import Panel, Project, autotune

KEYS = {"refund": "billing", "crash": "bug", "leave": "cancel"}
FILL = "please now today again maybe thanks".split()


def texts(n, seed):
    r = random.Random(seed)
    return [(f"{k} {' '.join(r.choices(FILL, k=3))} {seed}-{i}", v) for i in range(n) for k, v in [r.choice(list(KEYS.items()))]]


def keyword(prompt, text):
    return json.dumps({"label": next((v for k, v in KEYS.items() if k in text), "none")})


def wrong(prompt, text):
    return '{"label": "bug"}'


@pytest.fixture()
def project(spark, tmp_path):
    p = Project(spark, str(tmp_path / "p"), {v: "" for v in KEYS.values()}, teachers={"good": keyword})
    p.add_seed(spark.createDataFrame(texts(90, 1), "text string, label string"))
    return p


def test_life_of_a_classifier(spark, project):
    pool = spark.createDataFrame(texts(120, 2) + texts(5, 1), "text string, label string").select("text")
    assert project.label(pool, dry_run=True).first()["calls"] == 120
    assert project.label(pool).count() == 120
    assert project.queue().count() == 0
    seed = project.t.read("seed_test")
    assert project.training_rows().join(seed, "text").count() == 0
    student, report = project.distill(budget=0.3)
    assert report["student_f1"] > 0.9 and report["teacher_f1"] == 1.0 and report["routing"]["n"] > 10
    assert project.rebudget(0.5)["budget"] == 0.5
    assert project.compare({"a": {}, "b": {"min_df": 2.0}})[0][1] > 0.8
    one = pool.first()["text"]
    assert project.apply_review(spark.createDataFrame([(one, "bug"), ("nowhere", "bug")], "text string, label string")).count() == 1
    assert project.labelled().filter(F.col("text") == one).first()["label"] == "bug"
    project.unreview(spark.createDataFrame([(one,)], "text string"))
    assert project.labelled().filter(F.col("text") == one).first()["label"] == keyword_label(one)
    project.merge_labels("cancel", "billing")
    assert project.names == ["billing", "bug"] and project.labelled().filter("label = 'cancel'").count() == 0
    assert {"votes-1"} <= set(project.prune(dry_run=True))
    project.prune()
    assert not project.t.has("votes") and project.t.has("pool_labeled")


def keyword_label(text):
    return next(v for k, v in KEYS.items() if k in text)


def test_seed_rules(spark, project):
    rows = spark.createDataFrame(texts(90, 1), "text string, label string")
    before = dict(project.t.manifest["tables"])
    project.add_seed(rows)
    assert project.t.manifest["tables"] == before
    with pytest.raises(ValueError, match="locked"):
        project.add_seed(rows.limit(80))
    with pytest.raises(ValueError, match="unknown"):
        project.add_seed(rows.withColumn("label", F.lit("zzz")))
    with pytest.raises(ValueError, match="blank"):
        project.add_seed(rows.withColumn("text", F.lit("  ")))
    with pytest.raises(ValueError, match="fewer"):
        project.add_seed(rows.limit(5))
    assert project.add_examples(spark.createDataFrame([("new crash", "bug"), (texts(90, 1)[0][0], "bug")], "text string, label string")) == 1
    project.fix("new crash", "billing")
    both = project.t.read("seed_dev").unionByName(project.t.read("seed_test"))
    assert both.filter("text = 'new crash'").first()["label"] == "billing"
    project.remove(["new crash"])
    with pytest.raises(ValueError, match="another labels"):
        Project(spark, project.t.folder, {"x": ""})
    project.t.write("seed_test", project.t.read("seed_test").limit(3))
    project.t.write("pool_labeled", both.withColumn("confidence", F.lit(1.0)))
    with pytest.raises(ValueError, match="changed"):
        project.training_rows()


def test_several_teachers_and_optimisation(spark, project):
    project.teachers = {"good": keyword, "bad": wrong, "also": keyword}
    pool = spark.createDataFrame(texts(20, 3), "text string, label string")
    out = project.label(pool).join(pool.withColumnRenamed("label", "truth"), "text")
    assert out.filter("label = truth").count() == 20 and out.filter("confidence < 1").count() > 5
    rates = {r["teacher"]: r["accuracy"] for r in project.check_teachers().collect()}
    assert rates["good"] == 1.0 > rates["bad"]
    assert project.optimize(["another prompt"]) and project.t.manifest["prompt"]
    assert project.t.spent() == 0


def test_autotune_stops_early(spark, project):
    pool = spark.createDataFrame(texts(60, 4), "text string, label string")
    got = autotune(project, pool, [("dear", keyword, 100.0), ("bad", wrong, 0.0), ("good", keyword, 0.0), ("never", wrong, 0.0)], 10.0, 0.8)
    assert got["teacher"] == "good" and got["trail"][0]["skipped"] == "budget" and "never" not in {t["teacher"] for t in got["trail"]}


QUESTIONS = {"topic": Q.choice("Which matter?", {"billing": "", "bug": "", "cancel": ""}), "angry": Q.noul("Angry?", "It sounds angry."), "level": Q.score("How bad?", ["low", "mid", "high"])}


def reply(accuracy, name):
    def call(prompt, text):
        r = random.Random(f"{name}|{text}")
        y = {"topic": ["billing", "bug", "cancel"].index(keyword_label(text)), "angry": int("again" in text), "level": text.count("now") if text.count("now") < 3 else 2}
        out = {}
        for q, x in QUESTIONS.items():
            k = len(x.options)
            said = y[q] if r.random() < accuracy else r.randrange(k)
            out[q] = {"probabilities": {o: 0.85 if i == said else 0.15 / (k - 1) for i, o in enumerate(x.options)}}
        return json.dumps({"answers": out})

    return call


def test_life_of_a_panel(spark, tmp_path):
    p = Panel(spark, str(tmp_path / "panel"), QUESTIONS, {"good": reply(0.95, "g"), "poor": reply(0.4, "p")})
    seed = [(t, keyword_label(t), "yes" if "again" in t else "no", str(min(2, t.count("now")))) for t, _ in texts(150, 5)]
    shape = "text string, topic string, angry string, level string"
    p.add_seed(spark.createDataFrame(seed, shape))
    lock = p.t.manifest["lock"]
    p.add_seed(spark.createDataFrame(seed[::-1], shape))
    assert p.t.manifest["lock"] == lock
    with pytest.raises(ValueError):
        p.add_seed(spark.createDataFrame(seed[1:], shape))
    pool = spark.createDataFrame(texts(120, 6), "text string, label string")
    judged = p.judge(pool, escalate=0.9)
    assert judged.count() == 360
    right = judged.filter("question = 'topic'").join(pool, "text").filter(F.element_at(F.array(*map(F.lit, QUESTIONS["topic"].options)), F.array_position("p", F.array_max("p")).cast("int")) == F.col("label")).count()
    assert right > 105
    assert set(p.review_queue().columns) >= {"text", "question", "why"}
    one = pool.first()["text"]
    p.apply_review(spark.createDataFrame([(one, "topic", "bug")], "text string, question string, answer string"))
    assert p.targets().filter(F.col("text") == one).first()["t_topic"] == [0.0, 1.0, 0.0]
    p.unreview(spark.createDataFrame([(one, "topic")], "text string, question string"))
    assert p.targets().filter(F.col("text") == one).first()["t_topic"] == judged.filter((F.col("text") == one) & (F.col("question") == "topic")).first()["p"]
    with pytest.raises(ValueError):
        p.apply_review(spark.createDataFrame([(one, "topic", "nonsense")], "text string, question string, answer string"))
    assert p.apply_review(spark.createDataFrame([("never seen", "topic", "bug"), (one, "topic", "cancel")], "text string, question string, answer string")).count() == 1
    student, report = p.distill(budget=0.5, calibrate=False)
    assert report["questions"]["topic"]["accuracy"] > 0.8 and "routing" in report and "teacher_ece" in report["questions"]["topic"]
    held = p.t.read("routing_held")
    assert held.join(p.gold("dev").select("text"), "text").count() == 0 and held.count() == report["routing"]["n"]
    p.merge_options("topic", "cancel", "billing")
    assert p.questions["topic"].options == ["billing", "bug"] and {len(r["p"]) for r in p.t.read("judged").filter("question = 'topic'").collect()} == {2}
    assert {r["answer"] for r in p.t.read("review").filter("text <> 'never seen'").collect()} <= {None, "bug", "billing"}
    p.guard()
    p.t.write("gold", p.t.read("gold").withColumn("y", F.when(F.col("split") == "test", 1 - F.col("y")).otherwise(F.col("y")).cast("int")))
    with pytest.raises(ValueError):
        p.distill()
    p.remove_question("level")
    assert set(Panel(spark, p.t.folder).questions) == {"topic", "angry"}


def test_questions():
    assert Q.deserialise(Q.serialise(QUESTIONS)) == QUESTIONS
    for bad in (lambda: Q.choice("x", {"a": ""}), lambda: Q.score("x", ["a"] * 11), lambda: Q.check({"1a": QUESTIONS["angry"]}), lambda: Q.Question("other", "x")):
        with pytest.raises(ValueError):
            bad()
    assert Q.answer(QUESTIONS["topic"], [0.2, 0.5, 0.3])["choice"] == "bug"
    assert Q.answer(QUESTIONS["angry"], [0.25, 0.75]) == {"probability": 0.75}
    assert Q.answer(QUESTIONS["level"], [0, 0.5, 0.5])["score"] == 1.5
    assert Q.hypotheses("angry", QUESTIONS["angry"]) == {"no": "angry is false.", "yes": "It sounds angry."}
    assert Q.first_token_distribution([("Y", -0.1), ("no", -2.0), ("?", -1)], ["no", "yes"])[1] == pytest.approx(1 / (1 + np.exp(-1.9)))
    assert Q.first_token_distribution([("?", -1)], ["no", "yes"]) is None
    both = Q.Ensemble({"a": (3, lambda p, t: {"q": [1.0, 0.0]}), "b": (1, lambda p, t: {"q": [0.0, 1.0], "r": None})}, {"q": ["x", "y"]})
    assert json.loads(both("", ""))["answers"]["q"]["probabilities"] == {"x": 0.75, "y": 0.25}


def test_payload_and_objective(spark):
    df = spark.createDataFrame([(1, "topic", [0.2, 0.5, 0.3])], "id int, question string, p array<double>")
    r = df.select(Q.payload(QUESTIONS["topic"], F.col("p")).alias("a")).first()["a"]
    assert r["choice"] == "bug" and r["probabilities"] == {"billing": 0.2, "bug": 0.5, "cancel": 0.3} and r["confidence"] == Q.answer(QUESTIONS["topic"], [0.2, 0.5, 0.3])["confidence"]
    gold = spark.createDataFrame([(1, "topic", 1), (2, "topic", 0)], "id int, question string, y int")
    o = Q.objective(df, gold, ["id"]).first()
    assert o["score"] == pytest.approx((1 - 0.38 / 2) / 2) and (o["answered"], o["asked"]) == (1, 2)


def test_second_opinion(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    noise = rng.dirichlet([2, 2], 400)
    good = np.clip(np.eye(2)[y] * 0.5 + rng.dirichlet([2, 2], 400) * 0.5, 0.01, 0.99)
    good /= good.sum(1, keepdims=True)
    params = stack.fit(noise, good, y)
    assert params["weights"][1] > 0.5 and (stack.combine_numpy(noise, good, params).argmax(1) == y).mean() > 0.9
    assert abs(stack.fit(good, noise, y)["weights"][1]) < 0.3
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(noise[:20], good[:20]))], "id int, a array<double>, b array<double>")
    got = np.array([r["p"] for r in rows.withColumn("p", stack.combine(F.col("a"), F.col("b"), params)).orderBy("id").collect()])
    assert np.abs(got - stack.combine_numpy(noise[:20], good[:20], params)).max() < 1e-9
    assert stack.keep(0.7, 0.75, 50) and not stack.keep(0.7, 0.715, 50) and not stack.keep(0.7, 0.9, 10)
    docs = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    scored = stack.score(docs, "id", lambda t, s: np.array([[len(a) + len(b) for b in s] for a in t]), {"q": {"no": "n", "yes": "yyy"}})
    assert scored.count() == 2 and scored.filter("id = 2").first()["p"] == pytest.approx([0.25, 0.75])
