"""The life of a project on disk: locked seed, labels from teachers, review, training data, student, report.

Tables are parquet folders that are written whole under a new number and switched by the manifest, so a
run that dies leaves the last state in place.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.functions import questions as Q
from quorumdf.functions import text as X
from quorumdf.operators import findings as N
from quorumdf.operators import heads, metrics, review, route, teacher
from quorumdf.operators import tables as O
from quorumdf.operators import votes as V
from quorumdf.operators.combine import fit, pick_temperature, posterior
from quorumdf.plans.skew import cut
from quorumdf.sources.files import read_json, write_json


class Tables:
    """Named tables of a folder with a manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)
        self.manifest = read_json(f"{folder}/manifest.json", {"tables": {}, "stages": []})

    def _save(self) -> None:
        write_json(f"{self.folder}/manifest.json", self.manifest)

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise ValueError(f"there is no {name} yet")
        return self.spark.read.parquet(f"{self.folder}/{self.manifest['tables'][name]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        number = int(self.manifest["tables"].get(name, "x-0").rsplit("-", 1)[1]) + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}-{number}")
        self.manifest["tables"][name] = f"{name}-{number}"
        self._save()
        return self.read(name)

    def drop(self, *names: str) -> None:
        for n in names:
            self.manifest["tables"].pop(n, None)
        self._save()

    def stage(self, name: str, cost: float = 0.0, **params) -> None:
        self.manifest["stages"].append({"name": name, "completed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "cost_usd": round(cost, 4), "params": params})
        self._save()

    def spent(self) -> float:
        return round(sum(s["cost_usd"] for s in self.manifest["stages"]), 4)


def _setting(manifest: dict, key: str, value):
    """A setting that must not change over a project's life."""
    if value is None:
        return manifest.get(key)
    if manifest.get(key, value) != value:
        raise ValueError(f"the project was made with another {key}")
    manifest[key] = value
    return value


class Project:
    """A classifier: one label per text."""

    LEAST = 8

    def __init__(self, spark: SparkSession, folder: str, labels: dict[str, str] | None = None, task: str = "Label the text.", teachers: dict[str, Callable[[str, str], str]] | None = None, test_share: float = 0.35, seed: int = 42):
        self.t = Tables(spark, folder)
        self.spark, self.teachers, self.test_share, self.seed = spark, teachers or {}, test_share, seed
        self.labels = dict(_setting(self.t.manifest, "labels", labels) or {})
        self.task = task
        self.store = teacher.Store(spark, f"{folder}/calls")
        self.t._save()

    @property
    def names(self) -> list[str]:
        return sorted(self.labels)

    def _dim(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names], "label string")

    # -- seed --------------------------------------------------------------------------------------------------------
    def _lock(self) -> str:
        r = O.lock_hash(self.t.read("seed_test")).first()
        return f"{r['n']}:{r['lock']}"

    def add_seed(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Check, split and lock the hand-labelled rows (text, label).  The same rows again are no change; others need ``overwrite``, which drops what was derived."""
        rows = rows.select("text", "label")
        blank = rows.filter(X.is_blank(F.col("text")) | X.is_blank(F.col("label")))
        O.require(blank, "blank text or label")
        O.require(O.unknown_labels(rows, self._dim()), "unknown labels")
        clean = rows.withColumn("id", F.xxhash64("text", "label"))
        clean = O.keep_first(clean.select("text", "id", "label"), ["text"], "id")
        O.require(O.class_sizes(clean, self._dim(), least=self.LEAST).filter("not enough"), f"labels with fewer than {self.LEAST} rows")
        whole = O.lock_hash(clean).first()
        mark = f"{whole['n']}:{whole['lock']}"
        if self.t.manifest.get("seed") == mark:
            return
        if "seed" in self.t.manifest and not overwrite:
            raise ValueError("the seed is locked; overwrite=True replaces it and drops everything derived from it")
        split = O.stratified_split(clean, "label", "text", self.test_share, self.seed)
        self.t.write("seed_test", split.filter("split = 'test'").select("text", "label"))
        self.t.write("seed_dev", split.filter("split = 'dev'").select("text", "label"))
        self.t.drop("pool_labeled", "review", "votes")
        self.t.manifest |= {"seed": mark, "lock": self._lock()}
        self.t.stage("seed")

    def add_examples(self, rows: DataFrame) -> int:
        """New rows by the hash of their text; texts already there are left."""
        O.require(O.unknown_labels(rows, self._dim()), "unknown labels")
        dev, test = self.t.read("seed_dev"), self.t.read("seed_test")
        first = O.keep_first(rows.select("text", "label").withColumn("__at", F.col("label")), ["text"], "__at").select("text", "label")  # of several labels of one text the first by name
        new = O.hash_split(O.without(first, dev, test), self.test_share, self.seed)
        n = new.count()
        self._rewrite(dev.unionByName(new.filter("split = 'dev'").drop("split")), test.unionByName(new.filter("split = 'test'").drop("split")))
        return n

    def _rewrite(self, dev: DataFrame, test: DataFrame) -> None:
        self.t.write("seed_dev", dev)
        self.t.write("seed_test", test)
        self.t.manifest["lock"] = self._lock()
        self.t._save()

    def fix(self, text: str, label: str) -> None:
        if label not in self.labels:
            raise ValueError(f"unknown label {label!r}")
        self._rewrite(*(self.t.read(s).withColumn("label", F.when(F.col("text") == text, label).otherwise(F.col("label"))) for s in ("seed_dev", "seed_test")))

    def remove(self, texts: list[str]) -> None:
        self._rewrite(*(self.t.read(s).filter(~F.col("text").isin(texts)) for s in ("seed_dev", "seed_test")))

    # -- labels ------------------------------------------------------------------------------------------------------
    def add_label(self, name: str, meaning: str = "") -> None:
        self.labels[name] = meaning
        self.t.manifest["labels"] = self.labels
        self.t._save()

    def merge_labels(self, source: str, target: str) -> None:
        """Rename ``source`` to ``target`` in seed, pool, votes and ledger."""
        self._map({source: target})

    def remove_label(self, name: str) -> None:
        """Drop a label with its rows."""
        self._map({name: None})

    def _map(self, mapping: dict[str, str | None]) -> None:
        for name in ("pool_labeled", "votes", "review"):
            if self.t.has(name):
                self.t.write(name, O.relabel(self.t.read(name), mapping))
        self.labels = {k: v for k, v in self.labels.items() if k not in mapping}
        self.t.manifest["labels"] = self.labels
        self._rewrite(*(O.relabel(self.t.read(s), mapping) for s in ("seed_dev", "seed_test")))

    # -- teachers ----------------------------------------------------------------------------------------------------
    def prompt(self) -> str:
        return self.t.manifest.get("prompt") or Q.label_prompt(self.task, self.labels)

    def optimize(self, candidates: list[str]) -> str:
        """Keep the candidate prompt of best accuracy on the dev split; the test split is never asked.  Candidates come from any search."""
        dev = self.t.read("seed_dev")
        name, call = next(iter(self.teachers.items()))
        scores = {}
        for p in [self.prompt(), *candidates]:
            got = teacher.label_texts(dev.withColumnRenamed("label", "gold"), call, name, p, self.names, self.store)
            scores[p] = got.agg(F.avg((F.col("label") == F.col("gold")).cast("double"))).first()[0] or 0.0
        best = max(scores, key=scores.get)
        self.t.manifest["prompt"] = best
        self.t.stage("optimize")
        return best

    def label(self, pool: DataFrame, votes: int = 1, dry_run: bool = False) -> DataFrame:
        """Labels of the pool (text) without seed texts: each distinct text once per teacher, the teachers' majority."""
        texts = O.without(pool.select("text").filter(~X.is_blank(F.col("text"))).distinct(), self.t.read("seed_dev"), self.t.read("seed_test"))
        if dry_run:
            return teacher.estimate(texts, self.prompt(), None, None, votes * len(self.teachers))
        ballots = None
        for i, (name, call) in enumerate(self.teachers.items()):
            one = teacher.label_texts(texts, call, name, self.prompt(), self.names, self.store, votes).select("text", F.lit(name).alias("teacher"), F.lit(i).alias("at"), "label", "confidence")
            ballots = one if ballots is None else ballots.unionByName(one)
        ballots = self.t.write("votes", ballots)
        if len(self.teachers) == 1:
            out = ballots.select("text", "label", "confidence")
        else:
            valid = ballots.withColumn("label", F.when(F.col("label") != X.INVALID, F.col("label")))
            out = V.majority(valid, ["text"], "label", "at")
        self.t.write("pool_labeled", out)
        self.t.stage("label", votes=votes)
        return self.t.read("pool_labeled")

    def check_teachers(self) -> DataFrame:
        """(teacher, n, accuracy, invalid) on the dev split only."""
        dev = self.t.read("seed_dev").withColumnRenamed("label", "gold")
        out = None
        for name, call in self.teachers.items():
            got = teacher.label_texts(dev, call, name, self.prompt(), self.names, self.store).withColumn("teacher", F.lit(name))
            out = got if out is None else out.unionByName(got)
        return out.groupBy("teacher").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("gold")).cast("double")).alias("accuracy"), F.avg((F.col("label") == X.INVALID).cast("double")).alias("invalid"))

    def ask(self, texts: DataFrame) -> DataFrame:
        """The first teacher's answers in the shape of predictions, from the store where it has them."""
        name, call = next(iter(self.teachers.items()))
        return teacher.label_texts(texts, call, name, self.prompt(), self.names, self.store).withColumn("label", F.when(F.col("label") != X.INVALID, F.col("label")))

    # -- review ------------------------------------------------------------------------------------------------------
    def queue(self) -> DataFrame:
        rows = self.t.read("pool_labeled")
        if self.t.has("review"):
            rows = review.minus_ledger(rows, review.current(self.t.read("review"), ["text"]).filter("label is not null"), ["text"])
        return review.majority_queue(rows, "text")

    def apply_review(self, decisions: DataFrame) -> DataFrame:
        """Append decisions (text, label) to the ledger; returns those on texts that are not in the pool."""
        O.require(O.unknown_labels(decisions, self._dim()), "unknown labels")
        old = self.t.read("review") if self.t.has("review") else None
        last = (old.agg(F.max("seq")).first()[0] or 0) if old is not None else 0
        new = decisions.select("text", F.lit(last + 1).alias("seq"), "label")
        self.t.write("review", new if old is None else old.unionByName(new))
        return review.unknown_reviews(new, self.t.read("pool_labeled"), ["text"])

    def unreview(self, texts: DataFrame) -> None:
        self.t.write("review", review.undo(self.t.read("review"), texts, ["text"]))

    def labelled(self) -> DataFrame:
        rows = self.t.read("pool_labeled")
        return review.apply_labels(rows, self.t.read("review"), ["text"]).select("text", "label", "confidence") if self.t.has("review") else rows

    # -- student -----------------------------------------------------------------------------------------------------
    def training_rows(self, min_confidence: float = 0.0, with_dev: bool = True) -> DataFrame:
        """Pool labels and dev rows; never a test text, never an invalid label.  A test split that differs from its lock is refused."""
        if self.t.manifest.get("lock") != self._lock():
            raise ValueError("the test split has changed since it was locked")
        rows = self.labelled().filter((F.col("confidence") >= min_confidence) & (F.col("label") != X.INVALID)).select("text", "label")
        rows = O.without(rows, self.t.read("seed_test"), self.t.read("seed_dev"))
        return rows.unionByName(self.t.read("seed_dev")) if with_dev else rows

    def distill(self, min_confidence: float = 0.0, budget: float | None = None, **options) -> tuple[heads.Student, dict]:
        """(student, report).  With a ``budget`` three tenths of the teacher's pool are held out of training to find the routing threshold; hand labels never are."""
        rows = self.training_rows(min_confidence)
        limit = None
        held = O.hash_split(self.training_rows(min_confidence, with_dev=False), 0.3, self.seed).filter("split = 'test'") if budget is not None else None
        train = rows if held is None else O.without(rows, held)
        student = heads.train_classifier(train, self.names, **options)
        if held is not None:
            scored = heads.predict(student.predict_proba(held.withColumnRenamed("label", "truth")), self.names, "p_label")
            checks = self.t.write("routing_held", scored.select(A.top(F.col("p_label")).alias("score"), (F.col("label") != F.col("truth")).cast("int").alias("disagree")))
            limit = route.threshold(checks, budget).first().asDict()
            student.threshold = limit["threshold"]
        report = self.score(student)
        report["routing"] = limit
        shift = metrics.chi_square(self.labelled().filter(F.col("label") != X.INVALID), self.t.read("seed_dev")).first()
        report |= self._evidence(student)
        report["shift_p"] = N.chi_square_survival(shift["statistic"] or 0.0, max(1, shift["cells"] - 1))
        report["findings"] = N.classifier_findings(report)
        write_json(f"{self.t.folder}/report.json", report)
        self.t.stage("distill", min_confidence=min_confidence)
        return student, report

    def _evidence(self, student: heads.Student) -> dict:
        """What the findings need beside the scores: label shares, confidence and validity of the pool, and student and teacher on the same test rows."""
        pool = self.t.read("pool_labeled")
        sums = pool.agg(F.avg("confidence").alias("c"), F.avg((F.coalesce("label", F.lit(X.INVALID)) == X.INVALID).cast("double")).alias("i")).first()
        share = lambda df: {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in self.labels}
        here, there = share(pool), share(self.t.read("seed_dev"))
        n, m = max(1, sum(here.values())), max(1, sum(there.values()))
        out = {"confidence": sums["c"], "invalid_share": sums["i"] or 0.0, "shift_ratios": [here.get(k, 0) / n / (v / m) for k, v in sorted(there.items())]}
        if self.teachers:
            gold = self.t.read("seed_test").withColumnRenamed("label", "gold")
            own = heads.predict(student.predict_proba(gold), self.names, "p_label").select("text", "gold", F.col("label").alias("student"), A.top(F.col("p_label")).alias("sure"))
            both = cut(own.join(self.ask(gold.select("text")).select("text", F.coalesce("label", F.lit(X.INVALID)).alias("teacher")), "text"))
            right = both.agg(F.avg((F.col("teacher") == F.col("gold")).cast("double")).alias("t"), F.percentile("sure", F.lit(0.2)).alias("q")).first()
            out["teacher_accuracy"] = right["t"]
            out["accuracy_at_80"] = both.filter(F.col("sure") >= (right["q"] or 0.0)).agg(F.avg((F.col("student") == F.col("gold")).cast("double"))).first()[0]
            gap = metrics.bootstrap_gap(self.spark, both.groupBy("gold", "teacher", "student").agg(F.count("*").alias("n")), self.names).first()
            out["gap_low"], out["gap_high"] = gap["low"], gap["high"]
        return out

    def score(self, student: heads.Student, split: str = "seed_test") -> dict:
        gold = self.t.read(split).withColumnRenamed("label", "gold")
        said = heads.predict(student.predict_proba(gold), self.names, "p_label").select("gold", F.col("label").alias("said"))
        per = {r["label"]: {"student_f1": r["f1"], "support": r["support"]} for r in metrics.per_class(said, self._dim()).collect()}
        out = {"student_f1": sum(c["student_f1"] for c in per.values()) / max(1, len(per)), "per_class": per}
        if self.teachers:
            asked = self.ask(gold).select("gold", F.coalesce("label", F.lit(X.INVALID)).alias("said"))
            theirs = {r["label"]: r["f1"] for r in metrics.per_class(asked, self._dim()).collect()}
            out["teacher_f1"] = sum(theirs.values()) / max(1, len(theirs))
            for k, f in theirs.items():
                per[k]["teacher_f1"] = f
        return out

    def compare(self, variants: dict[str, dict]) -> list[tuple[str, float]]:
        """Variants (options of the features) trained on the pool alone, ranked by macro-F1 on the dev split."""
        rows = self.training_rows(with_dev=False)
        return sorted(((n, self.score(heads.train_classifier(rows, self.names, **o), "seed_dev")["student_f1"]) for n, o in variants.items()), key=lambda x: (-x[1], x[0]))

    def rebudget(self, budget: float) -> dict:
        return route.rebudget(self.t.read("routing_held"), budget).first().asDict()

    def prune(self, keep: set[str] = frozenset({"seed_dev", "seed_test", "pool_labeled", "review"}), dry_run: bool = False) -> list[str]:
        """Forget tables and old numbers that are not in ``keep``; returns their folders."""
        import shutil

        used = {v for k, v in self.t.manifest["tables"].items() if k in keep}
        gone = [f for f in sorted(os.listdir(self.t.folder)) if os.path.isdir(f"{self.t.folder}/{f}") and f not in used and f != "calls"]
        if not dry_run:
            self.t.drop(*[k for k in list(self.t.manifest["tables"]) if k not in keep])
            for f in gone:
                shutil.rmtree(f"{self.t.folder}/{f}")
        return gone


class Panel:
    """Several typed questions per text."""

    def __init__(self, spark: SparkSession, folder: str, questions: dict[str, Q.Question] | None = None, teachers: dict[str, Callable[[str, str], str]] | None = None, test_share: float = 0.35, seed: int = 42):
        self.t = Tables(spark, folder)
        self.spark, self.teachers, self.test_share, self.seed = spark, teachers or {}, test_share, seed
        stored = _setting(self.t.manifest, "questions", Q.serialise(Q.check(questions)) if questions else None)
        self.questions = Q.deserialise(stored)
        self.store = teacher.Store(spark, f"{folder}/answers")
        self.t._save()

    @property
    def options(self) -> DataFrame:
        return Q.frame(self.spark, self.questions)

    def _lock(self) -> str:
        rows = self.t.read("gold").filter("split = 'test'").select("text", F.concat_ws(":", "question", F.col("y").cast("string")).alias("label"))
        r = O.lock_hash(rows).first()
        return f"{r['n']}:{r['lock']}"

    def add_seed(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Hand answers in wide form (text and a column per question); unreadable ones are null.  Split by text hash and locked.

        Of several rows of one text one counts, chosen by its content.  The same rows again are no change; others need ``overwrite``, which drops
        what was derived from the old ones.
        """
        missing = [q for q in self.questions if q not in rows.columns]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        rows = rows.filter(~X.is_blank(F.col("text"))).select("text", *self.questions)
        rows = O.keep_first(rows.withColumn("__order", F.xxhash64("text", *[F.col(q).cast("string") for q in self.questions])), ["text"], "__order").drop("__order")
        flat = rows.select("text", F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).cast("string").alias("answer")) for q in self.questions])).alias("x")).select("text", "x.*")
        gold = flat.join(self.options, "question").select("text", "question", X.gold_index(F.col("answer"), F.col("kind"), F.col("options")).alias("y")).filter("y is not null")
        whole = O.lock_hash(gold.select("text", F.concat_ws(":", "question", F.col("y").cast("string")).alias("label"))).first()
        mark = f"{whole['n']}:{whole['lock']}"
        if self.t.manifest.get("seed") == mark:
            return
        if "seed" in self.t.manifest and not overwrite:
            raise ValueError("the seed is locked; overwrite=True replaces it and drops everything derived from it")
        self.t.write("gold", O.hash_split(gold, self.test_share, self.seed))
        self.t.drop("judged", "votes", "first", "review", "targets", "routing_held")
        self.t.manifest |= {"seed": mark, "lock": self._lock()}
        self.t.stage("seed")

    def guard(self) -> None:
        """Refuse to train when the test answers are not those that were locked."""
        if self.t.manifest.get("lock") != self._lock():
            raise ValueError("the test split has changed since it was locked")

    def gold(self, split: str) -> DataFrame:
        return self.t.read("gold").filter(F.col("split") == split).drop("split")

    def _ask(self, texts: DataFrame, names: list[str]) -> DataFrame:
        out = None
        for name in names:
            one = teacher.judge_texts(texts, self.teachers[name], name, Q.prompt(self.questions), self.options, self.store).filter("p is not null").withColumn("teacher", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out

    def judge(self, pool: DataFrame, escalate: float | None = None) -> DataFrame:
        """(text, question, p): the pool's answers, combined by what the teachers got right on the dev split.

        With ``escalate`` the first teacher is asked alone, and the others only for texts it is less sure of.
        """
        seed = self.t.read("gold").select("text").distinct()
        texts = O.without(pool.select("text").filter(~X.is_blank(F.col("text"))).distinct(), seed)
        names = list(self.teachers)
        if escalate is not None and len(names) > 1:
            first = self.t.write("first", self._ask(texts, names[:1]))
            unsure = first.groupBy("text").agg(F.min(A.top(F.col("p"))).alias("s")).filter(F.col("s") < escalate).select("text")
            votes = first.unionByName(self._ask(unsure, names[1:]))
        else:
            votes = self._ask(texts, names)
        votes = self.t.write("votes", votes)
        self.t.write("judged", self.combine(votes))
        self.t.stage("judge")
        return self.t.read("judged")

    def combine(self, votes: DataFrame) -> DataFrame:
        if len(self.teachers) == 1:
            return votes.select("text", "question", "p")
        dev = self.gold("dev")
        seen = self._ask(dev.select("text").distinct(), list(self.teachers)).select("text", "question", "teacher", "p")
        out = None
        for q, x in self.questions.items():
            kind, k = ("score" if x.kind == "score" else "choice"), len(x.options)
            model = fit(seen, dev, ["text"], q, k, kind)
            t = pick_temperature(seen, dev, ["text"], q, k, kind)[0] if model else 1.0
            one = posterior(votes, ["text"], q, model, t).select("text", "question", "p")
            out = one if out is None else out.unionByName(one)
        return out

    def review_queue(self) -> DataFrame:
        ledger = self.t.read("review") if self.t.has("review") else None
        if len(self.teachers) == 1:
            return review.single_queue(self.t.read("judged"), self.options, ["text"], ledger)
        return review.panel_queue(self.t.read("judged"), self.t.read("votes"), ["text"], len(self.teachers), ledger)

    def apply_review(self, decisions: DataFrame) -> DataFrame:
        """Append decisions (text, question, answer), answers being options' names; returns those on texts that were never judged."""
        known = self.options.select("question", F.explode("options").alias("answer"))
        O.require(decisions.filter("answer is not null").join(known, ["question", "answer"], "left_anti"), "unknown questions or answers")
        old = self.t.read("review") if self.t.has("review") else None
        last = (old.agg(F.max("seq")).first()[0] or 0) if old is not None else 0
        new = decisions.select("text", "question", F.lit(last + 1).alias("seq"), "answer")
        self.t.write("review", new if old is None else old.unionByName(new))
        return review.unknown_reviews(decisions.select("text", "question", "answer"), self.t.read("judged"), ["text", "question"])

    def unreview(self, texts: DataFrame) -> None:
        """Take back the last decision on each of (text, question)."""
        self.t.write("review", review.undo(self.t.read("review"), texts, ["text", "question"], label="answer"))

    def targets(self) -> DataFrame:
        """Wide vectors ``t_<question>``: the judged pool after review, and the dev split as one-hot rows."""
        rows = self.t.read("judged")
        if self.t.has("review"):
            rows = review.apply_answers(rows, self.t.read("review"), ["text"], self.options)
        hot = self.gold("dev").join(self.options, "question").select("text", "question", A.one_hot(F.col("y"), F.size("options")).alias("p"))
        rows = rows.select("text", "question", "p").unionByName(hot)
        return rows.groupBy("text").agg(*[F.any_value(F.when(F.col("question") == q, F.col("p")), ignoreNulls=True).alias(f"t_{q}") for q in self.questions])

    def distill(self, budget: float | None = None, calibrate: bool = True, **options) -> tuple[heads.Student, dict]:
        """(student, report): heads on the targets, calibrated out of fold, with a routing threshold from held-out judged texts."""
        self.guard()
        rows = self.t.write("targets", self.targets().withColumn("id", F.xxhash64("text")))
        asked = {q: x.options for q, x in self.questions.items()}
        judged = O.without(rows, self.gold("dev").select("text").distinct())  # disagreement is with the teacher, so hand answers are not held out
        held = O.hash_split(judged, 0.3, self.seed).filter("split = 'test'") if budget is not None else None
        train = rows if held is None else O.without(rows, held)
        student = heads.train_panel(train, asked, **options)
        if calibrate:
            student = heads.calibrated(student, train, asked, "id", **options)
        report = {}
        if held is not None:
            long = lambda df, prefix: df.select("text", F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(f"{prefix}{q}").alias("p")) for q in asked])).alias("x")).select("text", "x.*").filter("p is not null")
            checks = self.t.write("routing_held", route.document_checks(long(student.predict_proba(held), "p_"), long(held, "t_"), ["text"]))
            report["routing"] = route.threshold(checks, budget).first().asDict()
            student.threshold = report["routing"]["threshold"]
        report["questions"] = self.score(student)
        if self.teachers:
            said = cut(self.combine(self._ask(self.gold("dev").select("text").distinct(), list(self.teachers))).select("text", "question", "p").join(self.gold("dev"), ["text", "question"]))
            for r in metrics.ece(said, ["question"], "text").collect():
                if r["question"] in report["questions"]:
                    report["questions"][r["question"]]["teacher_ece"] = r["ece"]
        report["findings"] = N.panel_findings(report["questions"])
        write_json(f"{self.t.folder}/report.json", report)
        self.t.stage("distill")
        return student, report

    def score(self, student: heads.Student, split: str = "test") -> dict[str, dict]:
        gold = self.gold(split)
        docs = student.predict_proba(gold.select("text").distinct())
        out = {}
        for q, x in self.questions.items():
            rows = docs.select("text", F.col(f"p_{q}").alias("p")).join(gold.filter(F.col("question") == q), "text")
            rules = metrics.scoring_rules(rows, ["question"]).first()
            if rules is None:
                continue
            m = {k: rules[k] for k in ("n", "accuracy", "mean_confidence", "nll", "brier")}
            m["ece"] = metrics.ece(rows, ["question"], "text").first()["ece"]
            parts = metrics.murphy(rows, ["question"], "text").first()
            m["resolution_share"], m["overconfidence"] = parts["share"], m["mean_confidence"] - m["accuracy"]
            if x.kind == "noul":
                m["auroc"] = metrics.auroc(rows.select("question", F.get("p", F.lit(1)).alias("s"), "y"), ["question"], "s", "y").first()["auroc"]
                m["minority"] = min(rows.filter("y = 1").count(), rows.filter("y = 0").count())
            out[q] = m
        return out

    def merge_options(self, q: str, source: str, target: str) -> None:
        """Add one option's probability to another's in all stored answers, and drop it from the question."""
        x = self.questions[q]
        i, j = x.options.index(source), x.options.index(target)
        for name in ("judged", "votes"):
            if self.t.has(name):
                rows = self.t.read(name)
                self.t.write(name, rows.withColumn("p", F.when(F.col("question") == q, O.merge_options(F.col("p"), i, j)).otherwise(F.col("p"))))
        if self.t.has("gold"):
            moved = F.when(F.col("y") == i, F.lit(j)).otherwise(F.col("y"))
            moved = F.when(moved > i, moved - 1).otherwise(moved)
            self.t.write("gold", self.t.read("gold").withColumn("y", F.when(F.col("question") == q, moved).otherwise(F.col("y")).cast("int")))
            self.t.manifest["lock"] = self._lock()
        if self.t.has("review"):
            renamed = F.when((F.col("question") == q) & (F.col("answer") == source), F.lit(target)).otherwise(F.col("answer"))
            self.t.write("review", self.t.read("review").withColumn("answer", renamed))
        self.questions[q] = Q.Question(x.kind, x.instructions, tuple(c for c in x.criteria if c[0] != source), x.hypothesis)
        self._store_questions()

    def remove_question(self, q: str) -> None:
        for name in ("judged", "votes", "gold", "review"):
            if self.t.has(name):
                self.t.write(name, self.t.read(name).filter(F.col("question") != q))
        if self.t.has("gold"):
            self.t.manifest["lock"] = self._lock()
        del self.questions[q]
        self._store_questions()

    def set_question(self, q: str, question: Q.Question) -> None:
        """Add a question or replace one; stored answers to a replaced one no longer count."""
        if q in self.questions:
            self.remove_question(q)
        self.questions[q] = question
        Q.check(self.questions)
        self._store_questions()

    def _store_questions(self) -> None:
        self.t.manifest["questions"] = Q.serialise(self.questions)
        self.t._save()


def autotune(project: Project, pool: DataFrame, ladder: list[tuple[str, Callable, float]], budget: float, target: float, rungs: tuple[float, ...] = (0.0, 0.67, 1.0), **options) -> dict:
    """Teachers from cheap to dear (name, call, price per call): label, train at each confidence rung, stop at the target on the dev split.

    A teacher whose estimate times 1.5 exceeds what is left of the budget is skipped; the test split is scored once, at the end.
    """
    best, trail, spent = None, [], 0.0
    for name, call, price in ladder:
        project.teachers = {name: call}
        calls = project.label(pool, dry_run=True).first()["calls"]
        if spent + 1.5 * calls * price > budget:
            trail.append({"teacher": name, "skipped": "budget"})
            continue
        project.label(pool)
        spent += calls * price
        for rung in rungs:
            rows = project.training_rows(rung, with_dev=False)
            if rows.select("label").distinct().count() < 2:
                continue
            student = heads.train_classifier(rows, project.names, **options)
            f1 = project.score(student, "seed_dev")["student_f1"]
            trail.append({"teacher": name, "min_confidence": rung, "dev_f1": f1})
            if best is None or f1 > best[0]:
                best = (f1, student, name, rung)
        if best and best[0] >= target:
            break
    if best is None:
        return {"trail": trail, "spent": spent}
    return {"trail": trail, "spent": spent, "teacher": best[2], "min_confidence": best[3], "dev_f1": best[0], "test_f1": project.score(best[1])["student_f1"]}
