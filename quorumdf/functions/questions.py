"""Typed questions: pick one of several, rate on a scale, yes or no; their options, checks, prompts and answers."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A

_ID = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Question:
    """``kind`` is choice (option → criterion), score (criterion per level) or noul (yes/no, criteria for true and false)."""

    kind: str
    instructions: str
    criteria: tuple[tuple[str, str], ...] = ()
    hypothesis: str = ""

    def __post_init__(self):
        n = len(self.criteria)
        if self.kind not in ("choice", "score", "noul"):
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.kind == "choice" and not 2 <= n <= 255:
            raise ValueError("a choice has 2 to 255 options")
        if self.kind == "score" and not 2 <= n <= 10:
            raise ValueError("a score has 2 to 10 levels")
        if self.kind == "noul" and not {k for k, _ in self.criteria} <= {"true", "false"}:
            raise ValueError("a yes/no question has criteria for true and false only")

    @property
    def options(self) -> list[str]:
        if self.kind == "noul":
            return ["no", "yes"]
        return [str(i) for i in range(len(self.criteria))] if self.kind == "score" else [k for k, _ in self.criteria]

    def to_dict(self) -> dict:
        return {"kind": self.kind, "instructions": self.instructions, "criteria": [list(c) for c in self.criteria], "hypothesis": self.hypothesis}

    @classmethod
    def from_dict(cls, d: dict) -> Question:
        return cls(d["kind"], d["instructions"], tuple((k, v) for k, v in d.get("criteria", ())), d.get("hypothesis", ""))


def choice(instructions: str, options: dict[str, str], hypothesis: str = "") -> Question:
    return Question("choice", instructions, tuple(options.items()), hypothesis)


def score(instructions: str, levels: list[str], hypothesis: str = "") -> Question:
    return Question("score", instructions, tuple((str(i), x) for i, x in enumerate(levels)), hypothesis)


def noul(instructions: str, true: str = "", false: str = "", hypothesis: str = "") -> Question:
    return Question("noul", instructions, tuple((k, v) for k, v in (("true", true), ("false", false)) if v), hypothesis)


def check(questions: dict[str, Question]) -> dict[str, Question]:
    if not questions:
        raise ValueError("no questions")
    for q in questions:
        if not _ID.fullmatch(q):
            raise ValueError(f"{q!r} is not an identifier")
    return questions


def frame(spark: SparkSession, questions: dict[str, Question]) -> DataFrame:
    """(question, kind, options) as a relation."""
    return spark.createDataFrame([(q, x.kind, x.options) for q, x in questions.items()], "question string, kind string, options array<string>")


def prompt(questions: dict[str, Question], header: str = "Answer every question about the document.") -> str:
    """The system prompt of a panel; it is also the name space of stored answers."""
    lines = [header, "", 'Reply with one JSON object: {"answers": {id: {"probabilities": {option: p}}}}. Probabilities of a question add up to 1.']
    for q, x in questions.items():
        lines += ["", f"## {q}", x.instructions]
        if x.kind == "choice":
            lines += [f"- {k}: {v}" if v else f"- {k}" for k, v in x.criteria]
        elif x.kind == "score":
            lines += [f"- {k}: {v}" for k, v in x.criteria]
        else:
            lines += [f"- {'yes' if k == 'true' else 'no'}: {v}" for k, v in x.criteria]
    return "\n".join(lines)


def label_prompt(task: str, labels: dict[str, str]) -> str:
    lines = [task, "", 'Reply with one JSON object: {"label": name}. The names are:']
    return "\n".join([*lines, *(f"- {k}: {v}" if v else f"- {k}" for k, v in labels.items())])


def hypotheses(q: str, question: Question) -> dict[str, str]:
    """A sentence per option whose truth a second scorer can judge: the template if given, else the criterion, else a plain frame."""
    names = dict(question.criteria)
    if question.kind == "noul":
        names = {"no": names.get("false", ""), "yes": names.get("true", "")}
    out = {}
    for option in question.options:
        meaning = names.get(option, "")
        if question.hypothesis:
            out[option] = question.hypothesis.replace("{}", meaning or option)
        elif meaning:
            out[option] = meaning
        elif question.kind == "noul":
            out[option] = f"{q} is {'true' if option == 'yes' else 'false'}."
        else:
            out[option] = f"This text is about {option}."
    return out


def answer(question: Question, p: list[float]) -> dict:
    """The typed payload of one vector: choice and score carry a confidence, yes/no only its probability; four places."""
    best = max(range(len(p)), key=lambda i: (p[i], -i))
    if question.kind == "noul":
        return {"probability": round(p[1], 4)}
    clipped = [min(1.0, max(A.EPS, x)) for x in p]
    shape = 1 + sum(x * math.log(x) for x in clipped) / math.log(len(p)) if len(p) > 1 else 1.0
    out = {"confidence": round(shape, 4), "probabilities": {o: round(x, 4) for o, x in zip(question.options, p)}}
    if question.kind == "score":
        return {"score": round(sum(i * x for i, x in enumerate(p)), 4), **out, "legend": dict(question.criteria)}
    return {"choice": question.options[best], **out}


def payload(question: Question, p: Column) -> Column:
    """:func:`answer` as a struct of columns, for whole tables."""
    k = F.round(A.shape_confidence(p), 4)
    if question.kind == "noul":
        return F.struct(F.round(F.get(p, F.lit(1)), 4).alias("probability"))
    value = F.get(F.array(*map(F.lit, question.options)), A.argmax(p)).alias("choice") if question.kind == "choice" else F.round(A.expected_level(p), 4).alias("score")
    return F.struct(value, k.alias("confidence"), F.map_from_arrays(F.array(*map(F.lit, question.options)), F.transform(p, lambda x: F.round(x, 4))).alias("probabilities"))


def first_token_distribution(tokens: list[tuple[str, float]], options: list[str]) -> list[float] | None:
    """A vector from the log-probabilities of a reply's first token: each token counts for the options it begins, then softmax."""
    sums: list[float | None] = [None] * len(options)
    for token, logp in tokens:
        said = token.strip().lower()
        if not said:
            continue
        for i, o in enumerate(options):
            if o.lower().startswith(said):
                sums[i] = logp if sums[i] is None else max(sums[i], logp) + math.log1p(math.exp(-abs(sums[i] - logp)))
    if all(s is None for s in sums):
        return None
    top = max(s for s in sums if s is not None)
    e = [0.0 if s is None else math.exp(s - top) for s in sums]
    return [x / sum(e) for x in e]


def objective(replies: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(score, answered, asked): mean of 1 - Brier / 2 over the gold answers, 0 for a missing one; what a prompt search maximises."""
    rows = gold.join(replies, [*keys, "question"], "left")
    good = F.when(F.col("p").isNotNull(), 1 - A.brier(F.col("p"), F.col("y")) / 2).otherwise(A.lit(0))
    return rows.agg(F.avg(good).alias("score"), F.count("p").alias("answered"), F.count("*").alias("asked"))


def serialise(questions: dict[str, Question]) -> str:
    return json.dumps({q: x.to_dict() for q, x in questions.items()}, ensure_ascii=False)


def deserialise(text: str) -> dict[str, Question]:
    return {q: Question.from_dict(d) for q, d in json.loads(text).items()}


@dataclass
class Ensemble:
    """Several judges as one: ``judges`` map a name to (weight, function of a document giving question → vector)."""

    judges: dict[str, tuple[float, object]]
    options: dict[str, list[str]] = field(default_factory=dict)

    def __call__(self, prompt_text: str, text: str) -> str:
        sums: dict[str, list[float]] = {}
        mass: dict[str, float] = {}
        for weight, judge in self.judges.values():
            for q, p in judge(prompt_text, text).items():
                if p is None:
                    continue
                old = sums.setdefault(q, [0.0] * len(p))
                sums[q] = [a + weight * b for a, b in zip(old, p)]
                mass[q] = mass.get(q, 0.0) + weight
        named = {q: {"probabilities": dict(zip(self.options[q], [x / mass[q] for x in v]))} for q, v in sums.items() if mass[q] > 0}
        return json.dumps({"answers": named})
