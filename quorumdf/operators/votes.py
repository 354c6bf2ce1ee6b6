"""Several answers to one thing: majorities, shares, pooling, agreement between teachers.

Votes are long: (item keys, question, teacher, p).  Counting operators take hard labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.functions.text import INVALID


def majority(ballots: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """(keys, label, confidence): the most frequent valid label, the one cast first among equals.

    ``confidence`` is its share of all ballots, invalid (null) ones included, to two places; a lone
    ballot has 1.  Without a valid ballot the label is ``__invalid__`` with confidence 0.
    """
    cast = ballots.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    valid = F.col(label).isNotNull()
    best = F.max(F.when(valid, F.struct("n", F.negative(F.col("first")).alias("early"), F.col(label).alias("label"))))
    out = cast.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("all"))
    return out.select(*keys, F.coalesce("best.label", F.lit(INVALID)).alias(label), F.coalesce(F.round(F.col("best.n") / F.col("all"), 2), A.lit(0)).alias("confidence"))


def shares(ballots: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label, share): each label's share of the valid ballots."""
    counted = ballots.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")


#: Entries up to which vectors are summed as columns of one aggregate.
WIDE = 64


def _sum_vectors(votes: DataFrame, keys: list[str], weight=None, width: int | None = None) -> DataFrame:
    """Entry-wise sum of the vectors of a group, and their number.

    With a known ``width`` (the most options of any question) each entry is a column of one hash
    aggregate and a group is shuffled once.  Without, entries become rows, whose sums combine before the shuffle too.
    """
    w = A.lit(1) if weight is None else weight
    if width is not None and width <= WIDE:
        sums = votes.select(*keys, w.alias("w"), "p").groupBy(*keys).agg(F.count("*").cast("int").alias("n"), *[F.sum(F.col("w") * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(width)])
        return sums.select(*keys, F.filter(F.array(*[F.col(f"s{i}") for i in range(width)]), lambda x: x.isNotNull()).alias("p"), "n")
    flat = votes.select(*keys, w.alias("w"), F.posexplode("p").alias("i", "x"))
    sums = flat.groupBy(*keys, "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.count("*").alias("n"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"), F.max("n").cast("int").alias("n"))


def average(votes: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """(keys, p, n): mean of the available vectors, normalised."""
    return _sum_vectors(votes, keys, width=width).withColumn("p", A.normalise(F.col("p")))


def ensemble(votes: DataFrame, keys: list[str], weights: dict[str, float], width: int | None = None) -> DataFrame:
    """(keys, p, n): weighted mean of the available vectors; teachers without a weight take no part."""
    mass = sum(weights.values())
    table = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w / mass)])
    known = votes.withColumn("__w", F.element_at(table, F.col("teacher"))).filter("__w is not null")
    return _sum_vectors(known, keys, F.col("__w"), width).withColumn("p", A.normalise(F.col("p")))


def pairwise(votes: DataFrame, item: list[str], question: str = "question") -> DataFrame:
    """(teacher_a, teacher_b, same, total, agreement): how often two teachers choose the same option.

    The answers of one item are gathered and paired inside their row, so the work is items times squared teachers, and
    only counts are shuffled.
    """
    said = votes.select(*item, question, "teacher", A.argmax(F.col("p")).alias("said"))
    rows = said.groupBy(*item, question).agg(F.array_sort(F.collect_list(F.struct("teacher", "said"))).alias("v"))
    n = F.size("v")
    later = F.transform("v", lambda a, i: F.transform(F.slice("v", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.struct(a["teacher"].alias("teacher_a"), b["teacher"].alias("teacher_b"), (a["said"] == b["said"]).cast("int").alias("same"))))
    flat = rows.select(F.explode(F.flatten(later)).alias("x")).select("x.*")
    return flat.groupBy("teacher_a", "teacher_b").agg(F.sum("same").alias("same"), F.count("*").alias("total")).withColumn("agreement", F.round(F.col("same") / F.col("total"), 4))


def status(votes: DataFrame, combined: DataFrame, item: list[str], teachers: int, sure: float = 0.6) -> DataFrame:
    """(item, state) per document, the worst over its questions: split, missing, unsure or agree."""
    per = votes.groupBy(*item, "question").agg(F.count_distinct(A.argmax(F.col("p"))).alias("kinds"), F.count("*").alias("n"))
    both = per.join(combined.select(*item, "question", A.top(F.col("p")).alias("top")), [*item, "question"], "left")
    rank = F.when(F.col("kinds") > 1, 3).when(F.col("n") < teachers, 2).when(F.coalesce("top", A.lit(0)) < sure, 1).otherwise(0)
    worst = both.groupBy(*item).agg(F.max(rank).alias("r"))
    return worst.select(*item, F.element_at(F.array(*map(F.lit, ("agree", "unsure", "missing", "split"))), F.col("r") + 1).alias("state"))


def influence(votes: DataFrame, item: list[str], teachers: int, width: int | None = None) -> DataFrame:
    """(teacher, influence): how far the pooled vector moves when one teacher is left out, as a share of all such moves.

    Only items that all teachers answered count.  The vector without a teacher is the sum less its own.
    """
    keys = [*item, "question"]
    sums = _sum_vectors(votes, keys, width=width).filter(F.col("n") == teachers).select(*keys, F.col("p").alias("all"))
    met = votes.join(sums, keys)
    rest = A.normalise(F.zip_with("all", "p", lambda a, b: a - b))
    moved = met.groupBy("teacher").agg(F.avg(A.total_variation(A.normalise(F.col("all")), rest)).alias("m"))
    mass = F.sum("m").over(Window.partitionBy())  # a handful of rows, one per teacher
    return moved.select("teacher", F.when(mass > 0, F.col("m") / mass).otherwise(1.0 / teachers).alias("influence"))


def gold_disagreements(votes: DataFrame, gold: DataFrame, keys: list[str], options: DataFrame, most: int = 5, width: int | None = None) -> DataFrame:
    """(question, gold, said, n, rank): the most frequent confusions of the pooled answer with the truth."""
    pooled = average(votes, [*keys, "question"], width).withColumn("said", A.argmax(F.col("p")))
    wrong = pooled.join(gold, [*keys, "question"]).filter("said <> y").groupBy("question", "y", "said").agg(F.count("*").alias("n"))
    ranked = wrong.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("n"), "y", "said"))).filter(F.col("rank") <= most)
    named = ranked.join(options.select("question", "options"), "question")
    return named.select("question", F.get("options", F.col("y")).alias("gold"), F.get("options", F.col("said")).alias("said"), "n", "rank")
