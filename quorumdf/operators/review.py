"""Human review: queues of what to look at, an append-only ledger of decisions, and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.functions.text import INVALID, hash_unit
from quorumdf.operators.tables import keep_last

UNSURE, SETTLED, AUDIT = 0.6, 0.9, 0.05


def majority_queue(labelled: DataFrame, key: str) -> DataFrame:
    """Rows whose label is not unanimous or invalid, least sure first."""
    return labelled.filter((F.col("confidence") < 1.0) | (F.col("label") == INVALID)).orderBy(F.col("confidence").asc_nulls_first(), key)


def single_queue(answers: DataFrame, options: DataFrame, keys: list[str], reviewed: DataFrame | None = None) -> DataFrame:
    """(keys, question, answer, top, why) of answers that are missing or unsure."""
    rows = answers.join(options.select("question", "options"), "question")
    ranked = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    first, second = F.get(ranked, F.lit(0))["i"], F.get(ranked, F.lit(1))["i"]
    why = F.when(F.col("p").isNull(), F.lit("no answer")).otherwise(F.concat(F.lit("unsure: "), F.get("options", first), F.lit(" vs "), F.get("options", second)))
    out = rows.filter(F.col("p").isNull() | (A.top(F.col("p")) < UNSURE)).select(*keys, "question", F.get("options", first).alias("answer"), A.top(F.col("p")).alias("top"), why.alias("why"))
    return minus_ledger(out, reviewed, [*keys, "question"])


def panel_queue(combined: DataFrame, votes: DataFrame, keys: list[str], teachers: int, reviewed: DataFrame | None = None) -> DataFrame:
    """(keys, question, top, kinds, n, why) of answers that are split below ``SETTLED``, missing teachers, or unsure."""
    counts = votes.groupBy(*keys, "question").agg(F.count_distinct(A.argmax(F.col("p"))).alias("kinds"), F.count("*").alias("n"))
    rows = combined.select(*keys, "question", A.top(F.col("p")).alias("top")).join(counts, [*keys, "question"], "left")
    why = F.when((F.col("kinds") > 1) & (F.col("top") < SETTLED), "split").when(F.col("n") < teachers, "missing").when(F.col("top") < UNSURE, "unsure")
    return minus_ledger(rows.withColumn("why", why).filter("why is not null"), reviewed, [*keys, "question"])


def minus_ledger(queue: DataFrame, ledger: DataFrame | None, keys: list[str]) -> DataFrame:
    return queue if ledger is None else queue.join(ledger.select(*keys).distinct(), keys, "left_anti")


def audit(settled: DataFrame, key: str, share: float = AUDIT, seed: int = 42) -> DataFrame:
    """A seeded sample of the settled rows, by hash: the same rows whatever the partitioning, no sort."""
    return settled.filter(hash_unit(F.lit(seed), F.col(key).cast("string")) < share)


def interleave(queue: DataFrame, sample: DataFrame, order: str, key: str) -> DataFrame:
    """The queue with the sample's rows spread evenly through it: a sort position for each, no driver-side merge."""
    n, m = queue.count(), sample.count()
    every = max(1, n // m) if m else 1
    from quorumdf.plans.ranks import running

    a = running(queue, [], [(order, True), (key, True)]).withColumn("place", F.col("row_no") * 1.0).drop("row_no", "group_n")
    b = running(sample, [], [(key, True)]).withColumn("place", F.col("row_no") * float(every) + 0.5).drop("row_no", "group_n")
    return a.unionByName(b, allowMissingColumns=True).orderBy("place", key)


def current(ledger: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The ledger's last decision per key."""
    return keep_last(ledger, keys, seq)


def apply_labels(labelled: DataFrame, ledger: DataFrame, keys: list[str], label: str = "label", seq: str = "seq") -> DataFrame:
    """Labels with the last human decision in place, at confidence 1; a decision that was undone (null label) changes nothing."""
    last = current(ledger, keys, seq).filter(F.col(label).isNotNull()).select(*keys, F.col(label).alias("__human"))
    return labelled.join(last, keys, "left").withColumn("confidence", F.when(F.col("__human").isNotNull(), 1.0).otherwise(F.col("confidence"))).withColumn(label, F.coalesce("__human", label)).drop("__human")


def apply_answers(answers: DataFrame, ledger: DataFrame, keys: list[str], options: DataFrame, seq: str = "seq") -> DataFrame:
    """Vectors with the last human answer (an option's name) as a one-hot vector."""
    last = current(ledger, [*keys, "question"], seq).select(*keys, "question", F.col("answer").alias("__human"))
    rows = answers.join(last, [*keys, "question"], "left").join(options.select("question", "options"), "question")
    hot = A.one_hot(F.array_position("options", F.col("__human")) - 1, F.size("options"))
    return rows.withColumn("p", F.when(F.array_contains("options", F.col("__human")), hot).otherwise(F.col("p"))).select(*answers.columns)


def undo(ledger: DataFrame, which: DataFrame, keys: list[str], seq: str = "seq", label: str = "label") -> DataFrame:
    """The ledger with an entry appended for each key of ``which``: a null decision that supersedes the ones before."""
    last = ledger.agg(F.max(seq)).first()[0] or 0
    gone = which.select(*keys).distinct().join(ledger.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit(last + 1).cast(dict(ledger.dtypes)[seq]).alias(seq), F.lit(None).cast("string").alias(label))
    return ledger.unionByName(gone, allowMissingColumns=True)


def unknown_reviews(ledger: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions on rows that are not in the pool, to be reported."""
    return ledger.join(pool.select(*keys), keys, "left_anti")
