"""Row operators: de-duplication, leak guards, label checks, reshaping, relabelling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.functions.text import hash_unit, is_blank
from quorumdf.plans.ranks import running


# -- duplicates ------------------------------------------------------------------------------------------------------
def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by ``order``; combined before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("x"))
    return best.select(*keys, "x.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``: the current state of an append-only log."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.col(order)).alias("x"))
    return best.select(*keys, "x.*").select(*df.columns)


# -- guards ----------------------------------------------------------------------------------------------------------
def without(df: DataFrame, *others: DataFrame, on: str = "text") -> DataFrame:
    """Rows whose ``on`` stands in none of the other frames; a null never matches."""
    for other in others:
        df = df.join(other.select(on).distinct(), on, "left_anti")
    return df


def overlap_count(df: DataFrame, other: DataFrame, on: str = "text") -> DataFrame:
    return df.join(other.select(on).distinct(), on, "left_semi").agg(F.count("*").alias("n"))


def blank_rows(df: DataFrame, *columns: str) -> DataFrame:
    """(column, blank, rows): how many entries of each column are null or white space."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(is_blank(F.col(c))).alias(c) for c in columns])
    return counts.unpivot("rows", list(columns), "column", "blank").select("column", "blank", "rows")


def unknown_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, n): labels that are not in the dimension."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).join(labels.select(label), label, "left_anti")


def class_sizes(df: DataFrame, labels: DataFrame, label: str = "label", least: int = 8) -> DataFrame:
    """(label, n, enough) of every known label, with 0 for one that has no row."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return labels.select(label).join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n")).withColumn("enough", F.col("n") >= least)


def require(df: DataFrame, problem: str) -> None:
    """Raise if a guard's frame has a row."""
    if not df.isEmpty():
        raise ValueError(f"{problem}: {[r.asDict() for r in df.take(5)]}")


# -- shape -----------------------------------------------------------------------------------------------------------
def to_options(votes: DataFrame, options: DataFrame) -> DataFrame:
    """Vectors to one row per option: adds ``option_idx``, ``option`` and ``prob``."""
    rows = votes.join(options.select("question", "options"), "question")
    flat = rows.select(*[c for c in votes.columns if c != "p"], "options", F.posexplode("p").alias("option_idx", "prob"))
    return flat.select(*[c for c in flat.columns if c != "options"], F.get("options", F.col("option_idx")).alias("option"))


def to_wide(votes: DataFrame, keys: list[str], question: str, options: list[str]) -> DataFrame:
    """One column ``question__option`` per option of one question; no shuffle, a vector is only spread out."""
    rows = votes.filter(F.col("question") == question)
    return rows.select(*keys, *[F.get("p", F.lit(i)).alias(f"{question}__{o}") for i, o in enumerate(options)])


def from_wide(df: DataFrame, keys: list[str], question: str, options: list[str]) -> DataFrame:
    p = F.array(*[F.col(f"{question}__{o}").cast("double") for o in options])
    return df.select(*keys, F.lit(question).alias("question"), F.when(~F.exists(p, lambda x: x.isNull()), p).alias("p"))


def merge_options(p: Column, source: int, target: int) -> Column:
    """Add the mass of one option to another and drop it; later options move up."""
    added = F.transform(p, lambda x, i: F.when(i == target, x + F.get(p, F.lit(source))).otherwise(x))
    return F.filter(added, lambda x, i: i != source)


def drop_option(p: Column, source: int) -> Column:
    """Drop an option and share its mass in proportion; null if nothing is left."""
    return A.normalise(F.filter(p, lambda x, i: i != source))


def relabel(df: DataFrame, mapping: dict[str, str | None], label: str = "label") -> DataFrame:
    """Rename or merge labels; a label mapped to None is removed with its rows."""
    gone = [k for k, v in mapping.items() if v is None]
    kept = {k: v for k, v in mapping.items() if v is not None}
    out = df.filter(F.col(label).isNull() | ~F.col(label).isin(gone)) if gone else df
    return out.replace(kept, subset=[label]) if kept else out


# -- splits ----------------------------------------------------------------------------------------------------------
def hash_split(df: DataFrame, fraction: float, seed: int = 42, text: str = "text") -> DataFrame:
    """``split`` is test for the share of texts whose hash falls below ``fraction``: equal texts fall together, rows added later never move others."""
    return df.withColumn("split", F.when(hash_unit(F.lit(seed), F.col(text)) < fraction, "test").otherwise("dev"))


def _hash_order(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Rows numbered within their label in order of a hash of the key; a label of any size is spread over tasks."""
    hashed = df.withColumn("__h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256))
    return running(hashed, [label], [("__h", True), (key, True)]).drop("__h")


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """``split``: in each label the ``round(fraction * n)`` rows of smallest hash are test, the rest dev."""
    ranked = _hash_order(df, label, key, seed)
    return ranked.withColumn("split", F.when(F.col("row_no") <= F.floor(F.col("group_n") * fraction + 0.5), "test").otherwise("dev")).drop("row_no", "group_n")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1 by a hash of the key: no shuffle, stable under added rows."""
    return df.withColumn("fold", F.least(F.floor(hash_unit(F.lit(seed), F.col(key).cast("string")) * k), F.lit(k - 1)).cast("int"))


def lock_hash(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One hash of a split whatever its row order: the sum of 64-bit row hashes, with the number of rows.

    Adding is commutative and combines before the shuffle, so a split of any size is locked without sorting it.
    """
    row = F.conv(F.substring(F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("\t"), F.coalesce(label, F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("lock"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1 dealt round within each label, in order of a hash of the key."""
    return _hash_order(df, label, key, seed).withColumn("fold", ((F.col("row_no") - 1) % k).cast("int")).drop("row_no", "group_n")


def split_question(gold: DataFrame, keys: list[str]) -> str | None:
    """The question to stratify a panel's split by: answered for every row, two rows or more per class, other answers than the first nearest to half; None if there is none."""
    n = gold.select(*keys).distinct().count()
    sizes = gold.groupBy("question", "y").agg(F.count("*").alias("n"))
    per = sizes.groupBy("question").agg(F.sum("n").alias("rows"), F.min("n").alias("least"), F.count("*").alias("classes"), F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("other"))
    fit = per.filter((F.col("rows") == n) & (F.col("least") >= 2) & (F.col("classes") >= 2))
    best = fit.orderBy(F.abs(F.col("other") / F.col("rows") - 0.5), "question").first()  # one row per question
    return best["question"] if best else None


def head_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group; cut before the shuffle, so a hot group sends n rows per task."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("__k") <= n).drop("__k")


def rate(raters: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """(key, rate, raters): mean of 0/1 judgements of items that ``least`` or more people judged."""
    return raters.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias("rate"), F.count("*").alias("raters")).filter(F.col("raters") >= least)


def small_splits(dev: DataFrame, test: DataFrame, labels: DataFrame, label: str = "label") -> list[str]:
    """Warnings: labels of fewer than 25 test rows, a dev split of fewer than 100 rows."""
    few = [f"{r[label]} has {r['n']} test rows" for r in class_sizes(test, labels, label, 25).filter("not enough").orderBy(label).collect()]
    n = dev.limit(100).count()
    return few + ([f"the dev split has {n} rows"] if n < 100 else [])
