"""The answer relations: teachers' distributions per text and question, hand labels, ballots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumdf.functions import arrays as A
from quorumdf.functions.text import short_name
from quorumdf.sources.tables import table


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(question, kind, options), one row per question."""
    return table(spark, d, "questions").filter("question is not null").groupBy("question").agg(F.max("kind").alias("kind"), F.max("options").alias("options"))


def width(spark: SparkSession, d: str) -> int:
    """The most options of any question."""
    return int(questions(spark, d).agg(F.coalesce(F.max(F.size("options")), F.lit(0))).first()[0])


def read_probs(probs: Column, options: Column) -> Column:
    """The stored JSON list as a normalised vector; null unless it is finite, of the right length and of positive sum."""
    v = F.from_json(probs, "array<double>")
    sound = probs.rlike(r"^\s*\[.*\]\s*$") & (F.size(v) == F.size(options)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < A.lit(float("inf"))))
    return F.when(sound, A.normalise(v))


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery: (pool_id, question, teacher, kind, options, p, created_at, loaded_at); ``p`` null if unreadable."""
    rows = table(spark, d, "answers", "pool_id", "question", "model", "probs", "created_at", "loaded_at").join(questions(spark, d), "question")
    return rows.select("pool_id", "question", short_name(F.col("model")).alias("teacher"), "kind", "options", read_probs(F.col("probs"), F.col("options")).alias("p"), "created_at", "loaded_at")


def votes(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery per text, question and teacher, where it is readable: (pool_id, question, teacher, p)."""
    latest = stored(spark, d).groupBy("pool_id", "question", "teacher").agg(F.max(F.struct("created_at", "loaded_at", "p")).alias("x"))
    return latest.select("pool_id", "question", "teacher", F.col("x.p").alias("p")).filter("p is not null")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(pool_id, question, y): the label of a pool row as the truth of the topic question."""
    asked = questions(spark, d).filter("question = 'topic'")
    rows = table(spark, d, "pool_labeled", "pool_id", "label").join(asked, F.array_contains("options", F.col("label")))
    return rows.select("pool_id", "question", (F.array_position("options", F.col("label")) - 1).cast("int").alias("y"))


#: The same relations in DuckDB, as common table expressions.
SQL = """
kinds as (select question, max(kind) as kind, max(options) as options from questions where question is not null group by 1),
raw as (
  select a.pool_id, a.question, regexp_replace(lower(a.model), '^.*/|\\s+', '', 'g') as teacher, k.kind, k.options, a.created_at, a.loaded_at,
         case when a.probs is not null and regexp_matches(a.probs, '^\\s*\\[.*\\]\\s*$')
              then list_transform(string_split(trim(trim(a.probs), '[]'), ','), lambda x: try_cast(trim(x) as double)) end as v
  from answers a join kinds k using (question)
),
stored as (
  select pool_id, question, teacher, kind, options, created_at, loaded_at,
         case when len(v) = len(options) and len(list_filter(v, lambda x: x is not null and not isnan(x) and not isinf(x))) = len(v) and list_sum(v) > 0
              then list_transform(v, lambda x: x / list_sum(v)) end as p
  from raw
),
votes as (
  select pool_id, question, teacher, p from (
    select * from stored qualify row_number() over (partition by pool_id, question, teacher order by created_at desc nulls last, loaded_at desc nulls last, p desc nulls last) = 1
  ) where p is not null
),
gold as (
  select p.pool_id, k.question, cast(list_position(k.options, p.label) - 1 as integer) as y
  from pool_labeled p join kinds k on k.question = 'topic' and list_contains(k.options, p.label)
)
"""
