"""Made-up tickets for a first try, the same at every run and of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = {
    "payment": ("I was charged {} times for one order", "The refund of {} euros is missing"),
    "defect": ("The app stops at step {}", "Button {} does nothing since the update"),
    "access": ("My {} digit code is refused", "I am locked out since {} days"),
}


def tickets(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, text, label): each row is a function of its number and the seed, so partitions need not agree on anything."""
    labels = F.array(*map(F.lit, LABELS))
    shapes = F.array(*[F.array(*map(F.lit, v)) for v in LABELS.values()])
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30))
    rows = spark.range(n).withColumn("l", (h(1) % len(LABELS)).cast("int")).withColumn("s", (h(2) % 2).cast("int")).withColumn("k", (h(3) % 98 + 2).cast("string"))
    shape = F.get(F.get(shapes, F.col("l")), F.col("s"))
    return rows.select("id", F.replace(shape, F.lit("{}"), F.col("k")).alias("text"), F.get(labels, F.col("l")).alias("label"))
