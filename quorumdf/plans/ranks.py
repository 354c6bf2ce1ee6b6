"""Ranks and running sums over a total order, without a window that holds a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumdf.plans.skew import cut


def running(df: DataFrame, group: list[str], order: list[tuple[str, bool]], sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``row_no`` (from 1), ``group_n`` and, for each ``new: column`` of ``sums``, its running sum within the group.

    ``order`` is a list of (column, ascending) that must be total within a group.  Rows are
    range-partitioned by group and order, numbered inside their partition, and shifted by what the
    partitions before hold: one row per partition and group is all that is gathered.
    """
    sums = sums or {}
    keys = [F.col(g).asc() for g in group] + [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
    local = Window.partitionBy("__part", *group).orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("row_no", F.count("*").over(local))
    for new, column in sums.items():
        rows = rows.withColumn(new, F.sum(column).over(local))
    parts = placed.groupBy("__part", *group).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{new}") for new, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    shift = parts.select(
        "__part", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("group_n"), *[F.coalesce(F.sum(f"__s_{new}").over(before), F.lit(0)).alias(f"__b_{new}") for new in sums]
    )
    same = F.col("r.__part") == F.col("s.__part")
    for g in group:  # a null group is a group
        same &= F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    joined = rows.alias("r").join(shift.alias("s"), same).select("r.*", *[F.col(f"s.{c}") for c in shift.columns if c not in ("__part", *group)])
    joined = joined.withColumn("row_no", F.col("row_no") + F.col("__before"))
    for new in sums:
        joined = joined.withColumn(new, F.col(new) + F.col(f"__b_{new}"))
    return joined.drop("__id", "__part", "__before", *[f"__b_{new}" for new in sums])


def tile(row_no: Column, n: Column, bins: int) -> Column:
    """``ntile``: the first n mod ``bins`` bins hold one row more."""
    small = F.floor(n / bins)
    larger = n - small * bins
    edge = larger * (small + 1)
    return F.when(row_no <= edge, F.ceil(row_no / (small + 1))).otherwise(larger + F.ceil((row_no - edge) / small)).cast("int")
