"""Skew-safe joins and lineage cuts.

Every operator that joins rows back to an aggregate of themselves goes through
these helpers, so that one key holding a third of all rows is spread over many
tasks instead of landing in one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in tests on one machine, a temporary
    folder is made; it is set as checkpoint directory too.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster the tables in between need a folder that all executors share")
        path = getattr(spark, "_quorumdf_shared", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="quorumdf-")
            spark._quorumdf_shared = path
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The table survives the loss of any executor, is columnar, and lets the
    optimizer prune columns on each later read (checkpoint() files do not).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quorumdf/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that its address names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def local_path(uri: str) -> str:
    return uri[7:] if uri.startswith("file://") else uri


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, which has one row per key and the key's row count in ``size``.

    Keys with ``HOT_SHARE`` of the ``total`` rows or more are joined by broadcast: there can be
    no more than ``1 / HOT_SHARE`` (1,000) of them, whatever the data, and their rows are not
    shuffled at all.  All other keys are shuffled; none of them fills more than that share of
    the rows.  ``rows`` is read twice, so pass a table or a cheap plan.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    cold = groups.filter(F.col(size) < least)
    direct = rows.join(hot, keys, "inner")
    shuffled = rows.join(F.broadcast(groups.filter(F.col(size) >= least).select(*keys)), keys, "left_anti").join(cold, keys, "inner")
    return direct.unionByName(shuffled)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for CPU-heavy Python stages over few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
