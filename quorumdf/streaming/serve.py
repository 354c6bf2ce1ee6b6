"""Serving a student on a stream: score, route, and send what is not local to a fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quorumdf.functions import arrays as A
from quorumdf.operators.heads import Student


def serve(source: DataFrame, student: Student, sink: str, checkpoint: str, fallback: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start a stateless stream: each micro-batch is scored once, local rows and the fallback's answers are appended to ``sink``.

    A batch is written under its number and replaced if it is run again, so a restart neither loses nor repeats rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        scored = student.score(batch).persist()
        done = scored.filter("local") if student.threshold is not None else scored
        if fallback is not None and student.threshold is not None:
            done = done.unionByName(fallback(scored.filter("not local").select(*batch.columns)), allowMissingColumns=True)
        done.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        scored.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drift(answers: DataFrame, time: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, question, n, mean_confidence) of answers per window, on a stream or a table; rows later than ``late`` are left out of a stream."""
    rows = answers.withWatermark(time, late) if answers.isStreaming else answers
    return rows.groupBy(F.window(time, every), "question").agg(F.count("*").alias("n"), F.avg(A.top(F.col("p"))).alias("mean_confidence")).select(F.col("window.start").alias("start"), "question", "n", "mean_confidence")
