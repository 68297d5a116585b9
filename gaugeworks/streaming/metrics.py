"""File metrics over a stream of files.

The metrics of a file need no state, so they are the batch expressions; the corpus
aggregate keeps one row of state for each (metric, key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def figures(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(path, metric, key, value) of a streaming table (path, content): append mode."""
    return metrics.file_metrics(files, names)


def running_codebase(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The partial aggregate of all files so far (for `aggregate.finalize`): update
    or complete mode."""
    v = F.col("value")
    return figures(files, names).groupBy("metric", "key").agg(
        F.count("*").alias("n"), F.sum(v.cast("decimal(38, 6)")).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Number and sum of the values of (ts, event_type, value) by tumbling window, with
    rows that come later than the watermark left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
