"""Snapshots of a corpus: what changed between two of them, and where.

Snapshots are tables of files (path, content).  Diffs are tables of text lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def changed(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status (added, modified, deleted); only digests are shuffled."""
    sides = [d.select("path", F.sha2(F.col("content").cast("binary"), 256).alias(n)) for d, n in ((base, "b"), (head, "h"))]
    d = sides[0].join(sides[1], "path", "full").where(~F.col("b").eqNullSafe(F.col("h")))
    return d.select("path", F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "deleted").otherwise("modified").alias("status"))


def diff_ranges(lines: DataFrame) -> DataFrame:
    """path, first, last of the line ranges that a unified diff (diff, no, line) sets
    in the new files.  Hunks of no lines are dropped; an absent count is one line."""
    path = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+?)\s*$", 1)
    d = lines.withColumn("path", F.last(F.when(F.col("line").startswith("+++ "), path), ignorenulls=True).over(W.partitionBy("diff").orderBy("no")))
    hunk = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    d = d.where(F.col("line").rlike(hunk))
    first, n = F.regexp_extract("line", hunk, 1).cast("long"), F.regexp_extract("line", hunk, 2)
    count = F.when(n == "", F.lit(1)).otherwise(F.expr("try_cast(regexp_extract(line, r'^@@ -[0-9]+(?:,[0-9]+)? \\+[0-9]+,([0-9]+)', 1) AS bigint)"))
    return d.select("path", first.alias("first"), (first + count - 1).alias("last")).where("last >= first")
