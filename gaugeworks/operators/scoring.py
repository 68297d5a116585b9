"""Behaviours: weight vectors over aggregate keys, learned and applied.

A behaviour (category, behavior) has a scalar for some (grp, key).  Weight tables are
data, not code: `learn` makes them from labelled files, `load` reads them.  They are
small dimensions (checked), so the aggregate is broadcast-joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import r4

#: Logarithm of a zero: the least number that still has one here.
TINY = 1e-300
TINY_LOG = -690.7755


def load(spark: SparkSession, path: str) -> DataFrame:
    """category, behavior, grp, key, scalar from JSON lines or Parquet."""
    schema = "category string, behavior string, grp string, key string, scalar double"
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(schema).json(path)


def _ln(value: Column) -> Column:
    """A present zero counts as TINY, an absent value as 1."""
    return F.coalesce(F.ln(F.greatest(value, F.lit(TINY))), F.lit(0.0))


def product_scores(aggregate: DataFrame, weights: DataFrame) -> DataFrame:
    """Logarithm of the product of powers; values that are absent or not positive
    count as 1."""
    d = weights.join(aggregate, ["grp", "key"], "left")
    log = F.when(F.col("value") > 0, F.ln(F.when(F.col("value") > 0, F.col("value")).otherwise(1.0))).otherwise(0.0)
    return d.groupBy("category", "behavior").agg(r4(F.sum(F.col("scalar") * log)).alias("log_score"))


def cosines(aggregate: DataFrame, weights: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cosine of each behaviour's scalars and the logarithms of the aggregate (of each
    unit of `by` that has one of its keys); 0 where one of them has no length."""
    keyed = ["category", "behavior"]
    sizes = weights.groupBy(*keyed).agg(F.sum(F.col("scalar") * F.col("scalar")).alias("ss"))
    # an absent key has the logarithm 0 and adds to no sum but that of the scalars
    d = aggregate.join(F.broadcast(weights), ["grp", "key"]).withColumn("l", _ln(F.col("value")))
    s = d.groupBy(*by, *keyed).agg(F.sum(F.col("scalar") * F.col("l")).alias("dot"), F.sum(F.col("l") * F.col("l")).alias("ll"))
    s = s.join(F.broadcast(sizes), keyed) if by else s.join(sizes, keyed, "right")
    size = F.sqrt(F.col("ss")) * F.sqrt(F.col("ll"))
    return s.select(*by, *keyed, r4(F.coalesce(F.col("dot") / F.nullif(size, F.lit(0.0)), F.lit(0.0))).alias("cosine"))


def top_metrics(aggregate: DataFrame, weights: DataFrame, n: int = 5) -> DataFrame:
    """The n smallest contributions to each behaviour; ties by group and key."""
    d = weights.join(aggregate, ["grp", "key"], "left").withColumn("contribution", r4(F.col("scalar") * _ln(F.col("value"))))
    rank = F.row_number().over(W.partitionBy("category", "behavior").orderBy("contribution", "grp", "key"))
    return d.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("category", "behavior", "rank", "grp", "key", "contribution")


def worst_files(cosines_by_file: DataFrame, limit: float = 0.15, n: int = 2) -> DataFrame:
    """The n files of each behaviour with the lowest cosine, -limit or less."""
    rank = F.row_number().over(W.partitionBy("category", "behavior").orderBy("cosine", "path"))
    return cosines_by_file.where(F.col("cosine") <= -limit).withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def learn(good: DataFrame, bad: DataFrame) -> DataFrame:
    """grp, key, ratio, scalar from the aggregates of good and of bad files: the
    difference of logarithms, 2 for the largest; keys without a difference go."""
    g, b = (x.where("value > 0").select("grp", "key", F.col("value").alias(n)) for x, n in ((good, "good"), (bad, "bad")))
    d = g.join(b, ["grp", "key"]).withColumn("diff", F.ln("good") - F.ln("bad")).withColumn("ratio", F.col("good") / F.col("bad"))
    most = d.agg(F.max(F.abs("diff"))).scalar()
    d = d.withColumn("scalar", F.coalesce(2 * F.col("diff") / F.nullif(most, F.lit(0.0)), F.lit(0.0))).where(~F.col("ratio").between(0.995, 1.005))
    return d.select("grp", "key", "good", "bad", r4(F.col("ratio")).alias("ratio"), r4(F.col("scalar")).alias("scalar"))


def baseline(learned: DataFrame) -> DataFrame:
    """The logarithm that the learned scalars give the geometric mean of both sides."""
    return learned.agg(r4(F.sum(F.col("scalar") * F.ln(F.sqrt(F.col("good") * F.col("bad"))))).alias("log_baseline"))
