"""Scores, grades and reports from aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Least score of each letter.
SCALE = (
    (93, "A"), (85, "A-"), (78, "B+"), (72, "B"), (67, "B-"), (63, "C+"), (55, "C"), (48, "C-"), (42, "D+"), (35, "D"), (25, "D-"),
    (18, "E+"), (12, "E"), (6, "E-"),
)

#: Category, metric, key, which end is good, thresholds a to d, weight.
CATEGORIES = (
    ("readability", "readability", "flesch_adapted", "high", 70, 50, 35, 20, 0.4),
    ("readability", "readability", "fog_adapted", "low", 6, 10, 15, 22, 0.3),
    ("readability", "readability", "avg_tokens_per_line", "low", 6, 10, 14, 20, 0.2),
    ("readability", "readability", "avg_line_length", "low", 40, 60, 80, 100, 0.1),
    ("complexity", "halstead", "difficulty", "low", 10, 20, 35, 50, 0.35),
    ("complexity", "halstead", "effort", "low", 5000, 20000, 50000, 100000, 0.3),
    ("complexity", "halstead", "volume", "low", 300, 1000, 3000, 8000, 0.2),
    ("complexity", "halstead", "estimated_bugs", "low", 0.1, 0.5, 1.0, 3.0, 0.15),
    ("structure", "branching", "branching_density", "low", 0.08, 0.17, 0.30, 0.45, 0.25),
    ("structure", "indentation", "mean_depth", "low", 3.5, 7, 10, 15, 0.2),
    ("structure", "function_metrics", "avg_function_lines", "low", 8, 15, 30, 65, 0.2),
    ("structure", "indentation", "max_depth", "low", 8, 16, 25, 35, 0.1),
    ("structure", "function_metrics", "max_function_lines", "low", 20, 50, 100, 200, 0.1),
    ("structure", "indentation", "variance", "low", 7, 20, 40, 65, 0.1),
    ("structure", "function_metrics", "avg_param_count", "low", 2, 3, 5, 7, 0.03),
    ("structure", "function_metrics", "max_param_count", "low", 3, 5, 7, 10, 0.02),
    ("duplication", "compression", "redundancy", "low", 0.3, 0.5, 0.65, 0.8, 0.5),
    ("duplication", "ngram", "bigram_repetition_rate", "low", 0.15, 0.30, 0.45, 0.60, 0.3),
    ("duplication", "ngram", "trigram_repetition_rate", "low", 0.05, 0.15, 0.30, 0.45, 0.2),
    ("naming", "casing_entropy", "entropy", "low", 1.0, 1.5, 2.0, 2.3, 0.3),
    ("naming", "identifier_length_variance", "mean", "low", 12, 18, 25, 35, 0.25),
    ("naming", "identifier_length_variance", "variance", "low", 15, 30, 50, 80, 0.25),
    ("naming", "readability", "avg_sub_words_per_id", "low", 3, 4, 5, 7, 0.2),
    ("magic_numbers", "magic_number_density", "density", "low", 0.02, 0.05, 0.10, 0.20, 1.0),
)

#: Impact of each category on the overall score; others count 1.
IMPACT = {"complexity": 5, "file_structure": 4, "function_design": 4, "code_smells": 3, "naming_conventions": 2, "error_handling": 2, "consistency": 2}


def thresholds(spark: SparkSession, rows=CATEGORIES) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows], "category string, metric string, key string, good string, a double, b double, c double, d double, weight double")


def _between(v: Column, a: Column, at_a: float, b: Column, at_b: float) -> Column:
    return F.when(a == b, F.lit(float(at_a))).otherwise(F.round(at_a + (v - a) / F.nullif(b - a, F.lit(0.0)) * (at_b - at_a)))


def score_metric(v: Column, good: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Score of a value: 100 past a, then 90, 70, 50, 30 at a, b, c, d and straight
    lines between, falling to 0 beyond d."""
    sign = F.when(good == "high", -1.0).otherwise(1.0)
    x, (p, q, r, s) = v * sign, (t * sign for t in (a, b, c, d))
    beyond = F.when(d == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), 30 - 30 * F.abs(v - d) / F.nullif(d, F.lit(0.0)))))
    score = (
        F.when(x < p, 100.0).when(x == p, 90.0).when(x <= q, _between(v, a, 90, b, 70)).when(x <= r, _between(v, b, 70, c, 50))
        .when(x <= s, _between(v, c, 50, d, 30)).otherwise(beyond)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


def score_cosine(x: Column) -> Column:
    """Score of a cosine: -1, -0.3, 0, 0.2, 0.5, 1 are 0, 30, 50, 70, 90, 100."""
    at = ((-1.0, 0), (-0.3, 30), (0.0, 50), (0.2, 70), (0.5, 90), (1.0, 100))
    score = None
    for (lo, p), (hi, q) in zip(at[-2::-1], at[:0:-1], strict=True):
        line = F.round(p + (x - lo) / (hi - lo) * (q - p))
        score = F.when(x >= lo, line) if score is None else score.when(x >= lo, line)
    return F.greatest(F.lit(0), F.least(F.lit(100), score.otherwise(0.0))).cast("long")


def letter(score: Column, scale=SCALE, lowest: str = "F") -> Column:
    out = F.when(F.lit(False), lowest)
    for least, name in scale:
        out = out.when(score >= least, name)
    return out.otherwise(lowest)


def scored(values: DataFrame, by: list[str], limits: DataFrame) -> DataFrame:
    """Scores of `values` (by, metric, key, value) that have thresholds, a few dozen rows."""
    d = values.join(F.broadcast(limits), ["metric", "key"])
    return d.withColumn("score", score_metric(*(F.col(c) for c in ("value", "good", "a", "b", "c", "d"))))


def grade_categories(values: DataFrame, by: list[str], limits: DataFrame) -> DataFrame:
    """Weighted mean score and letter of each category over the metrics present; a
    category without any scores 0 where `by` is empty."""
    weight = F.col("weight").cast("decimal(10, 4)")
    got = scored(values, by, limits).groupBy(*by, "category").agg((F.sum(weight * F.col("score")).cast("double") / F.sum(weight).cast("double")).alias("m"), F.count("*").alias("n_metrics"))
    if not by:
        got = limits.select("category").distinct().join(got, "category", "left")
    score = F.coalesce(F.round("m"), F.lit(0.0)).cast("long")
    return got.select(*by, "category", F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"), score.alias("score")).withColumn("grade", letter(F.col("score")))


def overall(grades: DataFrame, impact: dict[str, int] = IMPACT) -> DataFrame:
    """Impact-weighted mean of category scores; 0 and F for none."""
    weight = F.lit(1)
    for name, w in impact.items():
        weight = F.when(F.col("category") == name, w).otherwise(weight)
    s = grades.agg(F.sum(F.col("score") * weight).alias("s"), F.sum(weight).alias("w"))
    return s.select(F.coalesce(F.round(F.col("s") / F.nullif("w", F.lit(0))), F.lit(0.0)).cast("long").alias("overall_score")).withColumn("overall_grade", letter(F.col("overall_score")))


def worst_offenders(values: DataFrame, limits: DataFrame, n: int = 5) -> DataFrame:
    """The n files with the lowest score in each category; ties by path."""
    rank = F.row_number().over(W.partitionBy("category").orderBy("score", "path"))
    return grade_categories(values, ["path"], limits).withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def summary(score: Column, poor: Column) -> Column:
    """A category in words."""
    return F.when(score >= 90, "Excellent").when((score >= 70) & (poor > 0), F.concat(poor.cast("string"), F.lit(" metric(s) need attention"))).when(score >= 70, "Good").when(score >= 50, "Needs improvement").otherwise("Critical")


def passes(grade: Column, least: str, scale=SCALE) -> Column:
    """The grade is `least` or better."""
    names = [x for _, x in scale] + ["F"]
    return F.array_position(F.array(*(F.lit(x) for x in names)), grade) <= names.index(least) + 1
