"""Behaviours with their descriptions: which languages they are for, baselines, grades.

Two dimension tables describe them: weights (category, behavior, grp, key, scalar) and
about (category, behavior, languages, excludes_languages, excludes_kinds, log_baseline,
hint, doc).  They come from YAML folders (`sources.behaviors`) or from `learned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import r4
from . import folds, grading, metrics, scoring

ABOUT = (
    "category string, behavior string, languages array<string>, excludes_languages array<string>, excludes_kinds array<string>, log_baseline double, "
    "hint string, doc string"
)
_KEY = ["category", "behavior"]


def default_scalars(spark: SparkSession) -> DataFrame:
    """grp, key, scalar of every figure of the standard metrics, at 0."""
    files = spark.createDataFrame([("p", "x")], "path string, content string")
    got = metrics.file_metrics(files).select(F.col("metric").alias("grp"), "key")
    return got.distinct().withColumn("scalar", F.lit(0.0))


def referenced(weights: DataFrame) -> DataFrame:
    """grp: the metrics that any behaviour uses."""
    return weights.select("grp").distinct()


def applies(of: Column, languages: list[str] | None) -> Column:
    """A behaviour for the languages `of` concerns a project or file of `languages`; no list
    on either side means all."""
    if not languages:
        return F.lit(True)
    return of.isNull() | (F.size(of) == 0) | F.arrays_overlap(of, F.array(*map(F.lit, languages)))


def chosen(weights: DataFrame, about: DataFrame, languages: list[str] | None) -> DataFrame:
    """The weights of the behaviours that concern the languages."""
    return weights.join(about.where(applies(F.col("languages"), languages)).select(*_KEY), _KEY, "left_semi")


def diagnosed(aggregate: DataFrame, weights: DataFrame, about: DataFrame, languages: list[str] | None = None, top: int | None = 15) -> DataFrame:
    """category, behavior, cosine, score: the behaviours with the lowest cosines, with their
    calibrated scores; ties by name."""
    own = chosen(weights, about, languages)
    d = scoring.cosines(aggregate, own).join(calibrated(aggregate, own, about), _KEY)
    return d if top is None else d.orderBy("cosine", *_KEY).limit(top)


def calibrated(aggregate: DataFrame, weights: DataFrame, about: DataFrame) -> DataFrame:
    """category, behavior, score: the logarithm of the product score less the behaviour's
    baseline, and rank in the category, the lowest first."""
    least = F.greatest("log_score", F.lit(scoring.TINY_LOG))
    d = scoring.product_scores(aggregate, weights).join(about.select(*_KEY, "log_baseline"), _KEY, "left")
    d = d.select(*_KEY, r4(least - F.coalesce("log_baseline", F.lit(0.0))).alias("score"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy("score", "behavior")).cast("long"))


def separation(good: DataFrame, bad: DataFrame, weights: DataFrame) -> DataFrame:
    """category, behavior, good_score, bad_score, ratio, direction_ok: how well the product
    scores tell aggregates of good from those of bad samples."""
    sides = [scoring.product_scores(x, weights).select(*_KEY, F.exp("log_score").alias(n)) for x, n in ((good, "good"), (bad, "bad"))]
    d = sides[0].join(sides[1], _KEY)
    ratio = F.when(F.col("bad") > 0, F.round(F.col("good") / F.col("bad"), 2)).otherwise(0.0)
    return d.select(*_KEY, r4(F.col("good")).alias("good_score"), r4(F.col("bad")).alias("bad_score"), ratio.alias("ratio"), (F.col("good") >= F.col("bad")).alias("direction_ok"))


def learned(good: DataFrame, bad: DataFrame, category: str, behavior: str, languages: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The weights and description of one behaviour, from aggregates of good and of bad
    samples; the baseline gives the geometric mean of both sides the score 0."""
    scalars = scoring.learn(good, bad)
    name = [F.lit(category).alias("category"), F.lit(behavior).alias("behavior")]
    none = F.array().cast("array<string>")
    langs = F.array(*map(F.lit, languages)).cast("array<string>") if languages else none
    about = scoring.baseline(scalars).select(
        *name, langs.alias("languages"), none.alias("excludes_languages"), none.alias("excludes_kinds"), "log_baseline", F.lit(None).cast("string").alias("hint"), F.lit(None).cast("string").alias("doc")
    )
    return scalars.select(*name, "grp", "key", "scalar"), about


def sample_languages(samples: DataFrame, about: DataFrame) -> DataFrame:
    """`about` with languages that all of a behaviour's sides have (samples: category,
    behavior, side, language), less those that it excludes."""
    known = samples.where("language <> 'unknown'").groupBy(*_KEY, "language").agg(F.countDistinct("side").alias("n"))
    sides = samples.groupBy(*_KEY).agg(F.countDistinct("side").alias("sides"))
    both = known.join(sides, _KEY).where("n = sides").groupBy(*_KEY).agg(F.sort_array(F.collect_set("language")).alias("found"))
    d = about.join(both, _KEY, "left")
    return d.withColumn("languages", F.array_except(F.coalesce("found", "languages"), F.coalesce("excludes_languages", F.array()))).drop("found")


# -- grades ---------------------------------------------------------------------


def grade_cosines(cosines: DataFrame, significant: float = 0.15) -> DataFrame:
    """category, n_behaviors, score, grade: the mean score of the behaviours whose cosine is
    significant; 50 without any."""
    d = cosines.withColumn("points", F.when(F.abs("cosine") >= significant, grading.score_cosine(F.col("cosine"))))
    d = d.groupBy("category").agg(F.count("points").alias("n_behaviors"), F.coalesce(F.round(F.avg("points")), F.lit(50.0)).cast("long").alias("score"))
    return d.withColumn("grade", grading.letter(F.col("score")))


#: Least score of each letter of the combined grade.
COMBINED = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-"))


def combined(grades: DataFrame, impact: dict[str, int] = grading.IMPACT) -> DataFrame:
    """score, grade: all cosine categories as one, by impact; none without categories."""
    weight = F.lit(1)
    for name, w in impact.items():
        weight = F.when(F.col("category") == name, w).otherwise(weight)
    s = grades.agg(F.sum(F.col("score") * weight).alias("s"), F.sum(weight).alias("w")).where("w > 0")
    return s.select(F.round(F.col("s") / F.col("w")).cast("long").alias("score")).withColumn("grade", grading.letter(F.col("score"), COMBINED))


def label(behavior: Column) -> Column:
    """A behaviour's name in words."""
    return F.initcap(F.replace(behavior, F.lit("_"), F.lit(" ")))


def action(hint: Column, behavior: Column) -> Column:
    """What to do about a behaviour: its hint."""
    return F.coalesce(hint, F.concat(F.lit("Refactor this block to satisfy "), label(behavior)))


def changed_metrics(delta: DataFrame) -> DataFrame:
    """grp, key, base, head, delta of the headline figures, to two places."""
    shown = [("readability", "mean_flesch_adapted"), ("halstead", "mean_difficulty"), ("compression", "mean_redundancy"), ("branching", "mean_branch_count")]
    keep = F.struct("grp", "key").isin(*(F.struct(F.lit(g), F.lit(k)) for g, k in shown))
    return delta.where(keep).select("grp", "key", *(F.round(c, 2).alias(c) for c in ("base", "head", "delta")))


def summary(base: DataFrame, head: DataFrame, changed: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: score and grade of both sides, how they differ, files added, modified and
    changed in all, and blocks flagged."""
    b = base.select(F.col("overall_score").alias("base_score"), F.col("overall_grade").alias("base_grade"))
    h = head.select(F.col("overall_score").alias("head_score"), F.col("overall_grade").alias("head_grade"))
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    files = changed.agg(F.coalesce(count("added"), F.lit(0)).alias("files_added"), F.coalesce(count("modified"), F.lit(0)).alias("files_modified"), F.count("*").alias("files_changed"))
    d = b.withColumn("_k", F.lit(1))
    for other in (h, files, flagged.agg(F.count("*").alias("blocks_flagged"))):
        d = d.join(other.withColumn("_k", F.lit(1)), "_k")
    return d.drop("_k").withColumn("score_delta", F.col("head_score") - F.col("base_score"))


def project_languages(files: DataFrame) -> DataFrame:
    """language: those that files have, but unknown."""
    return files.where("language <> 'unknown'").select("language").distinct()


#: Metrics whose figures come from the shared kernel.
COUNTING = tuple(folds.FIGURES)
