"""Entry points over folders and commits: analyze, health report, diagnose, history,
correlate.  Each takes a session and returns tables; writing is apart."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import behaviors as V
from ..operators import blocks as B
from ..operators import compress as C
from ..operators import grading as G
from ..operators import impact as I
from ..operators import metrics, scoring
from ..operators import pairs as P
from ..sources import config, git
from ..sources import files as S
from ..sources import snapshots
from . import report


def _folder(path: str) -> str:
    if not os.path.isdir(path):
        raise NotADirectoryError(path)
    return path


def project(path: str) -> config.Project:
    """Settings beside the files."""
    return config.Project.of(config.read(os.path.join(path, ".gaugeworks.yml")))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The source files of a folder that neither settings nor git ignore."""
    found = S.scan(spark, _folder(path), [*S.IGNORED, *project(path).ignore_paths])
    return git.without_ignored(spark, found, path) if os.path.isdir(os.path.join(path, ".git")) else found


@dataclass(frozen=True)
class Analysis:
    files: DataFrame
    figures: DataFrame
    aggregate: DataFrame
    near_duplicates: DataFrame
    similar: DataFrame
    density: DataFrame


def analyze(spark: SparkSession, path: str) -> Analysis:
    """Figures of each file, their aggregate, near-duplicate blocks, similar files."""
    files, own = corpus(spark, path), project(path)
    figures = metrics.memoized(files)
    blocks = B.near_duplicates(B.classes(B.blocks(files)), frequent=own.idf_max_freq)
    blocks = blocks if own.max_pairs_per_bucket is None else P.top_pairs(blocks, own.max_pairs_per_bucket)
    similar = C.nearest(C.distances(P.text_pairs(files), files))
    return Analysis(files, figures, A.codebase(figures), blocks, similar, C.cross_file_density(files))


def diagnose(spark: SparkSession, path: str, weights: DataFrame, about: DataFrame, top: int = 15, by_file: bool = False) -> DataFrame:
    """The behaviours with the lowest cosines, of the project or of each file."""
    files = corpus(spark, path)
    figures = metrics.memoized(files)
    if by_file:
        means = figures.select("path", F.col("metric").alias("grp"), F.concat(F.lit("mean_"), F.col("key")).alias("key"), "value")
        return scoring.worst_files(scoring.cosines(means, weights, ["path"]), n=top)
    languages = [r["language"] for r in V.project_languages(files).collect()]  # at most the known ones
    return V.diagnosed(A.flat(A.codebase(figures)), weights, about, languages, top)


@dataclass(frozen=True)
class Health:
    grades: DataFrame
    overall: DataFrame
    blocks: DataFrame
    worst: DataFrame
    tasks: DataFrame
    delta: DataFrame | None = None
    summary: DataFrame | None = None


def _grades(spark: SparkSession, figures: DataFrame, weights: DataFrame, about: DataFrame, files: DataFrame, settings: config.Report, significant: float) -> DataFrame:
    whole = A.codebase(figures)
    means = whole.select("metric", "key", F.col("mean").alias("value"))
    by_threshold = G.grade_categories(means, [], G.thresholds(spark, settings.thresholds)).select("category", "score", "grade")
    languages = [r["language"] for r in V.project_languages(files).collect()]
    cosines = V.diagnosed(A.flat(whole), weights, about, languages, None)
    return by_threshold.unionByName(V.grade_cosines(cosines, significant).select("category", "score", "grade"))


def health(spark: SparkSession, files: DataFrame, weights: DataFrame, about: DataFrame, base: DataFrame | None = None, settings: config.Report = config.Report(),
           own: config.Project = config.Project(), ranges: DataFrame | None = None) -> Health:
    """Grades of the files, the blocks that stand out, and, with the files of a base, what
    changed; then only blocks of changed files are looked at."""
    figures = metrics.memoized(files)
    grades = _grades(spark, figures, weights, about, files, settings, own.cosine_significance_threshold)
    overall = G.overall(grades, settings.impact)
    changed = None if base is None else snapshots.changed(base.select("path", "content"), files.select("path", "content"))
    nodes = I.blocks(files, most=own.max_loo_file_bytes, scope=changed)
    found = I.potentials(files, nodes, weights, about, figures)
    corpus_cosines = scoring.cosines(A.flat(A.codebase(figures)), weights)
    rows = I.flagged(nodes, found, corpus_cosines, about, ranges, (settings.block_min_lines, settings.block_max_lines))
    out = {"grades": grades, "overall": overall, "blocks": I.top_blocks(rows, files), "worst": I.worst_by_category(rows), "tasks": I.tasks(rows)}
    if base is not None:
        before = metrics.memoized(base)
        old = G.overall(_grades(spark, before, weights, about, base, settings, own.cosine_significance_threshold), settings.impact)
        delta = A.delta(A.flat(A.codebase(before)), A.flat(A.codebase(figures)))
        out |= {"delta": delta, "summary": V.summary(old, overall, changed, out["blocks"])}
    return Health(**out)


def health_report(spark: SparkSession, path: str, weights: DataFrame, about: DataFrame, base_ref: str | None = None, view: str = "plain") -> str:
    """The report of a folder as markdown (`plain`, `github`) or as tasks (`agent`)."""
    settings = config.Report.of(config.read(os.path.join(_folder(path), ".gaugeworks-report.yml")))
    base = git.at_ref(spark, path, base_ref) if base_ref else None
    ranges = snapshots.diff_ranges(git.diff_lines(spark, path, base_ref, "HEAD")) if base_ref else None
    h = health(spark, corpus(spark, path), weights, about, base, settings, project(path), ranges)
    if view == "agent":
        return report.agent(h.tasks.collect())
    if view == "github":
        return report.github(h.overall.first(), h.grades.orderBy("category").collect(), h.blocks.collect())
    tables = {"Overall": h.overall, "Categories": h.grades.orderBy("category"), "Blocks": h.blocks.drop("source")}
    if h.delta is not None:
        tables |= {"Changes": V.changed_metrics(h.delta), "Summary": h.summary}
    return report.plain(tables)


def history(spark: SparkSession, repo: str, refs: list[str]) -> DataFrame:
    """The aggregate of each commit, in one job."""
    rows = None
    for ref in refs:
        found = git.at_ref(spark, repo, ref)
        rows = found if rows is None else rows.unionByName(found)
    return A.codebase(metrics.file_metrics(rows), ["snapshot"])


def correlate(snapshots_: DataFrame, top: int = 20, **options) -> DataFrame:
    """The strongest correlations over snapshots (from `files.read_history`)."""
    series = A.flat(snapshots_, ["snapshot"]).select("snapshot", F.concat_ws(".", "grp", "key").alias("name"), "value")
    return A.strongest(A.correlations(series, **options), top)
