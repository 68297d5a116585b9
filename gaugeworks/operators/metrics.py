"""File metrics: one row of figures for each file, without a shuffle.

Each metric is a function of files (or of the lexed files, `functions.text.lexed`) and
returns path and its figures.  Figures that a file lacks are null.  Ratios and logarithmic
figures are rounded to four places (densities of single marks to six), counts are
longs.  A file without tokens, words or lines has zeros unless a docstring says
otherwise.  All figures come from one Arrow kernel over the contents (`folds`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from . import folds
from .folds import BOUNDARY, DEFINITION, INLINE, METHOD, NUMBER, OPERAND, OPERATOR, PLAIN_NUMBERS, STYLES, TERMINAL  # noqa: F401

Metric = Callable[[DataFrame], DataFrame]
METRICS: dict[str, Metric] = {}
#: Metrics that exist but are not part of a file's standard figures.
EXTRA = ("bradford", "rfc")

#: What each metric gives.
ABOUT = {
    "entropy": "Entropy of bytes and of tokens, its maximum, their ratio, and sizes.",
    "compression": "Sizes before and after deflate, their ratio, redundancy, share of distinct lines.",
    "unique_lines": "The part of `compression` that needs no deflate.",
    "zipf": "Exponent and fit of log frequency on log rank; zeros under three types.",
    "heaps": "Growth of the vocabulary, sampled about fifty times; zeros under five samples.",
    "vocabulary": "Type-token ratios of identifiers, whole and over a moving window of a hundred, and the distinct words in order.",
    "mtld": "Mean length of runs that keep the type-token ratio above 0.72, forwards, backwards, and their mean.",
    "lexical_concentration": "Yule's K and Simpson's D of the tokens; zeros under two tokens.",
    "renyi_entropy": "Entropies of order 0, 1, 2 and infinity, Hill numbers, and the first less the third.",
    "ngram": "Runs of two and three tokens: number, types, share of repeats, of hapaxes.",
    "conditional_entropy": "Entropy of a token given the one before, perplexity (1 under two tokens), and the entropy's share of its maximum.",
    "halstead": "Halstead's figures; the time is null where the vocabulary is one word.",
    "readability": "Reading ease and fog adapted to code: tokens per line, sub-words per word.",
    "lexical_density": "Share of content tokens: identifiers and numbers, at most all.",
    "casing_entropy": "Entropy of identifier styles; the count of a style that doesn't occur is null.",
    "identifier_length_variance": "Mean, population variance and deviation, and greatest length of identifiers.",
    "indentation": "Leading white space of the lines with something visible.",
    "branching": "Branching words, their number per visible line, and the deepest nesting.",
    "function_metrics": "Function definitions: number, lines up to the next one, parameters.",
    "magic_number_density": "Numbers other than the plain ones, and double-quoted strings, per token.",
    "symbol_density": "Characters that are neither word characters nor white space.",
    "vowel_density": "Vowels among the characters of identifiers.",
    "brevity": "Length against frequency of distinct tokens; zeros under three types.",
    "punctuation_density": "Marks and patterns of marks, per character or token.",
    "comment_structure": "Lines that begin as comments, and markers of open work.",
    "separator_counts": "How often each separator occurs.",
    "line_patterns": "Blank and distinct lines (1 for none), nesting, and quoted strings per token.",
    "unreachable_code": "Lines after a terminal statement and before its scope ends.",
    "bradford": "Zones of a third of the tokens each, over the lines by density; zeros under three lines or tokens.",
    "rfc": "Function definitions and distinct call targets.",
}


def _figure(name: str, key: str, mark: str) -> Column:
    """A figure of the kernel; what it leaves alone is rounded here."""
    at = F.col(f"folds.{name}_{key}")
    return F.round(at, 6) if mark == "~" else at


def _metric(name: str) -> Metric:
    def narrow(d: DataFrame) -> DataFrame:
        own = d.schema["ids"].metadata.get("keywords") if "ids" in d.columns else None
        d = d.select("path", folds.kernel((name,), tuple(own or vocab.KEYWORDS), True)("content").alias("folds"))
        return d.select("path", *(_figure(name, *k).alias(k[0]) for k in folds.keys(name)))

    narrow.__name__, narrow.__doc__ = name, ABOUT[name]
    return narrow


METRICS |= {name: _metric(name) for name in ABOUT}


def standard() -> list[str]:
    return [m for m in METRICS if m not in EXTRA and m != "unique_lines"]


def file_metrics(files: DataFrame, names: list[str] | None = None, keywords: tuple[str, ...] = vocab.KEYWORDS, only: set[tuple[str, str]] | None = None) -> DataFrame:
    """(path, metric, key, value): the numeric figures of every file in long form (of `only`
    these metrics and keys), all metrics in one pass over the files; figures that a file lacks
    have no row."""
    names = names or standard()
    passed = [c for c in ("snapshot", "language") if c in files.columns]
    wide = files.select("path", *passed, folds.kernel(tuple(names), tuple(keywords))("content").alias("folds"))
    pairs = [
        F.struct(F.lit(name).alias("metric"), F.lit(key).alias("key"), _figure(name, key, mark).cast("double").alias("value"))
        for name in names for key, mark in folds.keys(name, False) if mark != "?" and (only is None or (name, key) in only)
    ]
    return wide.select("path", *passed, F.inline(F.array(*pairs))).where("value IS NOT NULL")


def file_states(files: DataFrame, names: list[str] | None = None, by: list[str] = (), keywords: tuple[str, ...] = vocab.KEYWORDS) -> DataFrame:
    """The partial aggregates (`aggregate.state`) of the files of each task by columns of texts:
    a file's figures are added up where they are made, and have no rows."""
    names = names or standard()
    kinds = [(name, key) for name in names for key, mark in folds.keys(name, False) if mark != "?"]
    columns = [f"c{k} string" for k in range(len(by))] + [f"c{len(by) + k} {t}" for k, t in enumerate(("long", "long", "decimal(38, 6)", "double", "double", "double"))]
    d = files.select(*by, "content").mapInArrow(folds.states(tuple(names), tuple(keywords), len(by)), ", ".join(columns))
    d = d.toDF(*by, "_k", "n", "s", "q", "lo", "hi")
    at = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key")) for m, k in kinds))
    return d.withColumn("_f", F.get(at, F.col("_k").cast("int"))).select(*by, "_f.metric", "_f.key", "n", "s", "q", "lo", "hi")


def memoized(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """`file_metrics` computed once for each distinct content, and joined back to the paths."""
    keyed = files.withColumn("_digest", F.sha2(F.col("content").cast("binary"), 256))
    once = keyed.groupBy("_digest").agg(F.first("content").alias("content")).select(F.col("_digest").alias("path"), "content")
    figures = file_metrics(once, names).withColumnRenamed("path", "_digest")
    return keyed.select("path", "_digest").join(figures, "_digest").drop("_digest")
