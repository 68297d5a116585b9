"""What removing one block would do: leave-one-out metrics, potentials, top blocks.

Files are fanned out to one row for each block, with the block cut out of the bytes;
the same metrics run over these rows in one pass, and cosines with and without the
block are compared for the file and for the corpus.  The corpus side needs no second
aggregate: the file's figures are swapped in the partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import r4
from . import aggregate, metrics, scoring, signals
from .blocks import GRAMMARS, Grammar

_KEY = ["category", "behavior"]
_BLOCK = ["path", "block"]
#: Least tokens of a block; longest file; lines of a top block; shares of
#: the gap to a perfect cosine that make a block critical, high, medium; the least gap.
MIN_TOKENS, MAX_BYTES, LINES, TOP = 10, 32_768, (3, 20), 10
SEVERITY, LEAST_GAP = ((0.5, "critical"), (0.25, "high"), (0.10, "medium")), 0.01


def blocks(files: DataFrame, grammars: dict[str, Grammar] = GRAMMARS, most: int | None = MAX_BYTES, scope: DataFrame | None = None) -> DataFrame:
    """The nodes of files up to `most` bytes (of the paths of `scope`), cut as text of an
    unknown language and classified by the file's own."""
    own = files if most is None else files.where(F.octet_length("content") <= most)
    own = own if scope is None else own.join(scope.select("path").distinct(), "path", "left_semi")
    return signals.nodes(own, grammars=grammars, cut_as="unknown")


def _offset(content: Column, line: Column, col: Column) -> Column:
    """Byte at a line and column: those of the lines before, and a line feed for each."""
    before = F.slice(F.split(content, "\n", -1), F.lit(1), (line - 1).cast("int"))
    return F.aggregate(before, F.lit(0), lambda n, x: n + F.octet_length(x) + 1) + col


def without(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, block, content of each node's file with the node's bytes cut out; all of it if
    the node cannot be located."""
    d = files.select("path", "content").join(nodes.where(F.col("n_tokens") >= MIN_TOKENS).select(*_BLOCK, "start_line", "start_col", "last_line", "last_end"), "path")
    a, b = _offset(F.col("content"), F.col("start_line"), F.col("start_col")), _offset(F.col("content"), F.col("last_line"), F.col("last_end"))
    d = d.withColumns({"raw": F.encode("content", "UTF-8"), "a": a.cast("int"), "b": b.cast("int")})
    cut = F.concat(F.substring("raw", F.lit(1), F.col("a")), F.substring("raw", F.col("b") + 1, F.octet_length("raw")))
    fine = (F.col("b") > F.col("a")) & (F.col("b") <= F.octet_length("raw"))
    return d.select(*_BLOCK, F.when(fine, F.decode(cut, "UTF-8")).otherwise(F.col("content")).alias("content"))


def figures_without(files: DataFrame, nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """path, block, metric, key, value of each file less one block."""
    cut = without(files, nodes)
    packed = cut.select(F.to_json(F.struct(*_BLOCK)).alias("path"), "content")
    got = metrics.file_metrics(packed, names).withColumn("at", F.from_json("path", "path string, block long"))
    return got.select("at.path", "at.block", "metric", "key", "value")


def _as_means(figures: DataFrame, by: list[str]) -> DataFrame:
    return figures.select(*by, F.col("metric").alias("grp"), F.concat(F.lit("mean_"), F.col("key")).alias("key"), "value")


def swapped(state: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """path, block, grp, key, value: the corpus aggregate with a file's figures `old`
    replaced by those without a block, `new`."""
    keyed = new.select(*_BLOCK, "metric", "key", F.col("value").alias("w")).join(old.select("path", "metric", "key", F.col("value").alias("o")), ["path", "metric", "key"], "left")
    d = keyed.join(state, ["metric", "key"])
    a, b = F.coalesce("o", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    d = d.select(
        *_BLOCK, "metric", "key", "n", (F.col("s") - a.cast("decimal(38, 6)") + b.cast("decimal(38, 6)")).alias("s"), (F.col("q") - a * a + b * b).alias("q"),
        F.least("lo", b).alias("lo"), F.greatest("hi", b).alias("hi"),
    )
    return aggregate.flat(aggregate.finalize(d, _BLOCK), _BLOCK)


def potentials(files: DataFrame, nodes: DataFrame, weights: DataFrame, about: DataFrame, figures: DataFrame | None = None, top: int = 3) -> DataFrame:
    """path, block, category, behavior, cosine_delta, rank: for each block the behaviours
    that its removal would help most, in the file or the corpus.  Behaviours that exclude
    the block's kind or the file's language are left out."""
    names = [r["grp"] for r in weights.select("grp").distinct().collect() if r["grp"] in metrics.METRICS]  # names of metrics, a few dozen
    old = metrics.file_metrics(files, names or None) if figures is None else figures
    new = figures_without(files, nodes, names or None)
    in_file = scoring.cosines(_as_means(old, ["path"]), weights, ["path"]).withColumnRenamed("cosine", "base")
    left = scoring.cosines(_as_means(new, _BLOCK), weights, _BLOCK)
    file_delta = left.join(in_file, ["path", *_KEY]).select(*_BLOCK, *_KEY, (F.col("cosine") - F.col("base")).alias("file_delta"))
    state = aggregate.state(old)
    corpus = scoring.cosines(aggregate.flat(aggregate.finalize(state)), weights).withColumnRenamed("cosine", "base")
    less = scoring.cosines(swapped(state, old, new), weights, _BLOCK)
    corpus_delta = less.join(corpus, _KEY).select(*_BLOCK, *_KEY, (F.col("cosine") - F.col("base")).alias("corpus_delta"))
    d = file_delta.join(corpus_delta, [*_BLOCK, *_KEY], "full")
    merged = F.greatest(F.coalesce("file_delta", F.lit(0.0)), F.coalesce("corpus_delta", F.lit(0.0)))
    lang = files.select("path", (F.col("language") if "language" in files.columns else F.lit(None).cast("string")).alias("language"))
    d = d.withColumn("cosine_delta", r4(merged)).join(nodes.select(*_BLOCK, "kind"), _BLOCK).join(lang, "path").join(about.select(*_KEY, "excludes_kinds", "excludes_languages"), _KEY, "left")
    out = F.coalesce(F.array_contains("excludes_kinds", F.col("kind")), F.lit(False)) | F.coalesce(F.array_contains("excludes_languages", F.col("language")), F.lit(False))
    rank = F.row_number().over(W.partitionBy(*_BLOCK).orderBy(F.desc("cosine_delta"), *_KEY))
    return d.where(~out).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(*_BLOCK, *_KEY, "cosine_delta", "rank")


def candidates(nodes: DataFrame, lines: tuple[int, int] = LINES) -> DataFrame:
    """The nodes of suitable size, one for each range of lines: the first in pre-order."""
    first = F.row_number().over(W.partitionBy("path", "start_line", "end_line").orderBy("block"))
    n = F.col("end_line") - F.col("start_line") + 1
    d = nodes.withColumn("line_count", n).withColumn("_first", first).where("_first = 1").drop("_first")
    return d.where((F.col("n_tokens") >= MIN_TOKENS) & F.col("line_count").between(*lines))


def rendered(hint: Column, values: dict[str, Column]) -> Column:
    """A template with {{name}} replaced; unknown names stay."""
    for name, value in values.items():
        hint = F.replace(hint, F.lit("{{" + name + "}}"), value.cast("string"))
    return hint


def flagged(nodes: DataFrame, found: DataFrame, corpus: DataFrame, about: DataFrame, ranges: DataFrame | None = None, lines: tuple[int, int] = LINES) -> DataFrame:
    """Nodes and potentials that stand out: what is above the file's least delta of the
    behaviour, as a share of the gap that the corpus has to a perfect cosine.  `ranges`
    (path, first, last) keeps blocks that a change touches."""
    own = candidates(nodes, lines)
    d = own.join(found.select(*_BLOCK, *_KEY, "cosine_delta"), _BLOCK)
    floor = F.min("cosine_delta").over(W.partitionBy("path", "behavior"))
    d = d.withColumn("cosine_delta", F.greatest(r4(F.col("cosine_delta") - floor), F.lit(0.0)))
    if ranges is not None:
        touched = own.join(ranges, "path").where((F.col("start_line") <= F.col("last")) & (F.col("first") <= F.col("end_line")))
        d = d.join(touched.select(*_BLOCK).distinct(), _BLOCK, "left_semi")
    gap = F.greatest(F.lit(LEAST_GAP), 1 - F.coalesce("cosine", F.lit(0.0)))
    d = d.join(corpus.select(*_KEY, "cosine"), _KEY, "left").withColumn("share", F.col("cosine_delta") / gap)
    severity = F.lit(None).cast("string")
    for least, name in reversed(SEVERITY):
        severity = F.when(F.col("share") > least, name).otherwise(severity)
    d = d.withColumn("severity", severity).where(F.col("severity").isNotNull()).join(about.select(*_KEY, "hint"), _KEY, "left")
    shown = {"type": F.col("kind"), "token_count": F.col("n_tokens"), "char_length": F.col("n_chars")} | {c: F.col(c) for c in ("line_count", "start_line", "end_line", "severity")}
    return d.withColumn("hint", rendered(F.col("hint"), shown)).drop("share", "cosine")


def top_blocks(rows: DataFrame, files: DataFrame, n: int = TOP) -> DataFrame:
    """The n blocks with the largest delta, with their source and what to do, worst first."""
    said = F.sort_array(F.collect_list(F.struct((-F.col("cosine_delta")).alias("d"), "category", "behavior", "severity", "hint")))
    d = rows.groupBy(*_BLOCK, "start_line", "end_line", "kind", "n_tokens").agg(F.max("cosine_delta").alias("worst"), said.alias("found"))
    d = d.orderBy(F.desc("worst"), *_BLOCK).limit(n).join(files.select("path", "content"), "path")
    source = F.array_join(F.slice(F.split("content", "\n", -1), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(" ", x["severity"], F.concat_ws(".", x["category"], x["behavior"]))), "; ")
    return d.select(*_BLOCK, "start_line", "end_line", "kind", "n_tokens", "worst", text.alias("findings"), source.alias("source")).orderBy(F.desc("worst"), *_BLOCK)


def worst_by_category(rows: DataFrame) -> DataFrame:
    """category, path, block, cosine_delta: the block with the largest delta of each category."""
    rank = F.row_number().over(W.partitionBy("category").orderBy(F.desc("cosine_delta"), *_BLOCK))
    return rows.withColumn("_r", rank).where("_r = 1").select("category", *_BLOCK, "cosine_delta")


def top_nodes(nodes: DataFrame, found: DataFrame, n: int = 3) -> DataFrame:
    """path, block, impact, rank: the n top-level blocks of a file with the largest sum of deltas."""
    s = nodes.where("parent = 0").select(*_BLOCK).join(found, _BLOCK, "left").groupBy(*_BLOCK).agg(r4(F.coalesce(F.sum("cosine_delta"), F.lit(0.0))).alias("impact"))
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("impact"), "block"))
    return s.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def tasks(rows: DataFrame) -> DataFrame:
    """The critical and high findings as tasks, critical first, in the order of the blocks."""
    order = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return rows.where(F.col("severity").isin("critical", "high")).select(order.alias("order"), *_BLOCK, "start_line", "end_line", *_KEY, "severity", "cosine_delta", "hint").orderBy("order", *_BLOCK, *_KEY)
