"""Named queries over the data tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators import aggregate as A
from ..operators import blocks as B
from ..operators import compress as C
from ..operators import behaviors as V
from ..operators import folds
from ..operators import grading as G
from ..operators import impact as I
from ..operators import metrics
from ..operators import pairs as P
from ..operators import scoring as S
from ..operators import signals as N
from . import metric_sql as Q

Query = Callable[[SparkSession, str], DataFrame]

#: Figures that need deflate, which the SQL side does not have.
DEFLATED = ["zlib_bytes", "zlib_ratio", "redundancy"]
#: Globs of the ignore query.
GLOBS = ["src1*/*", "**/*7", "src?/1?"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of their sources."""
    return X.corpus(table(spark, sf_dir, "documents"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of all standard metrics."""
    return metrics.file_metrics(files(spark, sf_dir))


def _is_deflated():
    return (F.col("metric") == "compression") & F.col("key").isin(*DEFLATED)


def _undeflated(d: DataFrame) -> DataFrame:
    """What `compression` has without deflate goes by its name."""
    return d.withColumn("metric", F.when(F.col("metric") == "unique_lines", "compression").otherwise(F.col("metric")))


#: The standard metrics, without deflate.
RELATIONAL = ["unique_lines" if n == "compression" else n for n in metrics.standard()]


def relational(files_: DataFrame) -> DataFrame:
    """All figures but those of deflate, which is not run."""
    return _undeflated(metrics.file_metrics(files_, RELATIONAL))


def relational_state(files_: DataFrame, by: list[str] = ()) -> DataFrame:
    """The aggregate of these figures."""
    return A.merged(_undeflated(metrics.file_states(files_, RELATIONAL, by)), by)


def relational_codebase(files_: DataFrame, by: list[str] = ()) -> DataFrame:
    return A.finalize(relational_state(files_, by), by)


def graded(spark: SparkSession, sf_dir: str, rows=G.CATEGORIES) -> DataFrame:
    """The figures that have thresholds; the graded queries look at no others."""
    return metrics.file_metrics(files(spark, sf_dir), sorted({r[1] for r in rows}), only={(r[1], r[2]) for r in rows})


def graded_means(spark: SparkSession, sf_dir: str, rows=G.CATEGORIES) -> DataFrame:
    states = A.merged(metrics.file_states(files(spark, sf_dir), sorted({r[1] for r in rows})))
    return A.finalize(states).select("metric", "key", F.col("mean").alias("value"))


def _metric(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.METRICS[name](X.lexed(files(spark, sf_dir)))

    run.__doc__ = metrics.METRICS[name].__doc__
    return run


# -- lexing ---------------------------------------------------------------------


def lex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with line, place in the line and kind."""
    d = files(spark, sf_dir).select("path", F.posexplode(X.lines(F.col("content"))).alias("n", "l"))
    d = d.select("path", (F.col("n") + 1).cast("long").alias("line"), F.posexplode(X.found(F.col("l"), X.TOKEN)).alias("k", "token"))
    return d.select("path", "line", (F.col("k") + 1).cast("long").alias("k"), "token", X.kind(F.col("token")).alias("kind"))


def lex_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files(spark, sf_dir).select("path", F.inline(folds.token_counts()("content")))  # counted within each file
    return d.groupBy("path", "token").agg(F.sum("n").alias("n"))


def lex_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.lexed(files(spark, sf_dir)).select("path", F.posexplode("words").alias("k", "word"))
    return d.select("path", (F.col("k") + 1).cast("long").alias("k"), "word")


def lex_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.lexed(files(spark, sf_dir)).select("path", F.posexplode("ids").alias("k", "identifier"))
    return d.select("path", (F.col("k") + 1).cast("long").alias("k"), "identifier")


def lex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files(spark, sf_dir)
    return d.select("path", F.size(X.lines(F.col("content"))).cast("long").alias("line_count"), F.octet_length("content").cast("long").alias("byte_count"))


def lex_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.lexed(files(spark, sf_dir)).select(F.explode("ids").alias("identifier"))
    return d.groupBy("identifier").agg(F.count("*").alias("n")).withColumn("style", X.casing(F.col("identifier")))


def lex_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.lexed(files(spark, sf_dir)).select(F.explode("words").alias("word"))
    d = d.groupBy("word").agg(F.count("*").alias("n"))
    parts = X.sub_words(F.col("word"))
    return d.select("word", "n", F.size(parts).cast("long").alias("parts"), F.array_join(parts, " ").alias("sub_words"))


def lex_kgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct runs of five token kinds a file has."""
    d = X.lexed(files(spark, sf_dir)).withColumn("kinds", F.transform("tokens", X.kind))
    g = X.kgrams(F.col("kinds"), 5)
    return d.select("path", F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct"))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", "url")
    return d.select("page_id", X.language(F.regexp_replace("url", r"[?#].*$", "")).alias("language"))


def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup comments and lines after //."""
    d = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    bare = X.strip_comments(F.col("html"), ["//"], [("<!--", "-->")])
    return d.select("page_id", F.char_length(bare).cast("long").alias("n_chars"), F.sha2(bare.cast("binary"), 256).alias("sha"))


def glob_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(~X.ignored(F.col("path"), GLOBS)).select("path")


# -- aggregates -----------------------------------------------------------------


def agg_codebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_codebase(files(spark, sf_dir))


def agg_deflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of the aggregate: what deflate says of the files."""
    return A.finalize(A.merged(metrics.file_states(files(spark, sf_dir), ["compression"]).where(_is_deflated())))


def agg_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate after document 0's figures were replaced by document 1's."""
    f = relational(files(spark, sf_dir))
    one = lambda k: f.where(F.col("path").endswith(f"/{k}"))
    return A.finalize(A.swapped(relational_state(files(spark, sf_dir)), one(0), one(1)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate of every source as a snapshot, in one job."""
    return relational_codebase(files(spark, sf_dir), ["snapshot"])


def history_deflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.finalize(A.merged(metrics.file_states(files(spark, sf_dir), ["compression"], ["snapshot"]).where(_is_deflated()), ["snapshot"]), ["snapshot"])


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of documents in English, less those of the others (or of none)."""
    docs = table(spark, sf_dir, "documents")
    sides = [A.flat(relational_codebase(X.corpus(docs.where(w)))) for w in ("NOT lang <=> 'en'", "lang <=> 'en'")]
    return A.delta(*sides).where(F.col("key").startswith("mean_"))


def correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations over the sources of the mean figures of different groups."""
    h = A.flat(history(spark, sf_dir), ["snapshot"]).where(F.col("key").startswith("mean_"))
    return A.correlations(h.select("snapshot", F.concat_ws(".", "grp", "key").alias("name"), "value"), least=0.5)


def m_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.combinations(metrics.file_metrics(files(spark, sf_dir), ["lexical_density", "separator_counts"]))


def power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of documents against their number of words, as a power law."""
    d = X.lexed(files(spark, sf_dir)).select(F.size("words").alias("x"), F.char_length("content").alias("y"))
    return A.power_law(d)


# -- grades ---------------------------------------------------------------------


def _limits(spark: SparkSession) -> DataFrame:
    return G.thresholds(spark)


#: The thresholds that SQL has figures for.
LIMITS_RELATIONAL = [r for r in G.CATEGORIES if r[2] not in DEFLATED]


def _limits_relational(spark: SparkSession) -> DataFrame:
    return G.thresholds(spark, LIMITS_RELATIONAL)


def grade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.scored(graded_means(spark, sf_dir), [], _limits(spark))
    return d.select("category", "metric", "key", "value", "score")


def grade_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category grades of the corpus, by all thresholds."""
    means = graded_means(spark, sf_dir).cache()  # a row for each figure, read twice
    grades = G.grade_categories(means, [], _limits(spark))
    poor = G.scored(means, [], _limits(spark)).groupBy("category").agg(F.sum((F.col("score") < 60).cast("long")).alias("poor"))
    return grades.join(poor, "category", "left").select(*grades.columns, G.summary(F.col("score"), F.coalesce("poor", F.lit(0))).alias("summary"))


def grade_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grade_categories(graded(spark, sf_dir), ["path"], _limits(spark))


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall grade, and whether it passes a gate at C."""
    d = G.overall(G.grade_categories(graded_means(spark, sf_dir), [], _limits(spark)))
    return d.withColumn("passes", G.passes(F.col("overall_grade"), "C"))


def worst_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.worst_offenders(graded(spark, sf_dir), _limits(spark), 3)


def grade_metrics_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`grade_metrics` over the thresholds that SQL has figures for, as are the next four."""
    d = G.scored(graded_means(spark, sf_dir, LIMITS_RELATIONAL), [], _limits_relational(spark))
    return d.select("category", "metric", "key", "value", "score")


def grade_threshold_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grade_categories(graded_means(spark, sf_dir, LIMITS_RELATIONAL), [], _limits_relational(spark))


def grade_files_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grade_categories(graded(spark, sf_dir, LIMITS_RELATIONAL), ["path"], _limits_relational(spark))


def overall_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.overall(grade_threshold_relational(spark, sf_dir)).withColumn("passes", G.passes(F.col("overall_grade"), "C"))


def worst_offenders_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.worst_offenders(graded(spark, sf_dir, LIMITS_RELATIONAL), _limits_relational(spark), 3)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Mean figures of the documents labelled good and bad."""
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("string").alias("source"))
    docs = table(spark, sf_dir, "documents").drop("source").join(labels, "doc_id")
    both = relational_codebase(X.corpus(docs), ["snapshot"]).cache()  # one pass for both, a row for each figure
    return tuple(A.flat(both.where(F.col("snapshot") == q)).where(F.col("key").startswith("mean_")) for q in ("1", "0"))


def learn_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.learn(*_sides(spark, sf_dir))


def _learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One behaviour for each group of figures, with the learned scalars."""
    return learn_scalars(spark, sf_dir).select(F.lit("quality").alias("category"), F.col("grp").alias("behavior"), "grp", "key", "scalar")


def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the corpus with the learned behaviours, and their scores."""
    d = S.cosines(A.flat(agg_codebase(spark, sf_dir)), _learned(spark, sf_dir))
    return d.withColumn("score", G.score_cosine(F.col("cosine")))


def score_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.product_scores(A.flat(agg_codebase(spark, sf_dir)), _learned(spark, sf_dir))


def worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_file = relational(files(spark, sf_dir)).select("path", F.col("metric").alias("grp"), F.concat(F.lit("mean_"), F.col("key")).alias("key"), "value")
    return S.worst_files(S.cosines(by_file, _learned(spark, sf_dir), ["path"]))


# -- pairs ----------------------------------------------------------------------


def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exact_classes(files(spark, sf_dir))


def dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of documents with similar five-word shingles."""
    return P.jaccard_pairs(P.shingled(files(spark, sf_dir)))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and the documents that hold half their eight-word shingles."""
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.coalesce("text", F.lit("")).alias("content"))
    return P.contained(probes, files(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the pages, by brackets and triple quotes."""
    return B.blocks(_pages(spark, sf_dir)).withColumn("kinds", F.array_join("kinds", " "))


def block_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.blocks(_pages(spark, sf_dir)).drop("kinds").cache()  # read four times
    return B.proportions(rows).join(B.block_counts(rows), "path")


def ncd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression distances of the pairs of different documents with similar shingles, and of
    copies with the first document of their text."""
    return C.nearest(C.distances(P.text_pairs(files(spark, sf_dir)), files(spark, sf_dir)))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split signals of the pages, read as javascript."""
    return N.signals(_pages(spark, sf_dir), "javascript")


def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the pages and what they are voted to be, read as javascript."""
    return N.nodes(_pages(spark, sf_dir), "javascript").withColumn("bound", F.array_join("bound", " "))


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.compounds(N.nodes(_pages(spark, sf_dir), "javascript"))


def near_dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of the pages' top-level blocks are near duplicates, by bucket."""
    return B.bucket_counts(B.near_duplicates(B.classes(B.blocks(_pages(spark, sf_dir)))))


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten pairs of classes of near-duplicate blocks of each bucket."""
    return P.top_pairs(B.near_duplicates(B.classes(B.blocks(_pages(spark, sf_dir)))), 10)


def near_dup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.duplicates_in_files(B.blocks(_pages(spark, sf_dir)).where("parent = 0").cache())  # read twice


def cross_file_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_file_density(files(spark, sf_dir))


def _about(spark: SparkSession, weights: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    d = weights.select("category", "behavior").distinct()
    return d.select("category", "behavior", none.alias("languages"), none.alias("excludes_languages"), none.alias("excludes_kinds"), F.lit(0.0).alias("log_baseline"), F.lit("Look at this {{type}} of {{line_count}} lines.").alias("hint"), F.lit(None).cast("string").alias("doc"))


def cosine_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the learned behaviours, each group of figures as a category."""
    cosines = diagnose(spark, sf_dir).withColumn("category", F.substring("behavior", 1, 4))
    return V.grade_cosines(cosines)


def combined_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.combined(cosine_grades(spark, sf_dir))


def top_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two figures of each learned behaviour that pull its cosine down most."""
    return S.top_metrics(A.flat(agg_codebase(spark, sf_dir)), _learned(spark, sf_dir), 2)


def learned_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.baseline(learn_scalars(spark, sf_dir))


def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.strongest(correlate(spark, sf_dir), 20)


#: Behaviours of the block queries: category, behaviour, metric, key, scalar.
PLAIN = [
    ("size", "short", "halstead", "mean_length", -1.0), ("size", "short", "entropy", "mean_total_tokens", -1.0),
    ("text", "plain", "symbol_density", "mean_density", -0.5), ("text", "plain", "separator_counts", "mean_hyphen_count", 0.5),
]


def _impact(spark: SparkSession, sf_dir: str):
    pages = _pages(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    weights = spark.createDataFrame(PLAIN, "category string, behavior string, grp string, key string, scalar double")
    nodes = I.blocks(pages)
    figures_ = metrics.file_metrics(pages, sorted({r[2] for r in PLAIN})).cache()  # read five times
    return pages, weights, nodes, figures_, I.potentials(pages, nodes, weights, _about(spark, weights), figures_)


def block_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing each block of the pages would do for two behaviours."""
    return _impact(spark, sf_dir)[-1]


def top_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten blocks of the pages that stand out most (of 1 to 200 lines)."""
    pages, weights, nodes, figures_, found = _impact(spark, sf_dir)
    corpus = S.cosines(A.flat(A.codebase(figures_)), weights)
    return I.top_blocks(I.flagged(nodes, found, corpus, _about(spark, weights), lines=(1, 200)), pages)


def diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges of made-up diffs: each document is a file whose first lines, as many
    as its id modulo 4, were put at line id modulo 9."""
    from ..sources.snapshots import diff_ranges as ranges

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("diff"))
    hunk = F.concat(F.lit("@@ -1,2 +"), (F.col("diff") % 9).cast("string"), F.lit(","), (F.col("diff") % 4).cast("string"), F.lit(" @@"))
    lines = F.array(F.struct(F.lit(0).alias("no"), F.concat(F.lit("+++ b/f"), F.col("diff").cast("string")).alias("line")), F.struct(F.lit(1).alias("no"), hunk.alias("line")))
    return ranges(d.select("diff", F.inline(lines)))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even and of odd ids as two snapshots of files n // 2: status."""
    from ..sources.snapshots import changed

    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    base, head = docs.where("doc_id % 2 = 0 AND doc_id % 5 <> 0"), docs.where("doc_id % 2 = 1 AND doc_id % 7 <> 0")
    return changed(base.select("path", "content"), head.select("path", "content"))


_OWN = (
    lex_tokens, lex_token_counts, lex_words, lex_identifiers, lex_lines, lex_casing, lex_subwords, lex_kgrams, lang_detect, strip_comments,
    glob_ignore, agg_codebase, agg_deflated, agg_incremental, history, history_deflated, compare, correlate, m_combinations, power_law, grade_metrics, grade_threshold,
    grade_files, overall, worst_offenders, grade_metrics_relational, grade_threshold_relational, grade_files_relational, overall_relational,
    worst_offenders_relational, learn_scalars, diagnose, score_aggregate, worst_files, dup_exact, dup_jaccard, contamination,
    changed_files, blocks, block_proportions, ncd, signals, node_kinds, compounds, near_dup_blocks, near_dup_pairs, near_dup_files,
    cross_file_density, cosine_grades, combined_grade, top_metrics, learned_baseline, top_correlations, block_potentials, top_blocks, diff_ranges,
)


def queries() -> dict[str, Query]:
    return {f"m_{n}": _metric(n) for n in metrics.METRICS} | {f.__name__: f for f in _OWN}


# -- SQL ------------------------------------------------------------------------

_KIND = "CASE WHEN regexp_matches({0}, '^[a-zA-Z_]') THEN '<ID>' WHEN regexp_matches({0}, '^[0-9]') THEN '<NUM>' ELSE '<PUNCT>' END"
_AGG = """round(sum(value::DECIMAL(38, 6))::DOUBLE / count(*), 4) + 0.0 AS mean, round(sqrt(greatest(sum(value * value) / count(*) - (sum(value::DECIMAL(38, 6))::DOUBLE / count(*)) ** 2, 0)), 4) + 0.0 AS std,
round(min(value), 4) + 0.0 AS min, round(max(value), 4) + 0.0 AS max"""


def _limits_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{float(x)}::DOUBLE" for x in r) + ")" for r in G.CATEGORIES if r[2] not in DEFLATED)
    return f"lim(category, metric, key, good, a, b, c, d, weight) AS (VALUES {rows})"


def _between_sql(a: str, p: int, b: str, q: int) -> str:
    return f"round({p} + (value - {a}) / ({b} - {a}) * ({q} - {p}))"


_SCORE = (
    "greatest(0, least(100, CASE WHEN s * value < s * a THEN 100 WHEN value = a THEN 90 WHEN s * value <= s * b THEN " + _between_sql("a", 90, "b", 70)
    + " WHEN s * value <= s * c THEN " + _between_sql("b", 70, "c", 50) + " WHEN s * value <= s * d THEN " + _between_sql("c", 50, "d", 30)
    + " ELSE round(greatest(0, 30 - 30 * abs(value - d) / d)) END))::BIGINT"
)
_LETTER = "CASE " + " ".join(f"WHEN score >= {n} THEN '{x}'" for n, x in G.SCALE) + " ELSE 'F' END"


def _grades(by: str, source: str) -> str:
    own = f"{by}, " if by else ""
    return f"""sc AS (SELECT {own}category, weight, {_SCORE} AS score FROM (SELECT v.*, lim.* EXCLUDE (metric, key), CASE WHEN good = 'high' THEN -1 ELSE 1 END AS s FROM {source} v JOIN lim USING (metric, key))),
    gr AS (SELECT *, {_LETTER} AS grade FROM (SELECT {own}category, count(*) AS n_metrics, round(sum(weight::DECIMAL(10, 4) * score)::DOUBLE / sum(weight::DECIMAL(10, 4))::DOUBLE)::BIGINT AS score FROM sc GROUP BY ALL))"""


def _flat(source: str, by: str = "") -> str:
    own = f"{by}, " if by else ""
    return " UNION ALL ".join(f"SELECT {own}metric AS grp, concat('{k}_', key) AS key, {k} AS value FROM {source}" for k in ("mean", "std", "min", "max"))


def oracle_sql() -> dict[str, str]:
    pre, fm = f"WITH {Q.PRELUDE}", f"WITH {Q.long_form()}"
    agg = f", cb AS (SELECT metric, key, {_AGG} FROM fm GROUP BY ALL)"
    means = f"{fm}{agg}, mv AS (SELECT metric, key, mean AS value FROM cb), {_limits_sql()}"
    impact = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.IMPACT.items()) + " ELSE 1 END"
    grams = "list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {k} - 1], ' ') FOR i IN range(1, len(w) - {k} + 2)] END)"
    words = lambda x: f"regexp_extract_all(lower({x}), '{X.RUN}')"
    styles = "CASE WHEN regexp_matches({0}, '^[A-Z][a-zA-Z0-9]*$') THEN 'pascal_case' WHEN regexp_matches({0}, '^[a-z][a-z0-9]*([A-Z][a-zA-Z0-9]*)+$') THEN 'camel_case' WHEN regexp_matches({0}, '^[a-z]+(_[a-z0-9]+)*$') THEN 'snake_case' WHEN regexp_matches({0}, '^[A-Z]+(_[A-Z0-9]+)*$') THEN 'macro_case' WHEN regexp_matches({0}, '^[a-z]+(-[a-z0-9]+)*$') THEN 'kebab_case' ELSE 'other' END"
    subs = "list_filter(string_split(regexp_replace(w, '([a-z])([A-Z])', '\\1_\\2', 'g'), '_'), lambda x: x <> '')"
    langs = "CASE " + "{0} " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in vocab.language_of().items()) + " ELSE 'unknown' END"
    globs = " OR ".join(f"regexp_matches(path, '{X.glob_pattern(g)}')" for g in GLOBS)
    out = Q.all_sql()
    out |= {
        "lex_tokens": f"{pre}, t AS (SELECT path, no, unnest(x) AS token, unnest(range(1, len(x) + 1)) AS k FROM (SELECT path, no, regexp_extract_all(l, '{X.TOKEN}') AS x FROM ln)) SELECT path, no AS line, k, token, {_KIND.format('token')} AS kind FROM t",
        "lex_token_counts": f"{pre} SELECT path, t AS token, c AS n FROM tc",
        "lex_words": f"{pre} SELECT path, row_number() OVER (PARTITION BY path ORDER BY no) AS k, w AS word FROM w",
        "lex_identifiers": f"{pre} SELECT path, pos AS k, w AS identifier FROM ids",
        "lex_lines": f"{pre} SELECT path, lc.n AS line_count, strlen(content)::BIGINT AS byte_count FROM f JOIN lc USING (path)",
        "lex_casing": f"{pre} SELECT w AS identifier, count(*) AS n, {styles.format('w')} AS style FROM ids GROUP BY w",
        "lex_subwords": f"{pre} SELECT w AS word, count(*) AS n, len({subs})::BIGINT AS parts, array_to_string({subs}, ' ') AS sub_words FROM w GROUP BY w",
        "lex_kgrams": f"{pre}, k AS (SELECT path, list({_KIND.format('t')} ORDER BY pos) AS w FROM tok GROUP BY path) SELECT f.path, CASE WHEN w IS NULL THEN 0 ELSE greatest(1, len(w) - 4) END::BIGINT AS n, coalesce(len({grams.format(k=5)}), 0)::BIGINT AS n_distinct FROM f LEFT JOIN k USING (path)",
        "lang_detect": f"SELECT page_id, {langs.format('e')} AS language FROM (SELECT page_id, CASE WHEN regexp_extract(b, '[^.]\\.([^.]+)$', 1) = '' THEN b ELSE regexp_extract(b, '[^.]\\.([^.]+)$', 1) END AS e FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS b FROM pages))",
        "glob_ignore": f"{pre} SELECT path FROM f WHERE NOT ({globs})",
        "agg_codebase": f"{fm}{agg} SELECT * FROM cb",
        "history": f"{fm} SELECT snapshot, metric, key, {_AGG} FROM fm GROUP BY ALL",
        "grade_metrics_relational": f"{means} SELECT category, metric, key, value, {_SCORE} AS score FROM (SELECT mv.*, lim.* EXCLUDE (metric, key), CASE WHEN good = 'high' THEN -1 ELSE 1 END AS s FROM mv JOIN lim USING (metric, key))",
        "grade_threshold_relational": f"{means}, {_grades('', 'mv')} SELECT category, n_metrics, score, grade FROM gr",
        "grade_files_relational": f"{fm}, {_limits_sql()}, {_grades('path', '(SELECT path, metric, key, value FROM fm)')} SELECT path, category, n_metrics, score, grade FROM gr",
        "overall_relational": f"{means}, {_grades('', 'mv')} SELECT score AS overall_score, {_LETTER} AS overall_grade, score >= 55 AS passes FROM (SELECT round(sum(score * {impact}) / sum({impact}))::BIGINT AS score FROM gr)",
        "worst_offenders_relational": f"{fm}, {_limits_sql()}, {_grades('path', '(SELECT path, metric, key, value FROM fm)')} SELECT * FROM (SELECT path, category, n_metrics, score, grade, row_number() OVER (PARTITION BY category ORDER BY score, path) AS rank FROM gr) WHERE rank <= 3",
        "dup_exact": f"{pre} SELECT path, min(path) OVER (PARTITION BY content) AS class, count(*) OVER (PARTITION BY content) AS copies FROM f",
        "dup_jaccard": f"{pre}, s AS (SELECT path, list_sort({grams.format(k=5)}) AS g FROM (SELECT path, {words('content')} AS w FROM f)), c AS (SELECT min(path) AS class, g FROM s WHERE len(g) > 0 GROUP BY g), e AS (SELECT class, len(g) AS n, unnest(g) AS g FROM c), p AS (SELECT a.class AS a, b.class AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b USING (g) WHERE a.class < b.class GROUP BY ALL) SELECT a, b, shared, round(shared / (na + nb - shared), 4) AS jaccard FROM p WHERE shared / (na + nb - shared) >= 0.2",
        "contamination": f"{pre}, p AS (SELECT item, len(g) AS n, unnest(g) AS g FROM (SELECT item_id AS item, {grams.format(k=8)} AS g FROM (SELECT item_id, {words('text')} AS w FROM benchmark))), s AS (SELECT path, unnest(g) AS g FROM (SELECT path, {grams.format(k=8)} AS g FROM (SELECT path, {words('content')} AS w FROM f))), j AS (SELECT item, path, n, count(*) AS shared FROM p JOIN s USING (g) GROUP BY ALL) SELECT item, path, shared, round(shared / n, 4) AS share FROM j WHERE shared >= 0.5 * n",
        "changed_files": "WITH d AS (SELECT doc_id, (doc_id // 2)::VARCHAR AS path, coalesce(text, '') AS content FROM documents), b AS (SELECT * FROM d WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0), h AS (SELECT * FROM d WHERE doc_id % 2 = 1 AND doc_id % 7 <> 0) SELECT path, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN h.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM b FULL JOIN h USING (path) WHERE b.content IS DISTINCT FROM h.content",
        "power_law": f"{pre}, p AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, ln(x) AS lx, ln(y) AS ly FROM (SELECT count(w.w) AS x, any_value(length(content)) AS y FROM f LEFT JOIN w USING (path) GROUP BY path) WHERE x > 0 AND y > 0) SELECT count(*) AS n, round((count(*) * sum(x * y) - sum(x) * sum(y)) / sqrt((count(*) * sum(x * x) - sum(x) ** 2) * (count(*) * sum(y * y) - sum(y) ** 2)), 4) AS correlation, round(regr_slope(ly, lx), 4) AS exponent, round(regr_r2(ly, lx), 4) AS r_squared FROM p",
    }
    both = ", ".join(f"{n} AS (SELECT metric, key, {_AGG} FROM fm JOIN (SELECT concat(coalesce(source, '-'), '/', doc_id) AS path, lang FROM documents) USING (path) WHERE lang {op} 'en' GROUP BY ALL)" for n, op in (("b", "IS DISTINCT FROM"), ("h", "=")))
    out["compare"] = f"{fm}, {both} SELECT b.metric AS grp, concat('mean_', b.key) AS key, b.mean AS base, h.mean AS head, round(h.mean - b.mean, 4) + 0.0 AS delta FROM b JOIN h USING (metric, key)"
    sides = ", ".join(f"{n} AS (SELECT metric AS grp, concat('mean_', key) AS key, mean AS v FROM (SELECT metric, key, {_AGG} FROM fm JOIN (SELECT concat(coalesce(source, '-'), '/', d.doc_id) AS path FROM documents d JOIN labels l USING (doc_id) WHERE quality = {q}) USING (path) GROUP BY ALL) WHERE mean > 0)" for n, q in (("g", 1), ("b", 0)))
    learned = f"{sides}, ld AS (SELECT grp, key, g.v AS good, b.v AS bad, ln(g.v) - ln(b.v) AS diff, g.v / b.v AS ratio FROM g JOIN b USING (grp, key)), le AS (SELECT grp, key, good, bad, round(ratio, 4) AS ratio, round(scalar, 4) + 0.0 AS scalar FROM (SELECT *, 2 * diff / max(abs(diff)) OVER () AS scalar FROM ld) WHERE ratio NOT BETWEEN 0.995 AND 1.005)"
    out["learn_scalars"] = f"{fm}, {learned} SELECT * FROM le"
    flat = f"fl AS ({_flat('cb')})"
    log = "ln(greatest(value, 1e-300))"
    out["score_aggregate"] = f"{fm}{agg}, {flat}, {learned} SELECT 'quality' AS category, grp AS behavior, round(sum(scalar * coalesce(CASE WHEN value > 0 THEN ln(value) END, 0)), 4) + 0.0 AS log_score FROM le LEFT JOIN fl USING (grp, key) GROUP BY grp"
    cos = "round(coalesce(sum(scalar * l) / nullif(sqrt(any_value(ss)) * sqrt(sum(l * l)), 0), 0), 4) + 0.0"
    sized = f"lw AS (SELECT grp AS behavior, grp, key, scalar, sum(scalar * scalar) OVER (PARTITION BY grp) AS ss FROM le)"
    band = " ".join(f"WHEN cosine >= {lo} THEN round({p} + (cosine - {lo}) / ({hi} - {lo}) * ({q} - {p}))" for lo, p, hi, q in ((0.5, 90, 1.0, 100), (0.2, 70, 0.5, 90), (0.0, 50, 0.2, 70), (-0.3, 30, 0.0, 50), (-1.0, 0, -0.3, 30)))
    out["diagnose"] = f"{fm}{agg}, {flat}, {learned}, {sized}, co AS (SELECT 'quality' AS category, behavior, {cos} AS cosine FROM (SELECT *, coalesce({log}, 0) AS l FROM lw LEFT JOIN fl USING (grp, key)) GROUP BY behavior) SELECT *, greatest(0, least(100, CASE {band} ELSE 0 END))::BIGINT AS score FROM co"
    out["worst_files"] = f"{fm}, {learned}, {sized}, co AS (SELECT path, behavior, {cos} AS cosine FROM (SELECT path, lw.*, {log} AS l FROM lw JOIN (SELECT path, metric AS grp, concat('mean_', key) AS key, value FROM fm) USING (grp, key)) GROUP BY path, behavior) SELECT * FROM (SELECT path, 'quality' AS category, behavior, cosine, row_number() OVER (PARTITION BY behavior ORDER BY cosine, path) AS rank FROM co WHERE cosine <= -0.15) WHERE rank <= 2"
    fin = "mean, round(sqrt(greatest(q / n - (s::DOUBLE / n) ** 2, 0)), 4) + 0.0 AS std, round(lo, 4) + 0.0 AS min, round(hi, 4) + 0.0 AS max"
    out["agg_incremental"] = f"""{fm}, st AS (SELECT metric, key, count(*) AS n, sum(value::DECIMAL(38, 6)) AS s, sum(value * value) AS q, min(value) AS lo, max(value) AS hi FROM fm GROUP BY ALL),
    o AS (SELECT metric, key, value AS o FROM fm WHERE ends_with(path, '/0')), nw AS (SELECT metric, key, value AS w FROM fm WHERE ends_with(path, '/1')),
    sw AS (SELECT metric, key, n, s - coalesce(o, 0)::DECIMAL(38, 6) + coalesce(w, 0)::DECIMAL(38, 6) AS s, q - coalesce(o, 0) ** 2 + coalesce(w, 0) ** 2 AS q, least(lo, coalesce(w, 0)) AS lo, greatest(hi, coalesce(w, 0)) AS hi
      FROM st LEFT JOIN o USING (metric, key) LEFT JOIN nw USING (metric, key))
    SELECT metric, key, round(s::DOUBLE / n, 4) + 0.0 AS {fin} FROM sw"""
    two = f"WITH {Q.long_form(['lexical_density', 'separator_counts'])}"
    div = "round(coalesce({0} / nullif({1}, 0), 0), 4) + 0.0"
    out["m_combinations"] = f"""{two}, k AS (SELECT path, concat(metric, '.', key) AS k, value AS v FROM fm)
    SELECT path, a.k AS a, b.k AS b, round(a.v + b.v, 4) + 0.0 AS add, round(a.v - b.v, 4) + 0.0 AS sub_a_b, round(b.v - a.v, 4) + 0.0 AS sub_b_a, round(a.v * b.v, 4) + 0.0 AS mul,
    {div.format('a.v', 'b.v')} AS div_a_b, {div.format('b.v', 'a.v')} AS div_b_a FROM k a JOIN k b USING (path) WHERE a.k < b.k"""
    out["correlate"] = f"""{fm}, h AS (SELECT snapshot, concat(metric, '.mean_', key) AS name, mean AS v FROM (SELECT snapshot, metric, key, {_AGG} FROM fm GROUP BY ALL)),
    g AS (SELECT n.name, s.snapshot, coalesce(h.v, 0) AS v FROM (SELECT DISTINCT name FROM h) n CROSS JOIN (SELECT DISTINCT snapshot FROM h) s LEFT JOIN h ON h.name = n.name AND h.snapshot = s.snapshot),
    vary AS (SELECT * FROM g WHERE name IN (SELECT name FROM g GROUP BY name HAVING min(v) <> max(v))),
    p AS (SELECT a.name AS a, b.name AS b, count(*)::DOUBLE AS n, sum(a.v) AS sx, sum(b.v) AS sy, sum(a.v * b.v) AS sxy, sum(a.v * a.v) AS sxx, sum(b.v * b.v) AS syy FROM vary a JOIN vary b USING (snapshot)
      WHERE a.name < b.name AND NOT list_has_any(string_split_regex(regexp_extract(a.name, '^([^.]*)', 1), '[_,]'), string_split_regex(regexp_extract(b.name, '^([^.]*)', 1), '[_,]')) GROUP BY ALL)
    SELECT * FROM (SELECT a, b, round(coalesce((n * sxy - sx * sy) / nullif(sqrt(greatest((n * sxx - sx * sx) * (n * syy - sy * sy), 0)), 0), 0), 4) + 0.0 AS correlation FROM p) WHERE abs(correlation) BETWEEN 0.5 AND 1"""
    order_by = "SELECT a, b, correlation FROM ({}) ORDER BY abs(correlation) DESC, a, b LIMIT 20"
    out["top_correlations"] = order_by.format(out["correlate"])
    out["cosine_grades"] = f"SELECT *, {_LETTER} AS grade FROM (SELECT substr(behavior, 1, 4) AS category, count(*) FILTER (abs(cosine) >= 0.15) AS n_behaviors, coalesce(round(avg(score) FILTER (abs(cosine) >= 0.15)), 50)::BIGINT AS score FROM ({out['diagnose']}) GROUP BY ALL)"
    letters = "CASE " + " ".join(f"WHEN score >= {n} THEN '{x}'" for n, x in V.COMBINED) + " ELSE 'F' END"
    out["combined_grade"] = f"SELECT score, {letters} AS grade FROM (SELECT round(avg(score))::BIGINT AS score FROM ({out['cosine_grades']}))"
    out["learned_baseline"] = f"{fm}, {learned} SELECT round(sum(scalar * ln(sqrt(good * bad))), 4) + 0.0 AS log_baseline FROM le"
    out["top_metrics"] = f"""{fm}{agg}, {flat}, {learned}, tm AS (SELECT 'quality' AS category, grp AS behavior, grp, key, round(scalar * coalesce({log}, 0), 4) + 0.0 AS contribution FROM le LEFT JOIN fl USING (grp, key))
    SELECT * FROM (SELECT category, behavior, row_number() OVER (PARTITION BY behavior ORDER BY contribution, grp, key) AS rank, grp, key, contribution FROM tm) WHERE rank <= 2"""
    out["diff_ranges"] = "SELECT concat('f', doc_id) AS path, doc_id % 9 AS first, doc_id % 9 + doc_id % 4 - 1 AS last FROM documents WHERE doc_id % 4 > 0"
    return out
