"""Grades, deltas, classes and snapshots on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeworks.functions import text as X
from gaugeworks.operators import aggregate as A
from gaugeworks.operators import grading as G
from gaugeworks.operators import pairs as P
from gaugeworks.operators import scoring as S
from gaugeworks.sources import snapshots

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("cosine", "score"), [(1, 100), (-1, 0), (0.5, 90), (0.2, 70), (0, 50), (-0.3, 30), (0.12, 62), (0.35, 80), (0.75, 95), (-0.15, 40), (-0.65, 15)])
def test_score_cosine(spark, cosine, score):
    assert one(spark, G.score_cosine(F.lit(float(cosine)))) == score


@pytest.mark.parametrize(("value", "good", "score"), [(5.0, "low", 100), (10.0, "low", 90), (20.0, "low", 70), (40.0, "low", 30), (60.0, "low", 15), (200.0, "low", 0)])
def test_score_metric(spark, value, good, score):
    t = [F.lit(float(x)) for x in (10, 20, 30, 40)]
    assert one(spark, G.score_metric(F.lit(value), F.lit(good), *t)) == score


def test_overall(spark):
    rows = lambda r: spark.createDataFrame(r, "category string, score long")
    assert tuple(G.overall(rows([("a", 80), ("b", 60)])).first()) == (70, "B-")
    assert tuple(G.overall(rows([("a", 80), ("b", 60)]), {"a": 3}).first()) == (75, "B")
    assert tuple(G.overall(rows([])).first()) == (0, "F")


def test_delta(spark):
    rows = lambda r: spark.createDataFrame(r, "grp string, key string, value double")
    got = A.delta(rows([("m", "a", 5.0), ("m", "b", 1.0), ("m", "c", 1.0)]), rows([("m", "a", 6.0), ("m", "b", 4.3333)])).collect()
    assert sorted((r["key"], r["delta"]) for r in got) == [("a", 1.0), ("b", 3.3333)]


def test_incremental_is_recomputed(spark):
    rows = lambda r: spark.createDataFrame(r, "path string, metric string, key string, value double")
    f = rows([("p", "m", "k", 1.0), ("q", "m", "k", 3.0), ("r", "m", "k", 8.0)])
    new = rows([("q", "m", "k", 4.0)])
    swapped = A.finalize(A.swapped(A.state(f), f.where("path = 'q'"), new)).first()
    whole = A.codebase(f.where("path <> 'q'").union(new)).first()
    assert swapped["mean"] == whole["mean"] and swapped["std"] == whole["std"]


def test_zero_and_absent_values_in_cosines(spark):
    weights = spark.createDataFrame([("c", "b", "g", "x", 1.0), ("c", "b", "g", "y", 1.0)], "category string, behavior string, grp string, key string, scalar double")
    agg = spark.createDataFrame([("g", "x", 0.0)], "grp string, key string, value double")
    assert S.cosines(agg, weights).first()["cosine"] == -0.7071
    assert S.product_scores(agg, weights).first()["log_score"] == 0.0


def test_jaccard_classes_and_pruning(spark):
    files = spark.createDataFrame([("a", "one two three four five six"), ("b", "one two three four five six"), ("c", "one two three four five seven"), ("d", "")], "path string, content string")
    got = P.jaccard_pairs(P.shingled(files), 0.3).collect()
    assert [(r["a"], r["b"], r["shared"], r["jaccard"]) for r in got] == [("a", "c", 1, 0.3333)]
    assert P.jaccard_pairs(P.shingled(files), 0.3, most=1).count() == 0


@pytest.mark.parametrize(("d", "n", "b"), [(0, 10, 0), (5, 10, 8), (6, 10, None), (1, 20, 1), (3, 10, 6), (1, 0, None)])
def test_bucket(spark, d, n, b):
    assert one(spark, P.bucket(F.lit(d), F.lit(n))) == b


def test_globs_and_languages(spark):
    assert X.glob_pattern("**/*.md") == r"^.*/[^/]*\.md$"
    rows = spark.createDataFrame([("a/b.md",), ("b.md",), ("x/Makefile",), ("m.PY",), ("m.py",)], "path string")
    got = {r["path"]: (r["i"], r["l"]) for r in rows.select("path", X.ignored(F.col("path"), ["**/*.md"]).alias("i"), X.language(F.col("path")).alias("l")).collect()}
    assert got == {"a/b.md": (True, "markdown"), "b.md": (False, "markdown"), "x/Makefile": (False, "makefile"), "m.PY": (False, "unknown"), "m.py": (False, "python")}


def test_strip_comments_keeps_lines(spark):
    assert one(spark, X.strip_comments(F.lit("a /* b\nc */ d // e\nf"), ["//"], [("/*", "*/")])) == "a \n d \nf"


def test_snapshots(spark):
    rows = lambda r: spark.createDataFrame(r, "path string, content string")
    got = snapshots.changed(rows([("a", "1"), ("b", "1"), ("c", "1")]), rows([("b", "2"), ("c", "1"), ("d", "1")])).collect()
    assert sorted(map(tuple, got)) == [("a", "deleted"), ("b", "modified"), ("d", "added")]
    diff = ["--- a/x", "+++ b/x", "@@ -1,2 +3,4 @@", " y", "@@ -9 +12 @@", "@@ -20,2 +21,0 @@", "+++ b/z", "@@ -1 +1,2 @@"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(diff)], "diff int, no int, line string")
    assert sorted(map(tuple, snapshots.diff_ranges(lines).collect())) == [("x", 3, 6), ("x", 12, 12), ("z", 1, 2)]


def rounded(row):
    return tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", ["m_entropy", "m_ngram", "m_casing_entropy", "lex_tokens", "lex_subwords", "grade_threshold_relational", "m_mtld", "m_unreachable_code", "diff_ranges", "dup_jaccard", "dup_exact", "changed_files"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(rounded, got.select(*names).collect()))) == sorted(map(repr, map(rounded, want.fetchall())))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
