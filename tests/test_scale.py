"""Figures and pairs of texts that are large or odd."""

import time

from pyspark.sql import functions as F

from gaugeworks.functions import text as X
from gaugeworks.operators import aggregate as A
from gaugeworks.operators import compress as C
from gaugeworks.operators import folds
from gaugeworks.operators import metrics as M
from gaugeworks.operators import pairs as P


def test_long_runs_are_read_once(spark):
    run = "a" * 200_000
    files = spark.createDataFrame([("p", f"{run} {run}: 1{run}, {'1' * 100_000}x")], "path string, content string")
    start = time.time()
    r = M.METRICS["punctuation_density"](X.lexed(files)).first()
    m = M.METRICS["magic_number_density"](X.lexed(files)).first()
    assert time.time() - start < 20
    assert (r["colon_suffix_density"], r["id_nonalpha_suffix_density"], m["magic_number_count"]) == (round(1 / 8, 4), round(2 / 8, 4), 0)


def test_states_of_tasks_are_the_aggregate(spark):
    texts = [(f"p{k}", "ab" if k % 3 else None, f"def f{k}(x, 'y'):\n  return {k}.5 # a_b\n" * (k % 7) + "? ! " * (k % 5)) for k in range(40)]
    files = spark.createDataFrame([*texts, ("large", "ab", "if x == y1 ( z ) ; " * 3000)], "path string, snapshot string, content string").repartition(4)
    for by in ([], ["snapshot"]):
        want = A.codebase(M.file_metrics(files), by).collect()
        got = A.finalize(A.merged(M.file_states(files, by=by), by), by).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_chosen_figures(spark):
    files = spark.createDataFrame([("p", "a b\nc")], "path string, content string")
    assert [tuple(r) for r in M.file_metrics(files, ["ngram", "branching"], only={("ngram", "bigram_total")}).collect()] == [("p", "ngram", "bigram_total", 2.0)]


def test_keywords_of_lexed_files(spark):
    files = spark.createDataFrame([("p", "foo bar foo")], "path string, content string")
    assert M.METRICS["vocabulary"](X.lexed(files)).first()["total_identifiers"] == 3
    assert M.METRICS["vocabulary"](X.lexed(files, ("foo",))).first()["total_identifiers"] == 1


def test_tokens_are_counted_in_their_file(spark):
    files = spark.createDataFrame([("p", "a b a é1.5"), ("q", ""), ("r", None), ("s", "x")], "path string, content string")
    got = files.select("path", F.inline(folds.token_counts()("content"))).collect()
    assert sorted(map(tuple, got)) == [("p", "1.5", 1), ("p", "a", 2), ("p", "b", 1), ("p", "é", 1), ("s", "x", 1)]


def test_texts_with_equal_shingles_are_paired(spark):
    """Texts that differ in marks and case only are one class of shingles, but different texts."""
    texts = [("a", "one two three four five six"), ("b", "One two, three four five six!"), ("c", "one two three four five seven"), ("d", "one two three four five six"), ("e", "")]
    files = spark.createDataFrame(texts, "path string, content string")
    pairs = P.text_pairs(files, least=0.3)
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")]
    rows = C.nearest(C.distances(pairs, files)).collect()
    assert len(rows) == 8 and next(r["other"] for r in rows if r["path"] == "a" and r["rank"] == 1) == "d"


def test_pairs_are_those_of_brute_force(spark):
    words = [f"w{k * k % 23}" for k in range(400)]
    texts = [(f"p{k:02}", " ".join(words[k * 7 : k * 7 + 20 + k % 13])) for k in range(50)]
    got = P.jaccard_pairs(P.shingled(spark.createDataFrame(texts, "path string, content string"))).collect()
    sets, classes = {}, {}
    for path, text in texts:
        w = text.split(" ")
        sets[path] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        classes.setdefault(sets[path], path)
    own = sorted(classes.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in own for b in own if a < b and 5 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(r["a"], r["b"], r["shared"]) for r in got} == want and want


def test_blocks_are_parsed_once_for_proportions(spark):
    """The rows of blocks are read four times, and kept; tokens are plain tuples."""
    from gaugeworks.operators import blocks as B
    from gaugeworks.plans import queries

    assert isinstance(B.lex("a")[0], tuple)
    plan = queries.block_proportions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and "MapInArrow" not in plan.split("InMemoryRelation")[0]
