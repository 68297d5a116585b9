"""Leave-one-out impact, behaviours, settings, reports and entry points on small inputs."""

import subprocess

from pyspark.sql import functions as F

from gaugeworks.operators import aggregate as A
from gaugeworks.operators import behaviors as V
from gaugeworks.operators import impact as I
from gaugeworks.operators import metrics as M
from gaugeworks.operators import scoring as S
from gaugeworks.plans import commands, report
from gaugeworks.sources import config, git

CODE = "def a(x, y, z):\n    q = [x, y, z, x, y, z, 'é']\n    return (x + y + z + 1 + 2 + 3 + x)\n\n\nfoo = 1\n"
WEIGHTS = [("size", "short", "halstead", "mean_length", -1.0), ("size", "short", "entropy", "mean_total_tokens", -0.5), ("text", "plain", "symbol_density", "mean_density", -1.0)]


def tables(spark):
    weights = spark.createDataFrame(WEIGHTS, "category string, behavior string, grp string, key string, scalar double")
    about = spark.createDataFrame(
        [("size", "short", ["python"], [], [], -1.5, "Split this {{type}} of {{line_count}} lines {{x}}.", None), ("text", "plain", [], ["go"], ["doc"], 0.0, None, "d")], V.ABOUT
    )
    return weights, about


def files(spark):
    return spark.createDataFrame([("a.py", CODE, "python"), ("b.go", CODE.replace("é", "e") * 2, "go"), ("c.py", "x = 1\n", "python")], "path string, content string, language string")


def test_blocks_are_cut_out_of_the_bytes(spark):
    fs = files(spark)
    nodes = I.blocks(fs)
    got = {(r["path"], r["block"]): r["content"] for r in I.without(fs, nodes).collect()}
    spans = {(r["path"], r["block"]): r for r in nodes.where("n_tokens >= 10").collect()}
    assert got and set(got) == set(spans)
    for (path, block), rest in got.items():
        content = next(r["content"] for r in fs.collect() if r["path"] == path)
        assert len(rest) < len(content)
        k = next(i for i in range(len(rest) + 1) if i == len(rest) or rest[i] != content[i])
        assert content.startswith(rest[:k]) and content.encode().endswith(rest.encode()[len(rest[:k].encode()) :])


def test_potentials_are_those_of_recomputing(spark):
    fs = files(spark)
    weights, about = tables(spark)
    nodes = I.blocks(fs)
    names = ["halstead", "entropy", "symbol_density"]
    figures = M.file_metrics(fs, names)
    got = {(r["path"], r["block"], r["behavior"]): r["cosine_delta"] for r in I.potentials(fs, nodes, weights, about, figures).collect()}
    assert got and not any(p == "b.go" and b == "plain" for p, _, b in got)  # its language is excluded
    means = lambda f: f.select("path", F.col("metric").alias("grp"), F.concat(F.lit("mean_"), "key").alias("key"), "value")
    whole = {(r["path"], r["behavior"]): r["cosine"] for r in S.cosines(means(figures), weights, ["path"]).collect()}
    corpus = {r["behavior"]: r["cosine"] for r in S.cosines(A.flat(A.codebase(figures)), weights).collect()}
    path, block, behavior = sorted(got)[0]
    rest = I.without(fs, nodes).where((F.col("path") == path) & (F.col("block") == block)).select("path", "content")
    new = M.file_metrics(rest, names)
    alone = {r["behavior"]: r["cosine"] for r in S.cosines(means(new), weights, ["path"]).collect()}
    swapped = A.codebase(figures.where(F.col("path") != path).unionByName(new.select(*figures.columns) if "language" not in figures.columns else new.withColumn("language", F.lit("python")).select(*figures.columns)))
    other = {r["behavior"]: r["cosine"] for r in S.cosines(A.flat(swapped), weights).collect()}
    want = max(alone.get(behavior, 0) - whole[path, behavior], other[behavior] - corpus[behavior], 0 if behavior not in alone else -9)
    assert abs(got[path, block, behavior] - want) < 0.02


def test_what_stands_out(spark):
    weights, about = tables(spark)
    nodes = spark.createDataFrame(
        [("a", k, 0, 0, 1 + 5 * k, 4 + 5 * k, 0, 20, 50, "code") for k in range(3)] + [("a", 9, 0, 0, 1, 4, 0, 20, 50, "code"), ("a", 10, 0, 0, 1, 40, 0, 20, 50, "code")],
        "path string, block long, parent long, depth long, start_line long, end_line long, start_col long, n_tokens long, n_chars long, kind string",
    )
    found = spark.createDataFrame([("a", k, "size", "short", d) for k, d in ((0, 0.1), (1, 0.2), (2, 0.9), (9, 0.8), (10, 0.7))], "path string, block long, category string, behavior string, cosine_delta double")
    corpus = spark.createDataFrame([("size", "short", 0.2)], "category string, behavior string, cosine double")
    rows = I.flagged(nodes, found, corpus, about)
    assert [(r["block"], r["severity"], r["hint"]) for r in rows.orderBy("block").collect()] == [(1, "medium", "Split this code of 4 lines {{x}}."), (2, "critical", "Split this code of 4 lines {{x}}.")]
    ranges = spark.createDataFrame([("a", 8, 9)], "path string, first long, last long")
    assert [r["block"] for r in I.flagged(nodes, found, corpus, about, ranges).collect()] == [1]
    text = spark.createDataFrame([("a", "\n".join(map(str, range(1, 30))))], "path string, content string")
    top = I.top_blocks(rows, text).collect()
    assert [(r["block"], r["worst"], r["source"]) for r in top] == [(2, 0.8, "11\n12\n13\n14"), (1, 0.1, "6\n7\n8\n9")]
    assert [r["block"] for r in I.worst_by_category(rows).collect()] == [2] and [r["severity"] for r in I.tasks(rows).collect()] == ["critical"]
    assert [(r["block"], r["rank"]) for r in I.top_nodes(nodes, found).collect()] == [(2, 1), (9, 2), (10, 3)]
    assert "[critical] a:11-14 size.short" in report.agent(I.tasks(rows).collect())


def test_behaviors(spark):
    weights, about = tables(spark)
    agg = spark.createDataFrame([("halstead", "mean_length", 4.0), ("entropy", "mean_total_tokens", 9.0), ("symbol_density", "mean_density", 0.5)], "grp string, key string, value double")
    got = {r["behavior"]: r["score"] for r in V.calibrated(agg, weights, about).collect()}
    assert got == {"short": -0.9849, "plain": 0.6931}
    assert [r["behavior"] for r in V.diagnosed(agg, weights, about, ["go"]).collect()] == ["plain"]
    assert [r["behavior"] for r in V.diagnosed(agg, weights, about).collect()] == ["short", "plain"]
    better = agg.withColumn("value", F.col("value") / 2)
    assert {r["behavior"]: (r["ratio"], r["direction_ok"]) for r in V.separation(better, agg, weights).collect()} == {"short": (2.83, True), "plain": (2.0, True)}
    w, a = V.learned(agg, better, "c", "b", ["go"])
    assert {round(r["scalar"], 2) for r in w.collect()} == {2.0} and a.first()["languages"] == ["go"]
    grades = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.1), ("y", "c", 0.1)], "category string, behavior string, cosine double")
    assert {tuple(r) for r in V.grade_cosines(grades).collect()} == {("x", 1, 90, "A-"), ("y", 0, 50, "C-")}
    assert tuple(V.combined(V.grade_cosines(grades)).first()) == (70, "C-")
    samples = spark.createDataFrame([("size", "short", "good", "go"), ("size", "short", "bad", "go"), ("size", "short", "bad", "lua")], "category string, behavior string, side string, language string")
    assert {r["behavior"]: r["languages"] for r in V.sample_languages(samples, about).collect()} == {"short": ["go"], "plain": []}
    assert V.default_scalars(spark).count() > 100 and {r["grp"] for r in V.referenced(weights).collect()} == {"halstead", "entropy", "symbol_density"}


def test_tables_as_text(spark, tmp_path):
    weights, about = tables(spark)
    config.write_behaviors(weights, about, str(tmp_path))
    w, a = config.read_behaviors(spark, str(tmp_path))
    assert sorted(map(tuple, w.collect())) == sorted(WEIGHTS) and sorted(map(tuple, a.collect())) == sorted(map(tuple, about.collect()))


def test_settings():
    text = "ignore_paths:\n  - vendor/**\n  - 'a b'\ncombined_top: 3\nimpact:\n  naming: 7\nnear_duplicate_blocks:\n  max_pairs_per_bucket: 5\n# end\n"
    p = config.Project.of(config.parse(text))
    assert p.ignore_paths == ("vendor/**", "a b") and p.combined_top == 3 and p.impact["naming"] == 7 and p.impact["complexity"] == 5 and p.max_pairs_per_bucket == 5
    r = config.Report.of(config.parse("categories:\n  naming:\n    metrics:\n      mean:\n        source: identifier_length_variance.mean\n        weight: 0.5\n        thresholds: \n          a: 1\ngrade_scale:\n  A: 90\n  B: 50\n"))
    row = next(x for x in r.thresholds if x[:3] == ("naming", "identifier_length_variance", "mean"))
    assert row[4] == 1 and row[5] == 18 and row[8] == 0.5 and r.scale == ((90, "A"), (50, "B")) and len(r.thresholds) == 24


def test_parts(tmp_path):
    assert report.parts("abc") == ["abc", "", ""] and "".join(report.parts("line\n" * 100, 22)) == "line\n" * 100
    assert len(report.write_parts("x" * 130_000, str(tmp_path))) == 3


def test_a_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text(CODE)
    (tmp_path / "b.txt").write_text("no source")
    (tmp_path / "gone.py").write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("gone.py\n")
    run("add", "a.py", "b.txt", ".gitignore")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text(CODE + "y = 2\n")
    run("commit", "-qam", "two")
    refs = git.commits(str(tmp_path), 5)
    assert len(refs) == 2 and [r["path"] for r in git.at_ref(spark, str(tmp_path), refs[0]).collect()] == ["a.py"]
    assert {r["path"] for r in commands.corpus(spark, str(tmp_path)).collect()} == {"a.py"}
    weights, about = tables(spark)
    assert commands.diagnose(spark, str(tmp_path), weights, about).count() == 2
    h = commands.history(spark, str(tmp_path), refs)
    assert h.select("snapshot").distinct().count() == 2
    lines = git.diff_lines(spark, str(tmp_path), refs[0], refs[1])
    from gaugeworks.sources.snapshots import diff_ranges
    assert [tuple(r) for r in diff_ranges(lines).collect()] == [("a.py", 7, 7)]
