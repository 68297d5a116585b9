"""Sources, sinks, streams and compression on small files."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import aggregate as A
from gaugeworks.operators import compress as C
from gaugeworks.operators import metrics as M
from gaugeworks.sources import files as S
from gaugeworks.streaming import metrics as streams

NAMES = ["separator_counts", "lexical_density"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for path, text in {
        "a.py": "x = 1\n", "lib/b.RB": "y = 2\n", "lib/.hidden.py": "n", "node_modules/c.js": "n", ".git/d.py": "n", "docs/r.md": "n", "e.bin": "n",
        "gen/f.py": "z", "Makefile": "all:\n", "outer/g.py": "w\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_scan(spark, tree):
    got = {r["path"]: (r["content"], r["language"]) for r in S.scan(spark, str(tree), ["**/*.md", "gen/*"]).collect()}
    assert got == {"a.py": ("x = 1\n", "python"), "lib/b.RB": ("y = 2\n", "unknown"), "Makefile": ("all:\n", "makefile"), "outer/g.py": ("w\n", "python")}


def test_sinks_and_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", "x_y = 1"), ("b", "x_y = 1"), ("c", "z")], "path string, content string").withColumn("snapshot", F.lit("s1"))
    figures = M.file_metrics(files, NAMES)
    history = A.codebase(figures, ["snapshot"])
    S.write_history(history, str(tmp_path / "h"))
    back = S.read_history(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, back.select(*history.columns).collect())) == sorted(map(tuple, history.collect()))
    S.write_report(A.codebase(figures), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    want = sorted(map(tuple, figures.select("path", "metric", "key", "value").collect()))
    for _ in range(2):
        assert sorted(map(tuple, S.cached_metrics(files, str(tmp_path / "cache"), NAMES).collect())) == want
    assert spark.read.parquet(str(tmp_path / "cache")).select("digest").distinct().count() == 2


def test_stream_is_the_batch(spark, tmp_path):
    files = spark.createDataFrame([("a", "x_y = 1"), ("b", "p.q"), ("c", "z")], "path string, content string")
    files.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.running_codebase(stream, NAMES).writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    want = A.codebase(M.file_metrics(files, NAMES))
    assert sorted(map(tuple, A.finalize(spark.table("running")).collect())) == sorted(map(tuple, want.collect()))


def test_event_windows(spark):
    events = spark.sql("SELECT timestamp '2020-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp '2020-01-01 00:50:00', 'a', 3.0D UNION ALL SELECT timestamp '2020-01-01 01:00:00', 'a', 1.0D")
    assert sorted((r["n"], r["total"]) for r in streams.event_windows(events).collect()) == [(1, 1.0), (2, 5.0)]


def test_compression(spark):
    text = " ".join(str(k * 7919 % 1009) for k in range(400))
    files = spark.createDataFrame([("a", text), ("b", text), ("c", "0123456789" * 3)], "path string, content string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = {(r["path"], r["other"]): (r["ncd"], r["rank"]) for r in C.nearest(C.distances(pairs, files)).collect()}
    assert got["a", "b"][0] < 0.2 and got["a", "b"][1] == 1 and got["a", "c"][1] == 2 and got["c", "a"][1] == 1
    assert C.cross_file_density(files).first()["density"] > 1 and C.cross_file_density(files.limit(1)).first()["density"] == 0.0
