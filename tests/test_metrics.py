"""Figures of small texts with known values."""

import pytest

from gaugeworks.functions import text as X
from gaugeworks.operators import metrics as M

TEXTS = {
    "empty": "",
    "sum": "1 + 2",
    "loop": "x = x + 1\n" * 5,
    "partial": "q b c d e f g h q q q q",
    "alpha": "alpha",
    "xxy": "x x x x x y",
    "eight": "a b c d e f g h",
    "pairs": "a a b b",
    "nine": "\n".join("a b c" for _ in range(9)),
    "zones": "\n".join(["a " * 10] + ["b " * 3] * 3 + ["c"] * 9),
    "code": "def f(a, (b, c), d):\n    return 1\n    x = 2\n\npublic int g() {\n  foo(7)\n}\n",
    "twenty": " ".join(f"{c}{c}" for c in "abcdefghijklmnopqrst"),
}


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame(list(TEXTS.items()), "path string, content string")
    lexed = X.lexed(files).cache()
    cache = {}

    def get(metric, path):
        if metric not in cache:
            cache[metric] = {r["path"]: r for r in M.METRICS[metric](lexed).collect()}
        return cache[metric][path]

    return get


def test_mtld(rows):
    assert tuple(rows("mtld", "empty"))[1:] == (0, 0, 0)
    assert tuple(rows("mtld", "sum"))[1:] == (0, 0, 0)
    assert tuple(rows("mtld", "twenty"))[1:] == (20, 20, 20)
    assert tuple(rows("mtld", "loop"))[1:] == (2, 2, 2)
    assert tuple(rows("mtld", "partial"))[1:] == (12, 6, 9)


def test_concentration(rows):
    assert tuple(rows("lexical_concentration", "alpha"))[1:] == (0, 0, 1)
    assert tuple(rows("lexical_concentration", "xxy"))[1:] == (5555.5556, 0.6667, 6)


def test_renyi(rows):
    r = rows("renyi_entropy", "eight")
    assert (r["renyi_0"], r["hill_1"], r["hill_2"]) == (3.0, 8.0, 8.0)
    assert r["renyi_0"] >= r["renyi_1"] >= r["renyi_2"] >= r["renyi_inf"]


def test_bradford(rows):
    assert tuple(rows("bradford", "nine"))[1:] == (1, 1, 1)
    assert tuple(rows("bradford", "zones"))[1:] == (4, 2, 0.5)


def test_brevity_and_conditional(rows):
    assert tuple(rows("brevity", "pairs"))[1:3] == (0, 0)
    assert tuple(rows("conditional_entropy", "empty"))[1:] == (0, 1, 0)


def test_functions(rows):
    r = rows("function_metrics", "code")
    assert (r["function_count"], r["max_function_lines"], r["max_param_count"]) == (2, 4, 2)
    assert rows("branching", "code")["max_nesting_depth"] == 2


def test_unreachable(rows):
    r = rows("unreachable_code", "code")
    assert (r["terminal_statement_count"], r["unreachable_line_count"]) == (1, 1)


def test_all_metrics_take_empty_text(rows):
    for name in M.METRICS:
        assert rows(name, "empty")["path"] == "empty"


def test_long_form_is_the_metrics(spark):
    files = spark.createDataFrame(list(TEXTS.items()), "path string, content string")
    got = {(r["path"], r["metric"], r["key"]): r["value"] for r in M.file_metrics(files, ["zipf", "ngram"]).collect()}
    want = {}
    for name in ("zipf", "ngram"):
        for r in M.METRICS[name](X.lexed(files)).collect():
            want |= {(r["path"], name, k): v for k, v in r.asDict().items() if k != "path"}
    assert got == want
