"""Structural tokens, blocks and near-duplicate blocks."""

from gaugeworks.operators import blocks as B
from gaugeworks.operators import signals as S


def kinds(code):
    return [t.kind for t in B.lex(code)]


def test_lexing():
    assert kinds('  x += "a b" # é') == ["<WS>", "<ID>", "+=", "<STR>", "#"]
    assert kinds("a\n\tb === 1.5...") == ["<ID>", "<NL>", "<WS>", "<ID>", "===", "<NUM>", "..."]
    assert kinds('"""doc"""') == ["<DOC>", "<ID>", "<DOC>"]
    assert kinds("") == []
    assert [(t.line, t.col) for t in B.lex("a b\n  c")] == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 2)]


def test_blocks_by_language():
    code = "def f(a, b):\n    return [a]\n\n\ndef g():\n    pass\n"
    assert [(b.first_line, b.last_line) for b in B.parse(code, "python")] == [(1, 2), (5, 6)]
    assert len(B.parse(code)) == 1
    ruby = "x = 1\nend\n\ny = 2"
    assert len(B.parse(ruby, "ruby")) == 2 and len(B.parse(ruby)) == 1
    assert [len(b.children) for b in B.parse("f(a, (b)) + [c]")] == [2]
    assert len(B.parse('"""a\n\n\nb"""\ncode')) == 2
    assert B.parse("") == B.parse(" \n\n ") == [] and len(B.parse("((( ]")) == 1


def test_rows_and_proportions(spark):
    files = spark.createDataFrame([("p", "f(a, [b])\n"), ("q", None), ("r", "a\nb\n(c\nd)\n")], "path string, content string")
    rows = B.blocks(files)
    got = {(r["path"], r["block"], r["parent"], r["depth"], r["n_children"]) for r in rows.collect()}
    assert got == {("p", 1, 0, 0, 1), ("p", 2, 1, 1, 1), ("p", 3, 2, 2, 0), ("r", 1, 0, 0, 1), ("r", 2, 1, 1, 0)}
    assert {tuple(r) for r in B.proportions(rows).where("path = 'r'").collect()} == {("r", 0.75, 1.0, 1)}
    assert {tuple(r) for r in B.block_counts(rows).collect()} == {("p", 1, 0), ("r", 1, 0)}


def test_near_duplicates(spark):
    ten = "a = 1 + b ; c = 2 -"
    files = spark.createDataFrame([("x", ten), ("y", ten.replace("1", "z")), ("z", "( ) { } [ ] ( ) { }"), ("w", "q = 9 + r ; s = 7 -")], "path string, content string")
    found = B.near_duplicates(B.classes(B.blocks(files)))
    got = {(r["a"][:1], r["b"][:1]): (r["distance"], r["bucket"], r["pairs"]) for r in found.collect()}
    assert got == {("w", "w"): (0, 0, 1), ("w", "y"): (1, 2, 2)}
    assert {tuple(r) for r in B.bucket_counts(found).collect()} == {(0, 1), (2, 2)}
    three = spark.createDataFrame([("p", '"""\na b\n"""\nx y\n"""\nc d\n"""\nz w')], "path string, content string")
    row = B.duplicates_in_files(B.blocks(three)).first()
    assert row["block_count"] == 4 and row["near_dup_block_d0"] == 2


def brute_pairs(rows):
    """All pairs of blocks (kinds, children) of one line, as the definition says."""
    from itertools import combinations

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    out = {}
    for (a, ca), (b, cb) in combinations(rows, 2):
        if abs(ca - cb) > 1:
            continue
        d = distance(a, b)
        if a != b:
            grams = lambda k: [tuple(k[i : i + 2]) for i in range(len(k) - 1)]
            shared = sum(x == y for x in grams(a) for y in grams(b))
            if shared < max(0, int(len(a) * 0.5 + 0.5) - 1) or d > int(min(len(a), len(b)) * 0.5 + 0.5):
                continue
        share = d / min(len(a), len(b)) if min(len(a), len(b)) else 1
        k = 0 if d == 0 else next((k for k, top in enumerate((0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5), 1) if share <= top), None)
        if k is not None:
            out[k] = out.get(k, 0) + 1
    return out


def test_near_duplicates_are_those_of_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = sorted(([rng.choice("abcd") for _ in range(rng.randrange(6, 11))], 0) for _ in range(60))
    table = spark.createDataFrame([(f"{k:03d}", 0, 1, 0, r[0]) for k, r in enumerate(rows)], "path string, parent long, start_line long, n_children long, kinds array<string>")
    got = dict(map(tuple, B.bucket_counts(B.near_duplicates(B.classes(table))).collect()))
    assert got == brute_pairs(rows)


def test_cross_file_density(spark):
    import random
    import zlib

    from gaugeworks.operators.compress import cross_file_density

    rng = random.Random(4)
    texts = [("".join(rng.choices("abcdef \n", k=rng.randrange(10, 3000)))) for _ in range(60)] + ["same text " * 50] * 5
    files = spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "path string, content string")
    want = sum(len(zlib.compress(t.encode())) for t in texts) / len(zlib.compress("\n".join(texts).encode()))
    assert abs(cross_file_density(files).first()["density"] - want) < 0.01 * want
    assert abs(cross_file_density(files, chunk=20_000).first()["density"] - want) < 0.02 * want
    assert cross_file_density(files.limit(1)).first()["density"] == 0


# -- signals --------------------------------------------------------------------


def split(code, language):
    return {(n, i) for n, i in S.emissions(B.lex(code), B.GRAMMARS.get(language, B.Grammar())) if n != "block_split"}


def test_split_signals():
    assert split("a\nx = function() {}\ny = () => 1\nz = (a) => 1\n  w = () => 2\nm.n = async () => 3\n", "javascript") == {
        ("assignment_function_split", 2), ("assignment_function_split", 10), ("assignment_function_split", 35), ("dedent_split", 33)}
    assert ("decorator_split", 2) in split("x\n@foo\ndef f", "python") and ("decorator_split", 2) in split("x\n#[a]\nfn b", "rust")
    assert split("x\n  @foo", "python") == {("decorator_split", 3)} and split("@foo", "python") == set()
    assert split("x\npub fn a\n(\npub b\n)", "rust") == {("access_modifier_split", 2)}
    assert split("x\nelse y", "go") == {("branch_split", 2)} and split("f(x else)", "go") == set()
    assert split("x\n# ---", "python") == {("comment_divider_split", 2)} and split("x\n # ---", "python") == {("comment_divider_split", 2)}
    assert ("doc_comment_split", 2) in split("x\n/// a", "go") and split("x\n/* a", "unknown") == {("doc_comment_split", 2)}
    assert split("x\nSelect a", "sql") == {("sql_block_split", 2)}
    assert split("a\n  b\n\nc", "unknown") == {("dedent_split", 6)}


def test_votes():
    elixir = B.GRAMMARS["elixir"]
    kind = lambda c: S.classify(S.votes(B.lex(c), elixir))
    cases = {"@spec foo": "attribute", "@doc 1": "code", "@foo 1": "attribute", "def f do end": "function", "alias Foo": "import", "defmodule X do\n def a": "module", 'test "x" do': "test", "x = 1": "code", '"""a"""': "doc", "x = 1\ndef f": "function"}
    assert {c: kind(c) for c in cases} == cases
    assert S.votes(B.lex("# a\n# b\nx"), elixir)["comment"] == 2 and S.votes(B.lex("config :a"), elixir)["config"] == 3
    assert S.votes(B.lex('["a", 1, 2]'), elixir) == {"data": 2} and S.votes(B.lex("@type t"), elixir)["type"] == 3
    outer = B.lex("alias Foo.{Bar, Baz}")
    inner = B.parse("alias Foo.{Bar, Baz}")[0].children[0]
    assert S.classify(S.votes(S.context(outer, inner.tokens) + inner.tokens, elixir)) == "import"
    assert S.bound_names(B.lex("A = 1\n{b, c} <- d\nE==2")) == {"a", "b", "c"}
    assert B.lex('x = "a #{b} c"')[2].interpolations == ("b",) and B.lex('x = "a #{b} c"')[2].content == '"a  c"'


def test_nodes_and_compounds(spark):
    code = "@doc 1\n@spec f\ndef f do\n  1\nend\n\n@spec g\ndef g do\nend\n\n\n\ndef h do\nend\n"
    files = spark.createDataFrame([("a.ex", code, "elixir"), ("b", None, None)], "path string, content string, language string")
    rows = S.nodes(files)
    top = [r["kind"] for r in rows.where("parent = 0").orderBy("block").collect()]
    assert top[0] in ("attribute", "code", "function") and set(top) <= {*S.KINDS, "code"} and len(top) >= 3
    groups = S.compounds(rows).orderBy("compound").collect()
    assert len(groups) >= 2 and sum(r["code"] + r["docs"] + r["typespecs"] for r in groups) == len(top)
    assert S.signals(files).where("path = 'a.ex'").count() > 0
