"""Structural lexing and blocks: an Arrow kernel, since brackets need a stack.

A file becomes structural tokens (strings, operators of several characters, line
ends, two-column indents), is cut to top-level blocks at triple quotes, after block
ends and blank lines, and before declarations, and each block to the bracketed and
colon-indented blocks inside it.  Blocks are rows; parents are row numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import r4
from .pairs import bucket


@dataclass(frozen=True)
class Grammar:
    """What cutting and signals need to know of a language; nothing, for unknown ones."""

    declarations: frozenset[str] = frozenset()
    ends: frozenset[str] = frozenset()
    branches: frozenset[str] = frozenset()
    access: frozenset[str] = frozenset()
    functions: frozenset[str] = frozenset()
    modules: frozenset[str] = frozenset()
    imports: frozenset[str] = frozenset()
    tests: frozenset[str] = frozenset()
    statements: frozenset[str] = frozenset()
    comments: frozenset[str] = frozenset()
    colon_indent: bool = False

    @classmethod
    def of(cls, **words: str | bool) -> Grammar:
        """From words between blanks."""
        return cls(**{k: v if isinstance(v, bool) else frozenset(v.split()) for k, v in words.items()})


#: Of some languages, the words that declare, end blocks, branch, give
#: access, and begin functions, modules, imports, tests and statements, and comment
#: prefixes.  Further languages are a parameter (`read_grammars`).
GRAMMARS = {
    "python": Grammar.of(declarations="def class async", branches="elif else except finally", functions="def async", modules="class", imports="import from", comments="#", colon_indent=True),
    "elixir": Grammar.of(
        declarations="def defp defmodule defmacro defmacrop defprotocol defimpl defdelegate defoverridable defguard", ends="end", branches="else rescue catch ensure cond when case",
        functions="def defp defmacro defmacrop defdelegate defguard", modules="defmodule defprotocol defimpl", imports="import require use alias", tests="test describe", comments="#",
    ),
    "ruby": Grammar.of(
        declarations="def class module", ends="end", branches="else elsif rescue ensure when", functions="def", modules="class module", imports="require require_relative include",
        tests="it describe context scenario feature given", comments="#",
    ),
    "javascript": Grammar.of(
        declarations="function class async", ends="}", branches="else catch finally case default", access="export static", functions="function async", modules="class", imports="import",
        tests="test it describe context scenario feature given", comments="//",
    ),
    "java": Grammar.of(
        declarations="class interface", ends="}", branches="else catch finally case default", access="public private protected static abstract final synchronized",
        modules="class interface enum", imports="import package", comments="//",
    ),
    "go": Grammar.of(declarations="func type struct interface", ends="}", branches="else case default", functions="func", imports="import package", comments="//"),
    "rust": Grammar.of(
        declarations="fn struct enum trait impl mod", ends="}", branches="else match", access="pub", functions="fn", modules="impl trait struct enum", imports="use extern", comments="//",
    ),
    "lua": Grammar.of(declarations="function local", ends="end", branches="else elseif", functions="function", imports="require", comments="--"),
    "sql": Grammar.of(statements="select insert update delete create drop alter truncate begin commit rollback call execute", comments="--"),
}


def read_grammars(path: str) -> dict[str, Grammar]:
    """More languages, from a JSON file on the driver: language -> field -> words."""
    with open(path, encoding="utf-8") as f:
        return GRAMMARS | {lang: Grammar.of(**words) for lang, words in json.load(f).items()}


#: Operators of more than one character, the longest first.
OPERATORS = "=== !== <=> ... == != <= >= |> <> <- -> => =~ !~ && || ?? ?. := :: .. -- ++ ** // += -= *= /= %=".split()
_TOKEN = re.compile(
    r"(?P<doc>\"\"\"|''')|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<num>\d+(?:\.\d+)?)|(?P<id>[a-zA-Z_][a-zA-Z0-9_]*)"
    r"|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + r")|(?P<blank>[\x00-\x20]+)|(?P<one>.)"
)
#: Expressions inside strings.
_INSIDE = re.compile(r"#\{([^}]*)\}|\$\{([^}]*)\}|\\\(([^)]*)\)")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_KIND = {"doc": "<DOC>", "str": "<STR>", "num": "<NUM>", "id": "<ID>"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BLANK = ("<NL>", "<WS>")


class Token(NamedTuple):
    kind: str
    content: str
    line: int
    col: int
    interpolations: tuple[str, ...] = ()  #: expressions inside a string, which its content leaves out


def lex(code: str) -> list[Token]:
    """Structural tokens; bytes beyond ASCII count as blanks."""
    if not code.isascii():
        code = _BEYOND.sub(lambda m: " " * len(m.group().encode("utf-8", "surrogatepass")), code)
    out: list[Token] = []
    lines = code.split("\n")
    for n, line in enumerate(lines, 1):
        body = line.lstrip(" \t")
        indent = len(line) - len(body)
        units = (indent + line[:indent].count("\t")) // 2
        out += [Token("<WS>", "  ", n, 2 * k) for k in range(units)]
        end = 2 * units if units else 0
        for m in _TOKEN.finditer(body):
            name = m.lastgroup
            if name == "blank":
                continue
            said, (a, b) = m.group(), m.span()
            inside = tuple(next(x for x in g if x is not None) for g in (i.groups() for i in _INSIDE.finditer(said))) if name == "str" else ()
            out.append(Token(_KIND.get(name, said), _INSIDE.sub("", said) if inside else said, n, indent + a, inside))
            end = indent + b
        if n < len(lines):
            out.append(Token("<NL>", "\n", n, end))
    return out


@dataclass
class Block:
    tokens: list[Token]
    children: list[Block]

    @property
    def first_line(self) -> int:
        return self.tokens[0].line

    @property
    def last_line(self) -> int:
        seen = [t.line for t in self.tokens if t.kind not in _BLANK]
        return seen[-1] if seen else self.tokens[-1].line

    def kinds(self) -> list[str]:
        """Kinds of the block's tokens, of its children's if it has some, without
        blanks at both ends."""
        own = [t.kind for t in self.tokens] if not self.children else [k for c in self.children for k in c.flat()]
        a, b = 0, len(own)
        while a < b and own[a] in _BLANK:
            a += 1
        while b > a and own[b - 1] in _BLANK:
            b -= 1
        return own[a:b]

    def flat(self) -> list[str]:
        return [t.kind for t in self.tokens] if not self.children else [k for c in self.children for k in c.flat()]


def _splits(tokens: list[Token], g: Grammar) -> list[int]:
    """Where top-level blocks begin."""
    triple, other, opened = [], [], None
    last, lines, depth, indent, start = None, 0, 0, 0, True
    for i, t in enumerate(tokens):
        if t.kind == "<DOC>":
            triple.append(i if opened is None else i + 1)
            opened = i if opened is None else None
        if t.kind == "<NL>":
            lines, indent, start = lines + 1, 0, True
            continue
        if t.kind == "<WS>":
            indent += start
            continue
        if last is not None and lines >= 2 and last in g.ends:
            other.append(i)
        if last is not None and start and indent == 0 and depth == 0 and t.content in g.declarations:
            other.append(i)
        if t.kind in _CLOSE:
            depth += 1
        elif t.kind in _CLOSE.values():
            depth = max(0, depth - 1)
        last, lines, start = t.content, 0, False
    inside = [(a + 1, b - 1) for a, b in zip(triple[::2], triple[1::2], strict=False)]
    return sorted({i for i in other if not any(a <= i <= b for a, b in inside)} | set(triple))


def _enclosed(tokens: list[Token], g: Grammar) -> list[tuple[int, int]]:
    """Outermost matched brackets, and what follows a colon on its line."""
    stack, out, begin = [], set(), 0
    for i, t in enumerate(tokens):
        if t.kind in _CLOSE:
            begin = i if not stack else begin
            stack.append(t.kind)
        elif stack and t.kind == _CLOSE[stack[-1]]:
            stack.pop()
            if not stack:
                out.add((begin, i))
    if g.colon_indent:
        for i, t in enumerate(tokens):
            if t.kind == ":":
                j = i + 1
                while j < len(tokens) and tokens[j].kind != "<NL>":
                    j += 1
                if j > i + 1:
                    out.add((i + 1, j - 1))
    return sorted(out)


def _visible(tokens: list[Token]) -> bool:
    return any(t.kind not in _BLANK for t in tokens)


def _inner(tokens: list[Token], g: Grammar) -> Block:
    search = tokens
    if len(tokens) > 1 and _CLOSE.get(tokens[0].kind) == tokens[-1].kind:
        search = tokens[1:-1]
    spans = [(a, b) for a, b in _enclosed(search, g) if (a, b) != (0, len(search) - 1)]
    parts = [search[a : b + 1] for a, b in spans]
    return Block(tokens, [_inner(p, g) for p in parts if _visible(p)])


def parse(code: str, language: str = "unknown", grammars: dict[str, Grammar] = GRAMMARS) -> list[Block]:
    """The top-level blocks of a text; slices that share a line are one."""
    g, tokens = grammars.get(language, Grammar()), lex(code)
    cuts = [0, *_splits(tokens, g), len(tokens)]
    slices = [s for a, b in zip(cuts[:-1], cuts[1:], strict=True) if _visible(s := tokens[a:b])]
    merged: list[list[Token]] = []
    for s in slices:
        first = next(t.line for t in s if t.kind not in _BLANK)
        if merged and first == next(t.line for t in reversed(merged[-1]) if t.kind not in _BLANK):
            merged[-1] = merged[-1] + s
        else:
            merged.append(s)
    return [_inner(s, g) for s in merged]


_SCHEMA = "path string, block long, parent long, depth long, start_line long, end_line long, n_tokens long, n_children long, kinds array<string>"


def blocks(files: DataFrame, language: str = "unknown") -> DataFrame:
    """Rows of the blocks of `files` (path, content), in pre-order; `language` is that
    of rows without a column of this name."""
    own = F.col("language") if "language" in files.columns else F.lit(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, code, lang in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "language")), strict=True):
                n = 0

                def visit(b: Block, parent: int, depth: int) -> None:
                    nonlocal n
                    n, me = n + 1, n + 1
                    rows.append((path, me, parent, depth, b.first_line, b.last_line, len(b.tokens), len(b.children), b.kinds()))
                    for c in b.children:
                        visit(c, me, depth + 1)

                for b in parse(code or "", lang or "unknown"):
                    visit(b, 0, 0)
            names = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
            types = [pa.string(), *[pa.int64()] * 7, pa.list_(pa.string())]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return files.select("path", F.coalesce("content", F.lit("")).alias("content"), own.alias("language")).mapInArrow(run, _SCHEMA)


def classes(blocks_: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, id (the first label), copies, kinds, n, n_children, lines of the top-level blocks
    with equal kinds, children and lines: one class each."""
    top = blocks_.where("parent = 0").withColumn("lines", F.size(F.filter("kinds", lambda k: k == "<NL>")) + 1)
    label = F.concat_ws(":", "path", F.lpad(F.col("start_line").cast("string"), 9, "0"))
    c = top.groupBy(*by, "kinds", "n_children", "lines").agg(F.min(label).alias("id"), F.count("*").alias("copies"))
    return c.withColumns({"n": F.size("kinds"), "spelled": F.array_join(F.transform("kinds", _letter), "")})


#: Kinds of more than one character, each with a letter of its own.
_LONG = {k: chr(0xE000 + i) for i, k in enumerate(["<ID>", "<NUM>", "<STR>", "<DOC>", "<NL>", "<WS>", *OPERATORS])}


def _letter(kind: Column) -> Column:
    """One character for each kind, so that the built-in distance counts kinds."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _LONG.items() for x in kv)), kind), kind)


def _compatible():
    """Children within one, lines within 30 % of each other."""
    return (F.abs(F.col("n_children_a") - F.col("n_children_b")) <= 1) & (F.abs(F.col("lines_a") - F.col("lines_b")) <= 0.3 * F.greatest("lines_a", "lines_b"))


def near_duplicates(c: DataFrame, by: list[str] = (), frequent: float = 1.0) -> DataFrame:
    """by, a, b, distance, bucket, pairs of the `classes` whose kinds are close; pairs is how
    many pairs of blocks that are.

    Equal kinds are bucket 0: a class with itself, and classes that differ in children or
    lines but are compatible.  Others are paired on shared pairs of kinds, if they share
    half as many as the first one is long, and compared by edit distance up to half the
    shorter length; only lengths that allow it meet.  Pairs of kinds in more than a share
    `frequent` of the classes pair nothing."""
    keep = ["id", "copies", "kinds", "spelled", "n", "n_children", "lines"]
    of = lambda s: c.select(*by, *(F.col(k).alias(f"{k}_{s}") for k in keep))
    one = c.where("copies > 1").select(*by, F.col("id").alias("a"), F.col("id").alias("b"), (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("pairs"))
    same = of("a").withColumn("kinds", F.col("kinds_a")).join(of("b").withColumn("kinds", F.col("kinds_b")), [*by, "kinds"]).where("id_a < id_b").where(_compatible())
    same = same.select(*by, F.col("id_a").alias("a"), F.col("id_b").alias("b"), (F.col("copies_a") * F.col("copies_b")).alias("pairs"))
    zero = one.unionByName(same).select(*by, "a", "b", F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("bucket"), "pairs")

    grams = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.xxhash64(F.slice("kinds", i, F.lit(2))))
    sides = c.where("n > 1").select(*by, "id", "n", F.explode(grams).alias("g"))
    if frequent < 1:
        most = max(2, round(c.count() * frequent))
        sides = sides.join(sides.groupBy("g").agg(F.countDistinct("id").alias("df")).where(F.col("df") > most), "g", "left_anti")
    counts = sides.groupBy(*by, "g", "id", "n").agg(F.count("*").alias("k")).withColumn("band", F.floor(F.ln("n") / F.ln(F.lit(1.5))))
    x, y = (counts.select(*by, "g", "band", F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("k").alias(f"k_{s}")) for s in "ab")
    x = x.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    shared = x.join(y, [*by, "g", "band"]).where("a < b").where(F.abs(F.col("n_a") - F.col("n_b")) <= F.round(F.least("n_a", "n_b") * 0.5))
    shared = shared.groupBy(*by, "a", "b", "n_a").agg(F.sum(F.col("k_a") * F.col("k_b")).alias("shared"))
    shared = shared.where(F.col("shared") >= F.greatest(F.lit(0), F.round(F.col("n_a") * 0.5) - 1)).select(*by, F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    d = shared.join(of("a"), [*by, "id_a"]).join(of("b"), [*by, "id_b"]).where(F.col("kinds_a") != F.col("kinds_b")).where(_compatible())
    least = F.least("n_a", "n_b")
    # the distance is left off beyond the bound (-1)
    d = d.withColumn("distance", F.expr("levenshtein(spelled_a, spelled_b, cast(round(least(n_a, n_b) * 0.5) as int))").cast("long")).where("distance >= 0")
    d = d.withColumn("bucket", bucket(F.col("distance"), least)).where(F.col("bucket").isNotNull())
    return zero.unionByName(d.select(*by, F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance", "bucket", (F.col("copies_a") * F.col("copies_b")).alias("pairs")))


def bucket_counts(pairs: DataFrame) -> DataFrame:
    """bucket, pairs: how many pairs of blocks are in each bucket."""
    return pairs.groupBy("bucket").agg(F.sum("pairs").alias("pairs"))


def duplicates_in_files(blocks_: DataFrame) -> DataFrame:
    """path, block_count, sub_block_count and near_dup_block_d0 .. d8: pairs inside a file."""
    found = near_duplicates(classes(blocks_, ["path"]), ["path"])
    counts = found.groupBy("path").agg(*(F.sum(F.when(F.col("bucket") == k, F.col("pairs"))).alias(f"near_dup_block_d{k}") for k in range(9)))
    return block_counts(blocks_).join(counts, "path", "left").fillna(0)


def block_counts(blocks_: DataFrame) -> DataFrame:
    """path, block_count, sub_block_count (0 under two blocks)."""
    top = blocks_.where("parent = 0").groupBy("path").agg(F.count("*").alias("block_count"), F.sum("n_children").alias("c"))
    return top.select("path", "block_count", F.when(F.col("block_count") < 2, 0).otherwise(F.col("c")).cast("long").alias("sub_block_count"))


def proportions(blocks_: DataFrame, limit: float = 0.6) -> DataFrame:
    """path, mean and greatest share of a block's lines in its parent's (the file's
    last line stands for the file), and how many reach the limit."""
    lines = F.col("end_line") - F.col("start_line") + 1
    b = blocks_.select("path", "block", "parent", "end_line", lines.alias("lines"))
    files = b.groupBy("path").agg(F.max("end_line").alias("lines")).select("path", F.lit(0).cast("long").alias("parent"), F.col("lines").alias("outer"))
    outer = b.select("path", F.col("block").alias("parent"), F.col("lines").alias("outer")).unionByName(files)
    d = b.join(outer, ["path", "parent"]).withColumn("r", F.col("lines") / F.col("outer"))
    return d.groupBy("path").agg(r4(F.avg("r")).alias("mean_ratio"), r4(F.max("r")).alias("max_ratio"), F.sum((F.col("r") >= limit).cast("long")).alias("violation_count"))
