"""Signals over structural tokens, and what they say of blocks.

A signal is a predicate over one token in its place: whether it is the first on its
line, how far the line is indented, how many brackets are open, and its neighbours.
Places are computed once for a file or block; every signal reads them, so that signals
are independent of each other and of their order.  Split signals say where a block
could begin, votes what a block is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .blocks import GRAMMARS, Block, Grammar, Token, _splits, lex, parse

_BLANK = ("<NL>", "<WS>")
_OPEN, _SHUT = ("(", "[", "{"), (")", "]", "}")

#: Kinds that make a comment a divider; words of configurations, control
#: flow, and attributes.
DIVIDERS = frozenset("-- - == === ~ * ** # // / =".split())
CONFIGURING = frozenset("config configure settings options defaults".split())
CONTROL = frozenset("if else elsif elif unless for while do case when cond switch loop until".split())
TYPESPECS = frozenset("spec type typep opaque callback macrocallback".split())
TYPES = frozenset("type typep opaque".split())
DOCUMENTING = frozenset("doc moduledoc".split())
#: What a block can be, the first of equal votes first.
KINDS = ("doc", "attribute", "function", "module", "import", "test")


@dataclass(frozen=True)
class Place:
    """A visible token where it stands."""

    index: int
    token: Token
    first: bool  #: on its line
    indent: int  #: blanks before the first token of the line
    depth: int  #: open brackets before it
    fresh: bool  #: no visible token before it
    before: Token | None  #: the token before, and after it, blank or not
    after: Token | None
    line: int  #: number of the line among those of the block
    dedented: bool  #: the last line with something visible was indented

    @property
    def bracket(self) -> bool:
        return self.token.kind in _OPEN or self.token.kind in _SHUT


def places(tokens: list[Token]) -> list[Place]:
    out: list[Place] = []
    first, indent, depth, line, last_indent = True, 0, 0, 0, 0
    for i, t in enumerate(tokens):
        if t.kind == "<NL>":
            last_indent = last_indent if first else indent
            first, indent, line = True, 0, line + 1
        elif t.kind == "<WS>":
            indent += first
        else:
            near = (tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None)
            out.append(Place(i, t, first, indent, depth, not out, *near, line, last_indent > 0))
            depth = depth + 1 if t.kind in _OPEN else max(0, depth - 1) if t.kind in _SHUT else depth
            first = False
    return out


def _kind(t: Token | None) -> str | None:
    return t.kind if t else None


# -- splits ---------------------------------------------------------------------

Splits = Callable[[list[Place], Grammar], Iterator[int]]


def access_modifier(ps: list[Place], g: Grammar) -> Iterator[int]:
    """A modifier that begins a line, outside brackets."""
    return (p.index for p in ps if p.first and p.depth == 0 and not p.fresh and not p.bracket and p.token.content in g.access)


def branch(ps: list[Place], g: Grammar) -> Iterator[int]:
    """A branching word outside brackets."""
    return (p.index for p in ps if p.depth == 0 and not p.fresh and not p.bracket and p.token.content in g.branches)


def comment_divider(ps: list[Place], g: Grammar) -> Iterator[int]:
    """A comment at the margin that goes on as a rule."""
    return (p.index for p in ps if p.first and p.indent == 0 and not p.fresh and p.token.kind in g.comments and _kind(p.after) in DIVIDERS)


def decorator(ps: list[Place], g: Grammar) -> Iterator[int]:
    """@ or #[ at the beginning of a line, outside brackets."""
    own = (p for p in ps if p.first and p.depth == 0 and not p.fresh)
    return (p.index for p in own if p.token.kind == "@" or p.token.kind == "#" and _kind(p.after) == "[")


def dedent(ps: list[Place], g: Grammar) -> Iterator[int]:
    """A line at the margin after an indented one."""
    return (p.index for p in ps if p.first and p.indent == 0 and p.dedented and not p.fresh)


def doc_comment(ps: list[Place], g: Grammar) -> Iterator[int]:
    """/// or /* at the beginning of a line."""
    own = (p for p in ps if p.first and not p.fresh)
    return (p.index for p in own if p.token.kind == "//" and _kind(p.after) == "/" or p.token.kind == "/" and _kind(p.after) in ("*", "**"))


def sql_block(ps: list[Place], g: Grammar) -> Iterator[int]:
    """A statement's first word at the beginning of a line, in any case."""
    return (p.index for p in ps if p.first and not p.fresh and p.token.kind == "<ID>" and p.token.content.lower() in g.statements)


#: A line as letters: i a name, f and a the words function and async, o and c other
#: brackets, > an arrow, x anything else.
_ASSIGNED = re.compile(r"([ifa][ifa.]*)=a*(f|\()")


def _letter(t: Token) -> str:
    if t.kind == "<ID>":
        return {"function": "f", "async": "a"}.get(t.content, "i")
    return {"=": "=", ".": ".", "(": "(", ")": ")", "=>": ">"}.get(t.kind, "o" if t.kind in ("[", "{", "]", "}") else "x")


def _arrow_follows(letters: str) -> bool:
    """Brackets only up to the one that closes the first, and then an arrow."""
    depth = 0
    for k, c in enumerate(letters):
        if c not in "()o":
            return False
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return letters[k + 1 : k + 2] == ">"
    return False


def assignment_function(ps: list[Place], g: Grammar) -> Iterator[int]:
    """A name at the margin that a function or an arrow without parameters is given to."""
    lines: dict[int, list[Place]] = {}
    for p in ps:
        lines.setdefault(p.line, []).append(p)
    for line in lines.values():
        p = line[0]
        if p.fresh or p.indent or p.depth:
            continue
        letters = "".join(_letter(x.token) for x in line)
        m = _ASSIGNED.match(letters)
        if m and (m[2] == "f" or _arrow_follows(letters[m.start(2) :])):
            yield line[max(k for k, c in enumerate(m[1]) if c != ".")].index


SPLITS: dict[str, Splits] = {
    "access_modifier_split": access_modifier, "assignment_function_split": assignment_function, "branch_split": branch,
    "comment_divider_split": comment_divider, "decorator_split": decorator, "dedent_split": dedent, "doc_comment_split": doc_comment,
    "sql_block_split": sql_block,
}


def emissions(tokens: list[Token], g: Grammar, signals: dict[str, Splits] = SPLITS) -> list[tuple[str, int]]:
    """(signal, token) of all signals, by signal and place.  A signal of one's own is a
    function of the places and the grammar."""
    ps = places(tokens)
    out = [(name, i) for name, signal in signals.items() for i in sorted(set(signal(ps, g)))]
    return out + [("block_split", i) for i in _splits(tokens, g)]


# -- votes ----------------------------------------------------------------------


def _word(ps: list[Place], words: frozenset[str], flat: bool) -> int:
    """3 if the first token at the margin that is one of the words begins the block, 1 if it
    comes later; with `flat`, outside brackets only, and brackets are no such tokens."""
    for p in ps:
        if p.indent == 0 and p.token.content in words and not (flat and (p.depth or p.bracket)):
            return 3 if p.fresh else 1
    return 0


def _named(ps: list[Place]) -> Iterator[tuple[Place, Place]]:
    """An @ on a line at the margin, and the token after it on the line."""
    return ((p, q) for p, q in zip(ps, ps[1:], strict=False) if p.token.kind == "@" and p.indent == 0 and p.line == q.line)


def vote_doc(ps: list[Place], g: Grammar) -> int:
    return 3 if any(p.token.kind == "<DOC>" for p in ps) else 0


def vote_attribute(ps: list[Place], g: Grammar) -> int:
    name = next((q.token.content for _, q in _named(ps) if q.token.kind == "<ID>"), None)
    return 0 if name is None or name in DOCUMENTING else 3 if name in TYPESPECS else 2


def vote_function(ps: list[Place], g: Grammar) -> int:
    return _word(ps, g.functions, True)


def vote_module(ps: list[Place], g: Grammar) -> int:
    return _word(ps, g.modules, True)


def vote_import(ps: list[Place], g: Grammar) -> int:
    return _word(ps, g.imports, False)


def vote_test(ps: list[Place], g: Grammar) -> int:
    return _word(ps, g.tests, False)


def vote_comment(ps: list[Place], g: Grammar) -> int:
    """Over 60 % of the lines begin as comments."""
    first = [p.token.content in g.comments for p in ps if p.first]
    return 2 if first and sum(first) / len(first) > 0.6 else 0


def vote_config(ps: list[Place], g: Grammar) -> int:
    return _word(ps, CONFIGURING, True)


def vote_data(ps: list[Place], g: Grammar) -> int:
    """Over 60 % of literals and names are literals, and no control flow."""
    literals = sum(p.token.kind in ("<STR>", "<NUM>") for p in ps)
    names = [p.token.content for p in ps if p.token.kind == "<ID>"]
    return 2 if literals + len(names) and not CONTROL.intersection(names) and literals / (literals + len(names)) > 0.6 else 0


def vote_type(ps: list[Place], g: Grammar) -> int:
    for p, q in _named(ps):
        if q.token.content in TYPES:
            return 3 if p.fresh else 1
    return 0


VOTES = {
    "doc": vote_doc, "attribute": vote_attribute, "function": vote_function, "module": vote_module, "import": vote_import, "test": vote_test,
    "comment": vote_comment, "config": vote_config, "data": vote_data, "type": vote_type,
}


def votes(tokens: list[Token], g: Grammar) -> dict[str, int]:
    ps = places(tokens)
    return {name: n for name, vote in VOTES.items() if (n := vote(ps, g))}


def classify(cast: dict[str, int]) -> str:
    """The kind with most votes among `KINDS`; code without any."""
    best = max(KINDS, key=lambda k: cast.get(k, 0))
    return best if cast.get(best) else "code"


def context(parent: list[Token], child: list[Token]) -> list[Token]:
    """What stands before a block on its first line, in the block around it."""
    if not child:
        return []
    at = (child[0].line, child[0].col)
    own = [t for t in parent if t.line == at[0] and (t.line, t.col) < at and t.kind != "<NL>"]
    while own and own[0].kind == "<WS>":
        own = own[1:]
    return own


def typespec(tokens: list[Token]) -> bool:
    """An attribute that states a type."""
    visible = [t for t in tokens if t.kind not in _BLANK]
    return len(visible) > 1 and visible[0].kind == "@" and visible[1].kind == "<ID>" and visible[1].content in TYPESPECS


def bound_names(tokens: list[Token]) -> set[str]:
    """Names that are given a value: before =, or before <- on its line."""
    out, line = set(), []
    for t, after in zip(tokens, [*tokens[1:], None], strict=True):
        if t.kind == "<ID>":
            line.append(t.content.lower())
            if _kind(after) == "=":
                out.add(t.content.lower())
        elif t.kind == "<-":
            out.update(line)
            line = []
        elif t.kind == "<NL>":
            line = []
    return out


# -- tables ---------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch], schema: str, of) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = [types[f.split(" ")[1]] for f in schema.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):  # a file at a time
            path, code, lang = (batch.column(c)[k].as_py() for c in ("path", "content", "language"))
            rows = [(path, *r) for r in of(code or "", lang or "unknown")]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _over(files: DataFrame, language: str, schema: str, of) -> DataFrame:
    own = F.col("language") if "language" in files.columns else F.lit(language)
    rows = files.select("path", "content", own.alias("language"))
    return rows.mapInArrow(lambda b: _rows(b, schema, of), schema)


def signals(files: DataFrame, language: str = "unknown", grammars: dict[str, Grammar] = GRAMMARS) -> DataFrame:
    """path, signal, token, line of all split signals of `files` (path, content[, language])."""

    def of(code: str, lang: str) -> list[tuple]:
        tokens = lex(code)
        found = emissions(tokens, grammars.get(lang, Grammar()))
        return [(name, i, tokens[i].line if i < len(tokens) else tokens[-1].line) for name, i in found]

    return _over(files, language, "path string, signal string, token long, line long", of)


_NODE = (
    "path string, block long, parent long, depth long, start_line long, end_line long, start_col long, n_tokens long, n_chars long, kind string, "
    "typespec boolean, votes string, trailing long, last_line long, last_end long, bound array<string>"
)


def nodes(files: DataFrame, language: str = "unknown", grammars: dict[str, Grammar] = GRAMMARS, cut_as: str | None = None) -> DataFrame:
    """The blocks of `files` in pre-order, classified by votes (with what stands before a
    nested block on its line).  `cut_as` is the language that blocks are cut by, if not
    the file's own.  trailing: line ends at the block's end; bound: names given a value."""

    def of(code: str, lang: str) -> list[tuple]:
        g, out = grammars.get(lang, Grammar()), []

        def visit(b: Block, parent: int, depth: int, around: list[Token] | None) -> None:
            me = len(out) + 1
            cast = votes((context(around, b.tokens) if around else []) + b.tokens, g)
            ends = 0
            for t in reversed(b.tokens):
                if t.kind not in _BLANK:
                    break
                ends += t.kind == "<NL>"
            first, last = b.tokens[0], b.tokens[-1]
            said = " ".join(f"{k}:{n}" for k, n in sorted(cast.items()))
            chars = sum(len(t.content) for t in b.tokens)
            out.append((me, parent, depth, b.first_line, b.last_line, first.col, len(b.tokens), chars, classify(cast), typespec(b.tokens), said, ends, last.line, last.col + len(last.content), sorted(bound_names(b.tokens))))
            for c in b.children:
                visit(c, me, depth + 1, b.tokens)

        for b in parse(code, cut_as or lang, grammars):
            visit(b, 0, 0, None)
        return out

    return _over(files, language, _NODE, of)


def compounds(nodes_: DataFrame) -> DataFrame:
    """path, compound, docs, typespecs, code, first and last line: top-level blocks that
    belong together.  A doc or attribute after code begins a new one, and so does what
    follows three line ends or more.  A flag for each block, summed in order."""
    order = W.partitionBy("path").orderBy("block")
    top = nodes_.where("parent = 0").withColumn("about", F.col("kind").isin("doc", "attribute"))
    begins = (F.col("about") & ~F.lag("about").over(order)) | (F.lag("trailing").over(order) >= 3)
    top = top.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int"))
    top = top.withColumn("compound", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)) + 1)
    count = lambda c: F.sum(c.cast("long"))
    return top.groupBy("path", "compound").agg(
        count(F.col("kind") == "doc").alias("docs"), count(F.col("kind") == "attribute").alias("typespecs"), count(~F.col("about")).alias("code"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
    )
