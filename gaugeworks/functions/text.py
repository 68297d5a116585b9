"""Lexing as Column expressions: one row per file, arrays of tokens, words, lines.

Everything here stays in the row of its file, so a file's metrics need no shuffle.
Character classes are spelled out, because the shorthands differ between engines:
ASCII where the semantics are byte-wise, letters and digits of all scripts in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab

#: The patterns of the metric lexer.
TOKEN = r"[a-zA-Z_][\p{L}\p{N}_]*|[0-9]+(?:\.[0-9]+)?|[^\s\p{Z}]"
RUN = r"[\p{L}\p{N}_]+"
VISIBLE = r"[^\s\p{Z}]"
#: Word edges on ASCII word characters.
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def found(text: Column, pattern: str) -> Column:
    """All matches."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(text: Column, pattern: str) -> Column:
    """Number of matches, as a long."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def lines(content: Column) -> Column:
    """Lines at line feeds, without one empty line at the end."""
    parts = F.split(content, "\n", -1)
    return F.when(content.endswith("\n") | (content == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def visible(line: Column) -> Column:
    return line.rlike(VISIBLE)


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def kind(token: Column) -> Column:
    return F.when(token.rlike("^[a-zA-Z_]"), "<ID>").when(token.rlike("^[0-9]"), "<NUM>").otherwise("<PUNCT>")


def casing(word: Column) -> Column:
    """Style of an identifier; the first that fits."""
    return (
        F.when(word.rlike("^[A-Z][a-zA-Z0-9]*$"), "pascal_case")
        .when(word.rlike("^[a-z][a-z0-9]*([A-Z][a-zA-Z0-9]*)+$"), "camel_case")
        .when(word.rlike("^[a-z]+(_[a-z0-9]+)*$"), "snake_case")
        .when(word.rlike("^[A-Z]+(_[A-Z0-9]+)*$"), "macro_case")
        .when(word.rlike("^[a-z]+(-[a-z0-9]+)*$"), "kebab_case")
        .otherwise("other")
    )


def sub_words(word: Column) -> Column:
    """Parts of a word at underscores and before capitals after small letters."""
    return F.filter(F.split(F.regexp_replace(word, "([a-z])([A-Z])", "$1_$2"), "_"), lambda x: x != "")


def kgrams(tokens: Column, k: int) -> Column:
    """Runs of k tokens, joined by blanks; the whole, if it is shorter."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(tokens, " "))).otherwise(many)


def kgram_hashes(tokens: Column, k: int) -> Column:
    """Hashes (64 bits) of the runs of k tokens; of the whole, if it is shorter."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(k))))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(tokens))).otherwise(many)


def language(path: Column, extensions: dict[str, str] | None = None) -> Column:
    """Language by extension, case-sensitive, or by file name if there is none."""
    table = F.create_map(*(F.lit(x) for kv in (extensions or vocab.language_of()).items() for x in kv))
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"[^.]\.([^.]+)$", 1)
    return F.coalesce(F.element_at(table, F.when(ext == "", base).otherwise(ext)), F.lit("unknown"))


def strip_comments(content: Column, prefixes: list[str], blocks: list[tuple[str, str]] = ()) -> Column:
    """Block comments go, their line feeds stay; then line comments go."""
    for begin, end in blocks:
        pattern = _quoted(begin) + r"(?s:.*?)" + _quoted(end)
        parts, inside = F.split(content, pattern), found(content, pattern)
        kept = F.concat(F.transform(inside, lambda x: F.regexp_replace(x, r"[^\n]+", "")), F.array(F.lit("")))
        content = F.array_join(F.zip_with(parts, kept, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    for prefix in prefixes:
        content = F.regexp_replace(content, f"(?m){_quoted(prefix)}.*$", "")
    return content


def _quoted(x: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in x)


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a glob: ** any path, * any name, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        out += {"*": "[^/]*", "?": "[^/]", ".": r"\."}.get(c, c)
        i += 1
    return f"^{out}$"


def ignored(path: Column, globs: list[str]) -> Column:
    """A glob fits the path."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def corpus(docs: DataFrame) -> DataFrame:
    """path and content of a table of documents."""
    path = F.concat(F.coalesce(F.col("source"), F.lit("-")), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("content"), F.col("source").alias("snapshot"))


def lexed(files: DataFrame, keywords: tuple[str, ...] = vocab.KEYWORDS) -> DataFrame:
    """`files` (path, content) with tokens, words, ids, lines and nb, the lines with
    something visible.  Columns that a query doesn't use are never computed."""
    out = files.withColumns(
        {
            "tokens": found(F.col("content"), TOKEN),
            "words": F.filter(found(F.col("content"), RUN), lambda w: w.rlike("^[a-zA-Z_]")),
            "lines": lines(F.col("content")),
        }
    )
    out = out.withColumns({"ids": F.filter("words", lambda w: ~w.isin(*keywords)), "nb": F.filter("lines", visible)})
    return out if keywords == vocab.KEYWORDS else out.withMetadata("ids", {"keywords": list(keywords)})  # for what lexes anew
