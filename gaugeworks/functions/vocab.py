"""Language dimensions: extensions, comment prefixes, keywords.

The defaults are fixed values; every operator takes others as a parameter.
"""

from __future__ import annotations

#: File extensions (or whole file names) of each language.
EXTENSIONS = {
    "cpp": "c cpp cc cxx hpp h hh", "go": "go", "haskell": "hs lhs", "ocaml": "ml mli", "rust": "rs", "swift": "swift",
    "zig": "zig", "julia": "jl", "lua": "lua", "perl": "pl pm t", "php": "php phtml php3 php4 php5 php7 php8",
    "python": "py pyi", "r": "r R Rmd rmd", "ruby": "rb rake gemspec", "shell": "sh bash zsh fish",
    "clojure": "clj cljs cljc edn", "csharp": "cs csx", "dart": "dart", "elixir": "ex exs", "erlang": "erl hrl",
    "fsharp": "fs fsi fsx", "java": "java", "kotlin": "kt kts", "scala": "scala sc",
    "javascript": "js mjs cjs jsx vue svelte", "typescript": "ts tsx", "dockerfile": "Dockerfile",
    "makefile": "Makefile GNUmakefile mk", "terraform": "tf tfvars", "graphql": "graphql gql", "json": "json jsonc",
    "sql": "sql", "toml": "toml", "yaml": "yml yaml", "css": "css scss sass less",
    "html": "html htm heex eex leex erb htmlbars hbs mustache jinja jinja2 njk liquid", "markdown": "md mdx",
    "xml": "xml svg xsl xslt xsd wsdl plist",
}

#: Line-comment prefixes of each language that has some.
COMMENTS = {
    "//": "cpp go rust swift zig php csharp dart fsharp java kotlin scala javascript typescript terraform",
    "#": "julia perl php python r ruby shell elixir dockerfile makefile terraform graphql toml yaml",
    "--": "haskell lua sql",
    ";": "clojure",
    "%": "erlang",
}

#: Directories that a scan skips, besides those whose names begin with a dot.
SKIPPED = ("node_modules", "__pycache__", "_build", "dist", "build", "vendor", "venv", "target", "deps", "coverage")

#: Reserved words that are common to many languages; a project's own
#: list is given as `keywords`.
KEYWORDS = tuple(
    """
    if else elif elsif unless for foreach while until do return break continue import from require use using package
    class def defp defmodule function func fun fn module interface struct enum trait impl lambda yield pass raise throw
    throws try except catch rescue finally ensure with as begin end and or not in is typeof instanceof new delete async
    await defer go select case when switch match default var let const val public private protected internal static
    final abstract override extends implements this self super void int long float double bool boolean char true false
    null nil None True False export type where then fi done esac local print global
    """.split()
)

#: Words that count as branching.
BRANCHING = tuple(
    """
    if elif elsif elseif else unless for foreach while until loop repeat case when switch cond match select
    try catch rescue except finally ensure after begin with guard fallthrough then fi esac
    """.split()
)

#: Keyword operators of the operator and operand counts.
OPERATOR_WORDS = tuple(
    """
    if else elif elsif unless for foreach while until do fallthrough return break continue import from require use
    using alias namespace package class def defp defmodule defmacro defmacrop defprotocol defimpl function func fun fn
    module protocol extension lambda yield pass raise throws throw try except rescue finally ensure after with as begin
    end and or not in is typeof instanceof sizeof new delete async await suspend defer go select range case when switch
    cond match impl trait pub mod dyn unsafe loop where move echo print guard then fi done esac local export declare
    actor init object companion
    """.split()
)

#: Words that begin a function definition, for calls and responses.
FUNCTION_WORDS = tuple("def defp defmacro defmacrop defguard defdelegate function func fun fn sub proc method".split())


def language_of() -> dict[str, str]:
    """Extension or file name -> language."""
    return {e: lang for lang, exts in EXTENSIONS.items() for e in exts.split()}


def prefixes_of(language: str) -> list[str]:
    return [p for p, langs in COMMENTS.items() if language in langs.split()]
