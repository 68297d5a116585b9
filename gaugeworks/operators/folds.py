"""Figures of files: one Arrow kernel for all of them.

The texts of a slice of files become one array of characters, in which tokens, words,
lines and brackets are found by arithmetic over character classes, without a pattern
that scans.  Tokens are numbered by a dictionary for each slice, and everything else is
arithmetic over numbers of all files of the slice at once: counts of tokens and of pairs
and triples of them, sums and least-squares lines for each file.  Only deflate, the
diversity runs, quotes, numbers, and lines that define or end something go one by one.
Every step is linear in the text.  Figures are rounded as `functions.stats.r4` does.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import text as X
from ..functions import vocab

#: Bytes of content that are worked on at once; a longer file is a slice of its own.
SLICE = 1 << 19

#: Operators and operands of the operator and operand counts.
MARKS = r"==|!=|<=|>=|\+=|-=|\*=|/=|//=|%=|&=|\|=|\^=|\*\*=|<<=|>>=|->|:=|\.\.\.|[+\-*/%&|^~<>=!(){}\[\];:,.]"
OPERATOR = X.EDGE_L + "(?:" + "|".join(vocab.OPERATOR_WORDS) + ")" + X.EDGE_R + "|" + MARKS
OPERAND = X.EDGE_L + r"(?:[a-zA-Z_][A-Za-z0-9_]*|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?)" + X.EDGE_R + "|\"[^\"]*\"|'[^']*'"

STYLES = ("pascal_case", "camel_case", "snake_case", "macro_case", "kebab_case", "other")

#: Lines that define a function.
DEFINITION = (
    r"^\s*(?:async\s+|pub\s+(?:async\s+)?)?(?:def|defp|defmacro|defmacrop|defguard|defdelegate|function|func|fun|fn)" + X.EDGE_R
)
METHOD = r"^\s*(?:public|private|protected|internal)(?:\s+(?:static|virtual|override|abstract|async|sealed|new|final|synchronized|native))*\s+\S+\s+[A-Za-z0-9_]+\s*\("

#: A number.
NUMBER = X.EDGE_L + r"[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?" + X.EDGE_R
#: Numbers that are not magic.
PLAIN_NUMBERS = ("0", "1", "2", "0.0", "1.0", "0.5")

#: Statements that end a scope, and lines that end or go on with one.
TERMINAL = r"^\s*(return|raise|throw|break|continue)" + X.EDGE_R
INLINE = X.EDGE_L + "(return|raise|throw)" + X.EDGE_R
BOUNDARY = r"^\s*([)\]}]|(end|else|elsif|when|case|catch|rescue|finally)" + X.EDGE_R + r"|default\s*:)"

#: Figures of each metric; # marks whole numbers, ~ what is not rounded here, ? truth
#: values, $ strings.
FIGURES = {
    "entropy": ("char_entropy", "char_max_entropy", "char_normalized", "token_entropy", "token_max_entropy", "token_normalized", "vocab_size#", "total_tokens#"),
    "compression": ("raw_bytes#", "zlib_bytes#", "zlib_ratio", "redundancy", "unique_line_ratio"),
    "unique_lines": ("raw_bytes#", "unique_line_ratio"),
    "zipf": ("exponent", "r_squared", "vocab_size#", "total_tokens#"),
    "heaps": ("k", "beta", "r_squared"),
    "vocabulary": ("raw_ttr", "mattr", "unique_identifiers#", "total_identifiers#", "vocabulary$"),
    "mtld": ("mtld_forward", "mtld_backward", "mtld"),
    "lexical_concentration": ("yule_k", "simpson_d", "total_tokens#"),
    "renyi_entropy": ("renyi_0", "renyi_1", "renyi_2", "renyi_inf", "hill_1", "hill_2", "spectrum_slope"),
    "ngram": tuple(f"{n}_{k}" for n in ("bigram", "trigram") for k in ("total#", "unique#", "repetition_rate", "hapax_fraction", "repeated_unique#")),
    "conditional_entropy": ("conditional_entropy", "perplexity", "normalized_conditional_entropy"),
    "halstead": (
        "n1_unique_operators#", "n2_unique_operands#", "N1_total_operators#", "N2_total_operands#", "vocabulary#", "length#", "volume", "difficulty", "effort",
        "estimated_bugs", "time_to_implement_seconds",
    ),
    "readability": ("avg_tokens_per_line", "avg_line_length", "avg_sub_words_per_id", "flesch_adapted", "fog_adapted", "total_lines#"),
    "lexical_density": ("lexical_density", "content_tokens#", "function_tokens#"),
    "casing_entropy": ("entropy", "screaming_snake_density", *(f"{s}_count#" for s in STYLES)),
    "identifier_length_variance": ("mean", "variance", "std_dev", "max#"),
    "indentation": ("mean_depth", "variance", "max_depth#", "uses_tabs?", "blank_line_ratio"),
    "branching": ("branching_density", "branch_count#", "non_blank_count#", "max_nesting_depth#"),
    "function_metrics": ("function_count#", "avg_function_lines", "max_function_lines#", "avg_param_count", "max_param_count#"),
    "magic_number_density": ("density", "magic_number_count#", "string_literal_ratio"),
    "symbol_density": ("density", "symbol_count#", "distinct_symbol_types#"),
    "vowel_density": ("density", "vowel_count#", "total_chars#"),
    "brevity": ("correlation", "slope", "sample_size#"),
    "punctuation_density": (
        "question_mark_density~", "exclamation_density~", "dot_count#", "id_nonalpha_suffix_density", "bracket_nonalpha_prefix_count#", "bracket_nonalpha_suffix_count#",
        "bracket_number_pair_count#", "arrow_density", "colon_suffix_density",
    ),
    "comment_structure": ("comment_line_ratio", "comment_line_count#", "todo_fixme_count#"),
    "separator_counts": ("underscore_count#", "hyphen_count#", "slash_count#", "dot_count#"),
    "line_patterns": ("blank_line_ratio", "unique_line_ratio", "max_nesting_depth#", "string_literal_ratio"),
    "unreachable_code": ("unreachable_after_terminal_ratio", "terminal_statement_count#", "unreachable_line_count#"),
    "bradford": ("k1", "k2", "k_ratio"),
    "rfc": ("rfc_count#", "rfc_density", "function_def_count#", "distinct_call_count#"),
}

#: Bits of character classes: ASCII letters and underscore, ASCII digits, letters and
#: digits of all scripts and underscore, white space of all scripts, ASCII white space,
#: characters of operators, ASCII vowels.
ALPHA, DIGIT, RUN, SPACE, BLANK, MARK, VOWEL = 1, 2, 4, 8, 16, 32, 64
WORD = ALPHA | DIGIT


@cache
def _classes(size: int) -> np.ndarray:
    """The classes of the first characters, as many as `size`."""
    kinds = [unicodedata.category(chr(k))[0] for k in range(size)]
    out = np.array([RUN if k in "LN" else SPACE if k == "Z" else 0 for k in kinds], np.uint8)
    for chars, bits in (("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", ALPHA), ("_", ALPHA | RUN), ("0123456789", DIGIT), (" \t\n\x0b\f\r", SPACE | BLANK), ("+-*/%&|^~<>=!(){}[];:,.", MARK), ("aeiouyAEIOUY", VOWEL)):
        out[[ord(c) for c in chars]] |= bits
    return out


def _share(a: np.ndarray, b: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """a / b, `empty` where b is 0."""
    return np.where(b != 0, a / np.where(b != 0, b, 1), empty)


def rounded(x: np.ndarray) -> np.ndarray:
    """As `functions.stats.r4`."""
    x = np.asarray(x, np.float64)
    size = np.abs(x)
    size = np.where(size < 1e11, np.floor(size * 10000.0 + 0.5) / 10000.0, size)
    return np.where(x < 0, -size, size) + 0.0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin and where they are over; the last value is false."""
    at = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        at = np.concatenate([[0], at])
    return at[::2], at[1::2]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order of appearance, the number of each key among them, and how
    often each occurs."""
    found = pa.array(keys).dictionary_encode()
    number = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    values = found.dictionary.to_numpy(zero_copy_only=False)
    return values, number, np.bincount(number, minlength=len(values))


class Files:
    """A slice of files, with what several figures need of them."""

    def __init__(self, content: pa.Array, keywords: tuple[str, ...] = vocab.KEYWORDS):
        self.content, self.n, self.keywords = content, len(content), keywords
        texts = [x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "" for x in content.cast(pa.binary())]
        self.text = "\n".join([*texts, ""])  # a line feed ends each text
        try:
            self.coding, self.char = "latin-1", np.frombuffer(self.text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            self.coding, self.char = "utf-32-le", np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if self.char.max() < 1 << 16:
                self.coding, self.char = "utf-16-le", self.char.astype(np.uint16)
        self.kind = _classes({1: 1 << 8, 2: 1 << 16, 4: 0x110000}[self.char.itemsize])[self.char]
        self.chars = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.chars + 1) - 1  # of each text, where its line feed is
        self.start = self.end - self.chars

    # -- helpers

    def has(self, bits: int) -> np.ndarray:
        return (self.kind & bits) != 0

    def among(self, chars: str) -> np.ndarray:
        """Which characters are among these."""
        out = self.char == ord(chars[0])
        for c in chars[1:]:
            out |= self.char == ord(c)
        return out

    def sizes(self, places: np.ndarray) -> np.ndarray:
        """How many of the places, which ascend, each file has."""
        return np.searchsorted(places, self.end) - np.searchsorted(places, self.start)

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The files of places that ascend."""
        return np.repeat(np.arange(self.n), np.searchsorted(places, self.end, "right") - np.searchsorted(places, self.start))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many characters of each file are in the mask, its last line feed left out."""
        return self.sizes(np.flatnonzero(mask))

    def per_file(self, owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights=weights, minlength=self.n)

    def most(self, owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The greatest value of each file, 0 at least."""
        out = np.zeros(self.n, np.int64)
        np.maximum.at(out, owner, values.astype(np.int64))
        return out

    def coded(self, *spans: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the texts of lists of ascending spans, one list after the other, and what
        they stand for; those of one list don't overlap."""
        bodies, sizes = [], [np.zeros(1, np.int64)]
        for start, end in spans:
            edge = np.zeros(len(self.char) + 1, np.int8)
            edge[start] += 1  # each place begins or ends one span at most
            edge[end] -= 1
            bodies.append(self.char[np.cumsum(edge[:-1], dtype=np.int8).view(bool)])
            sizes.append((end - start) * self.char.itemsize)
        at = np.cumsum(np.concatenate(sizes))
        texts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(bodies))])
        found = texts.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary

    def is_in(self, dictionary: pa.Array, words: tuple[str, ...]) -> np.ndarray:
        """Which entries of a dictionary are among the words."""
        known = []
        for w in words:
            try:
                known.append(w.encode(self.coding))
            except UnicodeEncodeError:  # a word that these texts cannot have
                pass
        return pc.is_in(dictionary, value_set=pa.array(known, pa.large_binary())).to_numpy(zero_copy_only=False)

    def spelled(self, dictionary: pa.Array) -> list[str]:
        return [x.decode(self.coding, "surrogatepass" if self.char.itemsize > 1 else "strict") for x in dictionary.to_pylist()]

    def entropy(self, count: np.ndarray, owner: np.ndarray) -> np.ndarray:
        p = count / self.per_file(owner, count)[owner]
        return self.per_file(owner, -p * np.log2(p)) + 0.0

    def distinct(self, owner: np.ndarray, code: np.ndarray, kinds: int) -> np.ndarray:
        """How many different codes, of so many, each file has."""
        return self.per_file(_numbered(owner * max(1, kinds) + code)[0] // max(1, kinds))

    def line(self, x: np.ndarray, y: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slope, intercept and fit of each file's least-squares line."""
        n, sx, sy = self.per_file(owner), self.per_file(owner, x), self.per_file(owner, y)
        sxy, sxx = self.per_file(owner, x * y), self.per_file(owner, x * x)
        slope = _share(n * sxy - sx * sy, n * sxx - sx * sx)
        base = _share(sy - slope * sx, n)
        rest = self.per_file(owner, (y - slope[owner] * x - base[owner]) ** 2)
        about = self.per_file(owner, (y - _share(sy, n)[owner]) ** 2)
        return slope, base, 1 - rest / (about + 1e-10)

    # -- tokens

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens begin and end.  In a run of letters and digits all from the first
        ASCII letter on is one token; before it, digits are numbers, others stand alone."""
        begin, end = _runs(self.has(RUN))
        first = begin.copy()
        odd = np.flatnonzero((self.kind[begin] & ALPHA) == 0)
        head = np.zeros(len(self.char), bool)
        if len(odd):
            letters = np.append(np.flatnonzero(self.has(ALPHA)), len(self.char))
            first[odd] = np.minimum(letters[np.searchsorted(letters, begin[odd])], end[odd])
            edge = np.zeros(len(self.char) + 1, np.int8)
            np.add.at(edge, begin[odd], 1)
            np.add.at(edge, first[odd], -1)
            head = np.cumsum(edge[:-1], dtype=np.int8) > 0
        digits = head & self.has(DIGIT)
        alone = ((self.kind & (RUN | SPACE)) == 0) | (head & ~digits)
        # numbers at both sides of a dot are one; in a longer chain every other dot joins
        low, high = _runs(digits)
        joined = np.zeros(len(low), bool)
        if len(low) > 1:
            link = np.zeros(len(low), bool)
            link[1:] = (high[:-1] + 1 == low[1:]) & (self.char[high[:-1]] == ord("."))
            place = np.arange(len(low))
            joined = (place - np.maximum.accumulate(np.where(link, 0, place))) % 2 == 1
        ahead = np.append(joined, False)[1:]
        alone[high[:-1][joined[1:]]] = False
        starts, ends = alone.copy(), alone
        some = first < end
        starts[first[some]] = True
        ends[end[some] - 1] = True
        starts[low[~joined]] = True
        ends[high[~ahead] - 1] = True
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    @cached_property
    def doc(self) -> np.ndarray:
        return self.owner(self.spans[0])

    @cached_property
    def size(self) -> np.ndarray:
        """Tokens of each file."""
        return self.sizes(self.spans[0])

    @cached_property
    def _coded(self) -> tuple[np.ndarray, pa.Array, tuple[np.ndarray, np.ndarray]]:
        """Tokens and ASCII words share their numbers; most of these words are tokens."""
        start, end = self.spans
        begin, over = self.ascii
        some = (self.kind[begin] & ALPHA) != 0
        begin, over = begin[some], over[some]
        at = np.minimum(np.searchsorted(start, begin), max(0, len(start) - 1))
        rest = np.flatnonzero((start[at] != begin) | (end[at] != over)) if len(begin) else begin
        code, words = self.coded(self.spans, (begin[rest], over[rest]))
        own = code[at]
        own[rest] = code[len(start) :]
        return code[: len(start)], words, (begin, own)

    @property
    def code(self) -> np.ndarray:
        return self._coded[0]

    @property
    def words(self) -> pa.Array:
        """What the numbers of tokens and ASCII words stand for."""
        return self._coded[1]

    @property
    def kinds(self) -> int:
        return max(1, len(self.words))

    @cached_property
    def is_word(self) -> np.ndarray:
        """Which tokens are whole runs of letters and digits."""
        start = self.spans[0]
        before = np.where(start > 0, self.kind[start - 1], 0)
        return ((self.kind[start] & ALPHA) != 0) & ((before & RUN) == 0)

    @cached_property
    def ids(self) -> np.ndarray:
        """Places, among the tokens, of the words that are no keywords."""
        return np.flatnonzero(self.is_word & ~self.is_in(self.words, self.keywords)[self.code])

    @cached_property
    def id_kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct identifiers of each file, and the number of each identifier."""
        return _numbered(self.doc[self.ids] * self.kinds + self.code[self.ids])[:2]

    @cached_property
    def id_before(self) -> np.ndarray:
        """For each identifier, where its file had it the last time before, or -1."""
        number = self.id_kinds[1]
        order = np.argsort(number, kind="stable")
        out = np.full(len(number), -1)
        out[order[1:]] = np.where(number[order][1:] == number[order][:-1], order[:-1], -1)
        return out

    @cached_property
    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each file's distinct tokens: file, number, how often, and its first place."""
        keys, number, count = _numbered(self.doc * self.kinds + self.code)
        first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)) if len(number) else number
        return keys // self.kinds, keys % self.kinds, count, first

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tokens that another follows; their pairs' numbers; and of each
        distinct pair of a file the file and how often."""
        at = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        keys, number, count = _numbered((self.doc[at] * self.kinds + self.code[at]) * self.kinds + self.code[at + 1])
        return at, number, keys // (self.kinds * self.kinds), count

    # -- ASCII words, numbers, quotes

    @cached_property
    def ascii(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ASCII word characters begin and end."""
        return _runs(self.has(WORD))

    @property
    def ascii_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Where those begin that begin with a letter or an underscore, and their numbers."""
        return self._coded[2]

    def ascii_in(self, words: tuple[str, ...]) -> np.ndarray:
        """Where these words begin."""
        begin, code = self.ascii_words
        return begin[self.is_in(self.words, words)[code]]

    @cached_property
    def named(self) -> np.ndarray:
        """Ends of the ASCII runs that have a letter or an underscore."""
        begin, end = self.ascii
        odd = np.flatnonzero((self.kind[begin] & ALPHA) == 0)
        if not len(odd):
            return end
        letters = np.append(np.flatnonzero(self.has(ALPHA)), len(self.char))
        bare = odd[letters[np.searchsorted(letters, begin[odd])] >= end[odd]]
        return np.delete(end, bare)

    @cached_property
    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Where numbers begin and end."""
        begin = self.ascii[0]
        starts, ends, over = [], [], 0
        for at in begin[(self.kind[begin] & DIGIT) != 0].tolist():
            if at >= over and (m := _A_NUMBER.match(self.text, at)):
                over = m.end()
                starts.append(at)
                ends.append(over)
        return np.array(starts, np.int64), np.array(ends, np.int64)

    @cached_property
    def quoted(self) -> tuple[np.ndarray, np.ndarray]:
        """Where strings begin and end: each opens at a quote that is not in another, and goes
        to the next of its kind in the file."""
        at = np.flatnonzero(self.among("\"'"))
        after = np.full(len(at), -1)
        of = self.owner(at)
        for q in "\"'":
            mine = np.flatnonzero(self.char[at] == ord(q))
            same = of[mine[1:]] == of[mine[:-1]]
            after[mine[:-1][same]] = mine[1:][same]
        opened, closed, k, after = [], [], 0, after.tolist()
        while k < len(after):
            if after[k] >= 0:
                opened.append(k)
                closed.append(after[k])
                k = after[k]
            k += 1
        return at[np.array(opened, np.int64)], at[np.array(closed, np.int64)] + 1

    # -- lines and brackets

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and file of each line, and its first visible place, its end without one."""
        ends = np.flatnonzero(self.char == ord("\n"))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        of = self.owner(ends)
        kept = (starts < ends) | (ends != self.end[of])  # nothing after the last line feed is no line
        starts, ends, of = starts[kept], ends[kept], of[kept]
        seen = np.append(np.flatnonzero(~self.has(SPACE)), len(self.char))
        return starts, ends, of, np.minimum(seen[np.searchsorted(seen, starts)], ends)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self.per_file(self.lines[2])

    @cached_property
    def shown(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lines with something visible: begin, end, file, first visible place, first
        place that is no ASCII white space."""
        starts, ends, of, first = self.lines
        some = np.flatnonzero(first < ends)
        starts, ends, of, first = starts[some], ends[some], of[some], first[some]
        solid = np.append(np.flatnonzero(~self.has(BLANK)), len(self.char))
        return starts, ends, of, first, solid[np.searchsorted(solid, starts)]

    @cached_property
    def n_shown(self) -> np.ndarray:
        return self.per_file(self.shown[2])

    @cached_property
    def unique_lines(self) -> np.ndarray:
        """How many different visible lines each file has."""
        starts, ends, of = self.shown[:3]
        code, found = self.coded((starts, ends))
        return self.distinct(of, code, len(found))

    @cached_property
    def brackets(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of brackets, and +1 for each that opens, -1 for each that closes."""
        opening = self.among("([{")
        at = np.flatnonzero(opening | self.among(")]}"))
        return at, np.where(opening[at], 1, -1)

    @cached_property
    def nesting(self) -> np.ndarray:
        """Greatest depth of brackets, where depth stays at 0 or above."""
        at, sign = self.brackets
        if not len(at):
            return np.zeros(self.n, np.int64)
        of = self.owner(at)
        total = np.cumsum(sign)
        size = self.per_file(of)
        head = (np.cumsum(size) - size)[of]
        depth = total - (total - sign)[head]
        far = 2 * len(at) + 2  # so that no file's least depth is that of one before it
        least = np.minimum.accumulate(np.minimum(depth, 0) - of * far) + of * far
        return self.most(of, depth - least)


#: The number at the begin of a run, as NUMBER finds it, without going back over digits.
_A_NUMBER = re.compile(rf"[0-9]++(?:\.[0-9]*+(?:[eE][+-]?[0-9]++)?+{X.EDGE_R}|(?:[eE][+-]?[0-9]++)?+{X.EDGE_R})")
_MARKS = re.compile(MARKS)
_EARLY_DIGIT = re.compile("[^_0-9]*+[0-9]")
_ESCAPED = re.compile(r'"(?:[^"\\]++|\\[^\n])*+"')
_IN_BRACKETS = re.compile(r"[(\[][0-9][0-9_]*+(?:\.[0-9]+)?[)\]]")
_DEFINITION, _METHOD, _BOUNDARY = (re.compile(p, re.ASCII) for p in (DEFINITION, METHOD, BOUNDARY))
_DEFINING = tuple("def defp defmacro defmacrop defguard defdelegate function func fun fn public private protected internal".split())


def _log2(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x, 1).astype(np.float64))


def _within(start: np.ndarray, end: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places lie in one of the ascending spans."""
    if not len(start):
        return np.zeros(len(places), bool)
    k = np.searchsorted(start, places, "right") - 1
    return (k >= 0) & (places < end[np.maximum(k, 0)])


def _bytes(f: Files) -> np.ndarray:
    return pc.fill_null(pc.binary_length(f.content), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _entropy(f: Files) -> list:
    size = _bytes(f)
    body = np.frombuffer(b"".join(x.as_buffer() if x.is_valid else b"" for x in f.content.cast(pa.binary())), np.uint8)
    seen = np.bincount(np.repeat(np.arange(f.n) * 256, size) + body, minlength=f.n * 256)
    at = np.flatnonzero(seen)
    owner, _, count, _ = f.counts
    out = []
    for number, of in ((seen[at], at // 256), (count, owner)):
        h, most = f.entropy(number, of), _log2(f.per_file(of))
        out += [h, most, _share(h, most)]
    return [*out, f.per_file(owner), f.size]


def _unique_lines(f: Files) -> list:
    return [_bytes(f), _share(f.unique_lines, f.n_shown)]


def _compression(f: Files) -> list:
    z = np.array([len(zlib.compress(x.as_buffer())) if x.is_valid and len(x.as_buffer()) else 0 for x in f.content.cast(pa.binary())], np.int64)
    raw, unique = _unique_lines(f)
    return [raw, z, np.where(raw > 0, raw / np.maximum(z, 1), 0.0), np.where(raw > 0, np.maximum(0.0, 1 - _share(z, raw)), 0.0), unique]


def _zipf(f: Files) -> list:
    owner, _, count, _ = f.counts
    kinds = f.per_file(owner)
    order = np.lexsort((-count, owner))
    rank = np.arange(len(owner)) - (np.cumsum(kinds) - kinds)[owner] + 1
    slope, _, fit = f.line(np.log(rank), np.log(count[order]), owner)
    return [np.where(kinds < 3, 0.0, -slope), np.where(kinds < 3, 0.0, fit), kinds, f.size]


def _heaps(f: Files) -> list:
    """Sampled about fifty times; zeros under five samples."""
    fresh = np.zeros(len(f.code), np.int64)
    fresh[f.counts[3]] = 1
    start = np.cumsum(f.size) - f.size
    known = np.cumsum(fresh)
    known = known - (known - fresh)[np.minimum(start, max(0, len(fresh) - 1))][f.doc] if len(fresh) else known
    place = np.arange(len(f.code)) - start[f.doc] + 1
    at = np.flatnonzero(place % np.maximum(1, f.size // 50)[f.doc] == 0)
    slope, base, fit = f.line(np.log(place[at]), np.log(known[at]), f.doc[at])
    few = f.per_file(f.doc[at]) < 5
    return [np.where(few, 0.0, x) for x in (np.exp(base), slope, fit)]


def _vocabulary(f: Files, window: int = 100) -> list:
    """The distinct words of all windows are counted by where each occurrence is the first
    of its word: from after the one before it, or the window's length back."""
    doc, code = f.doc[f.ids], f.code[f.ids]
    keys, size = f.id_kinds[0], f.per_file(doc)
    kinds = f.per_file(keys // f.kinds)
    start = np.cumsum(size) - size
    place = np.arange(len(code)) - start[doc]
    before = np.where(f.id_before >= 0, f.id_before - start[doc], -1)
    first = np.maximum(np.maximum(before + 1, place - window + 1), 0)
    windows = np.maximum(0, np.minimum(place, (size - window)[doc]) - first + 1)
    moving = _share(f.per_file(doc, windows), np.maximum(size - window + 1, 1)) / window
    plain = _share(kinds, size)
    return [plain, np.where(size < window, plain, moving), kinds, size]


def _vocabulary_text(f: Files) -> pa.Array:
    """The distinct words of each file in order, between blanks."""
    words = f.spelled(f.words)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    at = np.flatnonzero(f.is_word)
    keys = np.sort(_numbered(f.doc[at] * f.kinds + rank[f.code[at]])[0])
    spelled = np.array(sorted(words), object)[keys % f.kinds].tolist() if len(words) else []
    ends = np.searchsorted(keys, (np.arange(f.n) + 1) * f.kinds).tolist()
    return pa.array([" ".join(spelled[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.string())


def _diversity(n: int, again: list[int], before: list[int], limit: float = 0.72) -> float:
    """Mean length of the runs of n words; `again` are the places of words that were there
    before, at `before`.  Only these can end a run, as a new word raises the share of types."""
    start = known = 0
    factors = 0.0
    for at, last in zip(again, before, strict=True):
        if last >= start:
            known += 1
            size = at - start + 1
            if (size - known) / size <= limit:
                start, known, factors = at + 1, 0, factors + 1
    if n > start:
        factors += (1 - (n - start - known) / (n - start)) / (1 - limit)
    return n / factors if factors else float(n)


def _mtld(f: Files) -> list:
    size = f.per_file(f.doc[f.ids])
    ends = np.cumsum(size)
    at = np.flatnonzero(f.id_before >= 0)
    last = f.id_before[at]
    bounds = np.searchsorted(at, np.concatenate([[0], ends]))
    # read backwards, a place is as far from the end, and was there before where it comes again
    order = np.argsort(last, kind="stable")
    ahead, back = np.zeros(f.n), np.zeros(f.n)
    for k in range(f.n):
        a, b, over, n = int(bounds[k]), int(bounds[k + 1]), int(ends[k]), int(size[k])
        ahead[k] = _diversity(n, (at[a:b] - (over - n)).tolist(), (last[a:b] - (over - n)).tolist())
        own = order[a:b][::-1]  # `last` of a file lie in the file as well
        back[k] = _diversity(n, (over - 1 - last[own]).tolist(), (over - 1 - at[own]).tolist())
    return [ahead, back, (ahead + back) / 2]


def _concentration(f: Files) -> list:
    owner, _, count, _ = f.counts
    squares, n = f.per_file(owner, (count * count).astype(np.float64)), f.size.astype(np.float64)
    few = f.size < 2
    return [np.where(few, 0.0, _share((squares - n) * 10000, n * n)), np.where(few, 0.0, _share(squares - n, n * (n - 1))), f.size]


def _renyi(f: Files) -> list:
    owner, _, count, _ = f.counts
    some = f.size > 0
    p = count / f.size[owner]
    most = np.zeros(f.n)
    np.maximum.at(most, owner, p)
    collision = f.per_file(owner, p * p)
    h = [_log2(f.per_file(owner)), f.entropy(count, owner), *(-np.log2(np.where(some, x, 1.0)) for x in (collision, most))]
    return [*h, np.where(some, 2.0 ** h[1], 0.0), np.where(some, 2.0 ** h[2], 0.0), h[0] - h[2]]


def _ngram(f: Files) -> list:
    at, number, owner, count = f.pairs
    third = np.flatnonzero(at[1:] == at[:-1] + 1)  # pairs that the next pair goes on with
    keys, _, threes = _numbered(number[third] * f.kinds + f.code[at[third] + 2])
    out = []
    for of, times in ((owner, count), (owner[keys // f.kinds], threes)):
        total, kinds = f.per_file(of, times).astype(np.int64), f.per_file(of)
        again = times > 1
        out += [total, kinds, _share(f.per_file(of[again], times[again]), total), _share(f.per_file(of[times == 1]), kinds), f.per_file(of[again])]
    return out


def _conditional(f: Files) -> list:
    at, _, owner, count = f.pairs
    keys, _, before = _numbered(f.doc[at] * f.kinds + f.code[at])
    h = np.abs(f.entropy(count, owner) - f.entropy(before, keys // f.kinds))
    return [h, 2.0**h, _share(h, _log2(f.distinct(f.doc[at], f.code[at + 1], f.kinds)))]


def _operators(f: Files) -> tuple[np.ndarray, np.ndarray]:
    """Distinct operators and all operators of each file."""
    begin, code = f.ascii_words
    at = np.flatnonzero(f.is_in(f.words, vocab.OPERATOR_WORDS)[code])
    of = f.owner(begin[at])
    unique, total = f.distinct(of, code[at], f.kinds), f.per_file(of)
    # runs of marks are cut to operators once for each different run
    begin, end = _runs(f.has(MARK))
    code, found = f.coded((begin, end))
    of = f.owner(begin)
    number: dict[str, int] = {}
    cut = [[number.setdefault(x, len(number)) for x in _MARKS.findall(s)] for s in f.spelled(found)]
    n = np.array([len(x) for x in cut], np.int64)
    flat, head = np.array([k for x in cut for k in x], np.int64), np.cumsum(n) - n
    keys = _numbered(of * max(1, len(cut)) + code)[0]
    own, run = keys // max(1, len(cut)), keys % max(1, len(cut))
    size = n[run]
    marks = flat[np.repeat(head[run] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return unique + f.distinct(np.repeat(own, size), marks, len(number)), total + f.per_file(of, n[code]).astype(np.int64)


def _operands(f: Files) -> tuple[np.ndarray, np.ndarray]:
    """Distinct operands and all operands of each file: words and numbers outside quotes,
    and strings."""
    begin, code = f.ascii_words
    opened, closed = f.quoted
    low, high = f.numbers
    free = ~_within(opened, closed, low)
    low, high = low[free], high[free]
    at = np.flatnonzero(~(f.is_in(f.words, vocab.OPERATOR_WORDS)[code] | _within(opened, closed, begin) | _within(low, high, begin)))
    of = f.owner(begin[at])
    unique, total = f.distinct(of, code[at], f.kinds), f.per_file(of)
    for start, end in ((low, high), (opened, closed)):
        code, found = f.coded((start, end))
        of = f.owner(start)
        unique, total = unique + f.distinct(of, code, len(found)), total + f.per_file(of)
    return unique, total


def _halstead(f: Files) -> list:
    """The time is null where the vocabulary is one word."""
    (n1, t1), (n2, t2) = _operators(f), _operands(f)
    known, length = n1 + n2, t1 + t2
    volume = np.where(known > 1, length * np.array([math.log2(max(1, x)) for x in known.tolist()]), 0.0)
    difficulty = np.where((known > 1) & (n2 > 0), n1 / 2 * _share(t2, n2), 0.0)
    effort = difficulty * volume
    return [n1, n2, t1, t2, known, length, volume, difficulty, effort, volume / 3000, pa.array(rounded(effort / 18), mask=known == 1)]


def _readability(f: Files) -> list:
    starts, ends, of, first, _ = f.shown
    kept = np.flatnonzero(f.char[first] != ord("#"))
    n = f.per_file(of[kept])
    # a word's parts begin after underscores and at capitals after small letters
    upper, lower = (f.char >= ord("A")) & (f.char <= ord("Z")), (f.char >= ord("a")) & (f.char <= ord("z"))
    bar = f.char == ord("_")
    fresh = bar.copy()
    fresh[1:] = bar[:-1] | (upper[1:] & lower[:-1])
    fresh &= ~bar
    begin, end = (x[f.is_word] for x in f.spans)
    known = np.concatenate([[0], np.cumsum(fresh, dtype=np.int64)])
    inner = np.minimum(begin + 1, end)
    parts = known[end] - known[inner] + ~bar[begin]
    own = f.doc[f.is_word]
    words = f.per_file(own)
    tpl, length = _share(f.size, n), _share(f.per_file(of[kept], (ends - starts)[kept]), n)
    sub, hard = _share(f.per_file(own, parts), words), _share(f.per_file(own[parts > 2]), words)
    figures = [tpl, length, sub, 206.835 - 1.015 * tpl - 84.6 * sub, 0.4 * (tpl + 100 * hard)]
    return [*(np.where(n > 0, x, 0.0) for x in figures), n]


def _density(f: Files) -> list:
    numbers = f.per_file(f.doc[(f.kind[f.spans[0]] & DIGIT) != 0])
    own = np.minimum(f.per_file(f.doc[f.ids]) + numbers, f.size)
    return [_share(own, f.size), own, f.size - own]


def _casing(f: Files) -> list:
    """The first style that fits, of `functions.text.casing`: words have no hyphens, so the
    last named one never does.  The count of a style that doesn't occur is null."""
    begin, end = (x[f.ids] for x in f.spans)
    upper, lower, digit, bar, other, bad = 1, 2, 4, 8, 16, 32
    table = np.full(256, other, np.uint8)
    table[ord("A") : ord("Z") + 1], table[ord("a") : ord("z") + 1], table[ord("0") : ord("9") + 1], table[ord("_")] = upper, lower, digit, bar
    marks = table[np.minimum(f.char, 255).astype(np.uint8)]
    at = np.flatnonzero(marks == bar)
    marks[at[(f.kind[at + 1] & WORD == 0) | (marks[at + 1] & bar != 0)]] |= bad  # a part without letters or digits
    edges = np.column_stack([begin, end]).ravel()
    has = np.bitwise_or.reduceat(marks, edges)[::2] if len(edges) else np.zeros(0, np.uint8)
    lead = marks[begin]
    plain, parts = has & (bar | other) == 0, has & (other | bad) == 0
    early = np.zeros(len(has), bool)  # digits in the first part
    early[has & (digit | bar) == digit] = True
    for k in np.flatnonzero(has & (digit | bar) == digit | bar).tolist():
        early[k] = bool(_EARLY_DIGIT.match(f.text, begin[k], end[k]))
    style = np.select(
        [(lead == upper) & plain, (lead == lower) & plain & (has & upper != 0), (lead == lower) & parts & ~early & (has & upper == 0), (lead == upper) & parts & ~early & (has & lower == 0)],
        [0, 1, 2, 3], 5,
    )
    count = np.bincount(f.doc[f.ids] * len(STYLES) + style, minlength=f.n * len(STYLES)).reshape(f.n, len(STYLES))
    n = count.sum(axis=1)
    h = np.zeros(f.n)
    for k in sorted(range(len(STYLES)), key=STYLES.__getitem__):
        p = _share(count[:, k], n)
        h = h - p * np.log2(np.where(p > 0, p, 1.0))
    return [h + 0.0, _share(count[:, STYLES.index("macro_case")], n), *(pa.array(count[:, k], pa.int64(), mask=count[:, k] == 0) for k in range(len(STYLES)))]


def _spread(f: Files, owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of whole numbers, from exact sums."""
    v = values.astype(np.float64)
    n, s, q = f.per_file(owner).astype(np.float64), f.per_file(owner, v), f.per_file(owner, v * v)
    return _share(s, n), _share(n * q - s * s, n * n)


def _id_lengths(f: Files) -> list:
    of, length = f.doc[f.ids], (f.spans[1] - f.spans[0])[f.ids]
    mean, variance = _spread(f, of, length)
    return [mean, variance, np.sqrt(variance), f.most(of, length)]


def _indentation(f: Files) -> list:
    starts, _, of, _, solid = f.shown
    mean, variance = _spread(f, of, solid - starts)
    begin, _, own, _ = f.lines
    tabs = f.per_file(own[f.char[begin] == ord("\t")]) > 0
    return [mean, variance, f.most(of, solid - starts), tabs, _share(f.n_lines - f.n_shown, f.n_lines)]


def _branching(f: Files) -> list:
    count = f.per_file(f.doc[f.is_in(f.words, vocab.BRANCHING)[f.code]])
    return [_share(count, f.n_shown), count, f.n_shown, f.nesting]


def _parameters(line: str) -> int:
    """Parameters of a definition's first brackets, by commas at depth 0."""
    begin = line.find("(")
    end = line.find(")", begin + 1) if begin >= 0 else -1
    args = line[begin + 1 : end].strip(" ") if end >= 0 else ""
    depth = commas = 0
    for c in args:
        if c in "([{":
            depth += 1
        elif c in "}])":
            depth = max(0, depth - 1)
        elif c == ",":
            commas += depth == 0
    return commas + 1 if args else 0


def _functions(f: Files) -> list:
    starts, ends, of, _ = f.lines
    at = np.unique(np.searchsorted(starts, f.ascii_in(_DEFINING), "right") - 1)  # lines with a word that may define
    texts = [(k, f.text[a:b]) for k, a, b in zip(at.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)]
    found = [(k, _parameters(x)) for k, x in texts if _DEFINITION.search(x) or _METHOD.search(x)]
    line, params = np.array([k for k, _ in found], np.int64), np.array([p for _, p in found], np.int64)
    own = of[line]
    over = np.cumsum(f.n_lines)[own]  # up to the next one in the file, or the file's end
    if len(line) > 1:
        over[:-1] = np.where(own[1:] == own[:-1], line[1:], over[:-1])
    length, n = over - line, f.per_file(own)
    return [n, _share(f.per_file(own, length), n), f.most(own, length), _share(f.per_file(own, params), n), f.most(own, params)]


def _magic(f: Files) -> list:
    low, high = f.numbers
    code, found = f.coded((low, high))
    magic = f.per_file(f.owner(low)[~f.is_in(found, PLAIN_NUMBERS)[code]])
    quotes, escapes = f.count(f.among('"')), f.count(f.among("\\"))
    strings = quotes // 2
    for k in np.flatnonzero((quotes > 1) & (escapes > 0)).tolist():
        strings[k] = sum(1 for _ in _ESCAPED.finditer(f.text, f.start[k], f.end[k]))
    return [_share(magic, f.size), np.where(f.size > 0, magic, 0), _share(strings, f.size)]


def _symbols(f: Files) -> list:
    at = np.flatnonzero((f.kind & (RUN | SPACE)) == 0)
    of = f.owner(at)
    count = f.per_file(of)
    return [_share(count, f.chars), count, f.distinct(of, f.char[at].astype(np.int64), 0x110000)]


def _vowels(f: Files) -> list:
    begin, end = (x[f.ids] for x in f.spans)
    known = np.concatenate([[0], np.cumsum(f.has(VOWEL), dtype=np.int64)])
    of = f.doc[f.ids]
    vowels, chars = (f.per_file(of, x).astype(np.int64) for x in (known[end] - known[begin], end - begin))
    return [_share(vowels, chars), vowels, chars]


def _brevity(f: Files) -> list:
    owner, code, count, _ = f.counts
    length = (pc.binary_length(f.words).to_numpy(zero_copy_only=False) // f.char.itemsize).astype(np.float64)[code] if len(code) else np.zeros(0)
    times = count.astype(np.float64)
    n, sx, sy, sxy, sxx, syy = (f.per_file(owner, w) for w in (None, length, times, length * times, length * length, times * times))
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    correlation = _share(n * sxy - sx * sy, np.sqrt(np.maximum(spread, 0)))
    slope, _, _ = f.line(np.log(length), np.log(times), owner)
    slope = np.where(n * sxx == sx * sx, 0.0, slope)  # all of one length
    return [np.where(n < 3, 0.0, correlation), np.where(n < 3, 0.0, slope), n.astype(np.int64)]


def _punctuation(f: Files) -> list:
    """Runs of word characters are looked at once, by what follows their end."""
    n = np.maximum(f.size, 1)
    opening, closing, other = f.among("([{"), f.among(")]}"), (f.kind & (WORD | BLANK)) == 0
    other[f.end] = False
    suffix = f.sizes(f.named[other[f.named]])
    colon = f.sizes(f.named[f.char[f.named] == ord(":")])
    before = f.count((other & ~opening)[:-1] & opening[1:])
    after = f.count(closing[:-1] & (other & ~closing)[1:])
    at = np.flatnonzero(f.among("([")[:-1] & f.has(DIGIT)[1:])
    pairs = f.sizes(np.array([k for k in at.tolist() if _IN_BRACKETS.match(f.text, k)], np.int64))
    arrows = f.count(f.among("-=")[:-1] & (f.char == ord(">"))[1:])
    return [_share(f.count(f.among("?")), f.chars), _share(f.count(f.among("!")), f.chars), f.count(f.among(".")), suffix / n, before, after, pairs, arrows / n, colon / n]


def _comments(f: Files) -> list:
    _, _, of, _, solid = f.shown
    first, second = f.char[solid], f.char[np.minimum(solid + 1, len(f.char) - 1)]
    said = (first == ord("#")) | (first == ord("*")) | ((first == ord("/")) & ((second == ord("/")) | (second == ord("*"))))
    count = f.per_file(of[said])
    return [_share(count, f.n_shown), count, f.sizes(f.ascii_in(("TODO", "FIXME", "HACK", "XXX")))]


def _separators(f: Files) -> list:
    return [f.count(f.among(c)) for c in "_-/."]


def _line_patterns(f: Files) -> list:
    """The distinct lines are those without white space at both ends."""
    starts, ends, of, first, _ = f.shown
    seen = np.flatnonzero(~f.has(SPACE))
    code, found = f.coded((first, seen[np.searchsorted(seen, ends) - 1] + 1)) if len(first) else (first, [])
    unique = f.distinct(of, code, len(found))
    return [_share(f.n_lines - f.n_shown, f.n_lines), _share(unique, f.n_shown, 1.0), f.nesting, _share(f.sizes(f.quoted[0]), f.size)]


def _unreachable(f: Files) -> list:
    """Lines after a terminal statement count as dead until one is indented less, or as
    much and goes on with the scope."""
    starts, ends, of, _, solid = f.shown
    ending, inline = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    at = f.ascii_in(("return", "raise", "throw", "break", "continue"))
    line = np.searchsorted(starts, at, "right") - 1
    ending[line[solid[line] == at]] = True
    inline[np.searchsorted(starts, f.ascii_in(("return", "raise", "throw")), "right") - 1] = True
    place, sign = f.brackets
    depth = np.concatenate([[0], np.cumsum(sign)])
    balance = depth[np.searchsorted(place, ends)] - depth[np.searchsorted(place, starts)]
    terminal, said = ending & (balance <= 0), (ending & (balance <= 0)) | (~ending & inline)
    indent, alive = (solid - starts).tolist(), np.ones(len(starts), bool)
    begins, overs, size = starts.tolist(), ends.tolist(), np.cumsum(f.n_shown)[of].tolist()
    over = -1
    for k in np.flatnonzero(terminal).tolist():
        if k < over:
            continue
        over = k + 1
        while over < size[k] and indent[over] >= indent[k] and not (indent[over] == indent[k] and _BOUNDARY.search(f.text[begins[over] : overs[over]])):
            over += 1
        alive[k + 1 : over] = False
    dead, count = f.per_file(of[~alive]), f.per_file(of[alive & said])
    return [_share(dead, f.n_shown), count, dead]


def _bradford(f: Files) -> list:
    """Zones of a third of the tokens each, over the lines by density; zeros under three
    lines or tokens."""
    starts, _, of, _ = f.lines
    at = np.searchsorted(f.spans[0], np.append(starts, len(f.char)))
    count = np.diff(at)
    some = np.flatnonzero(count > 0)
    own, count = of[some], count[some]
    count = count[np.lexsort((-count, own))]
    size, out = f.per_file(own), np.zeros((3, f.n))
    first = np.cumsum(size) - size
    for k in np.flatnonzero((size >= 3) & (f.size >= 3)).tolist():
        sums, third = np.cumsum(count[first[k] : first[k] + size[k]]), f.size[k] / 3.0
        n1 = int(np.argmax(sums >= third)) + 1
        rest = sums[n1:] - sums[n1 - 1] >= third
        n2 = int(np.argmax(rest)) + 1 if rest.any() else len(rest)
        k1 = rounded(n2 / n1)
        k2 = rounded((size[k] - n1 - n2) / n2) if n2 else np.float64(0.0)
        out[:, k] = k1, k2, rounded(k2 / k1) if k1 > 0 else 0.0
    return list(out)


def _rfc(f: Files) -> list:
    at = f.pairs[0]
    named = ((f.kind[f.spans[0]] & ALPHA) != 0)
    defining = f.is_in(f.words, vocab.FUNCTION_WORDS)[f.code[at]] & named[at + 1]
    calls = ~defining & named[at] & (f.char[f.spans[0][at + 1]] == ord("("))
    d, c = f.per_file(f.doc[at[defining]]), f.distinct(f.doc[at[calls]], f.code[at[calls]], f.kinds)
    return [d + c, _share(d + c, f.n_lines), d, c]


_KERNELS: dict[str, Callable[[Files], list]] = {
    "entropy": _entropy, "compression": _compression, "unique_lines": _unique_lines, "zipf": _zipf, "heaps": _heaps, "vocabulary": _vocabulary, "mtld": _mtld,
    "lexical_concentration": _concentration, "renyi_entropy": _renyi, "ngram": _ngram, "conditional_entropy": _conditional, "halstead": _halstead,
    "readability": _readability, "lexical_density": _density, "casing_entropy": _casing, "identifier_length_variance": _id_lengths, "indentation": _indentation,
    "branching": _branching, "function_metrics": _functions, "magic_number_density": _magic, "symbol_density": _symbols, "vowel_density": _vowels, "brevity": _brevity,
    "punctuation_density": _punctuation, "comment_structure": _comments, "separator_counts": _separators, "line_patterns": _line_patterns,
    "unreachable_code": _unreachable, "bradford": _bradford, "rfc": _rfc,
}

_TYPES = {"#": (T.LongType(), pa.int64()), "?": (T.BooleanType(), pa.bool_()), "$": (T.StringType(), pa.string())}


def keys(name: str, texts: bool = True) -> list[tuple[str, str]]:
    """Names and marks of a metric's figures."""
    return [(k.rstrip("#~?$"), k[-1] if k[-1] in "#~?$" else "") for k in FIGURES[name] if texts or k[-1] != "$"]


def _slices(content: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices of about `SLICE` bytes."""
    at = held = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(content), 0).to_pylist()):
        if held and held + n > SLICE:
            yield at, k - at
            at, held = k, 0
        held += n
    if at < len(content):
        yield at, len(content) - at


def _array(values, mark: str) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    if mark == "#":
        return pa.array(values.astype(np.int64))
    return pa.array(values) if mark == "?" else pa.array(np.asarray(values, np.float64) if mark == "~" else rounded(values))


def kernel(names: tuple[str, ...], keywords: tuple[str, ...] = vocab.KEYWORDS, texts: bool = False):
    """The Arrow function of content that gives a struct of the figures `metric_key` of the
    metrics `names`; figures that are texts only with `texts`."""
    fields = [(f"{m}_{k}", mark) for m in names for k, mark in keys(m, texts)]
    schema = T.StructType([T.StructField(n, _TYPES.get(mark, (T.DoubleType(),))[0]) for n, mark in fields])
    types = [_TYPES.get(mark, (None, pa.float64()))[1] for _, mark in fields]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for content in parts:
            done = []
            for at, n in _slices(content):
                files = Files(content.slice(at, n), keywords)
                with np.errstate(all="ignore"):
                    found = [x for m in names for x in [*_KERNELS[m](files), *([_vocabulary_text(files)] if texts and m == "vocabulary" else [])]]
                done.append([_array(x, mark) for x, (_, mark) in zip(found, fields, strict=True)])
            columns = [pa.concat_arrays([d[k] for d in done]) if done else pa.array([], t) for k, t in enumerate(types)]
            yield pa.StructArray.from_arrays(columns, names=[n for n, _ in fields])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType=schema)


_COUNTS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]))


def token_counts():
    """The Arrow function of content that gives each file's distinct tokens and how often
    they occur."""
    inner = pa.struct([("token", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for content in parts:
            done = [pa.array([], pa.list_(inner))]
            for at, n in _slices(content):
                f = Files(content.slice(at, n))
                owner, code, count, _ = f.counts  # in order of the files
                words = pa.array(f.spelled(f.words), pa.string())
                rows = pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(count.astype(np.int64))], names=["token", "n"])
                ends = np.concatenate([[0], np.cumsum(f.per_file(owner))]).astype(np.int32)
                done.append(pa.ListArray.from_arrays(pa.array(ends), rows))
            yield pa.concat_arrays(done)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType=_COUNTS)


def _sixth(x: np.ndarray) -> np.ndarray:
    """Six decimal places, halves away from zero, as SQL rounds the shortest decimal of a number."""
    size = np.abs(x) * 1e6
    out = np.floor(size + 0.5) / 1e6
    for k in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-4).tolist():
        out[k] = float(Decimal(repr(abs(float(x[k])))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.where(x < 0, -out, out)


class _States:
    """Sums, sums of squares and bounds of figures by group.  Sums are exact: numbers have
    six places at most and are added as whole numbers, in two parts; large ones as decimals."""

    LARGE = 1e8

    def __init__(self, figures: int):
        self.groups: dict[tuple, int] = {}
        self.figures, self.large = figures, {}
        self.n, self.high, self.low = (np.zeros((0, figures), np.int64) for _ in range(3))
        self.q, self.lo, self.hi = np.zeros((0, figures)), np.zeros((0, figures)), np.zeros((0, figures))

    def add(self, keys: list[tuple], columns: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Rows of these groups; each figure's values, and which of them are there."""
        of = np.array([self.groups.setdefault(k, len(self.groups)) for k in keys], np.int64)
        more = len(self.groups) - len(self.n)
        if more:
            for name, fill in (("n", 0), ("high", 0), ("low", 0), ("q", 0.0), ("lo", np.inf), ("hi", -np.inf)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full((more, self.figures), fill, old.dtype)]))
        count = lambda g, w=None: np.bincount(g, weights=w, minlength=len(self.groups))
        for k, (v, there) in enumerate(columns):
            g, v = (of, v) if there.all() else (of[there], v[there])
            self.n[:, k] += count(g)
            self.q[:, k] += count(g, v * v)
            np.minimum.at(self.lo[:, k], g, v)
            np.maximum.at(self.hi[:, k], g, v)
            small = np.abs(v) < self.LARGE
            for at in np.flatnonzero(~small).tolist():
                key = int(g[at]), k
                self.large[key] = self.large.get(key, Decimal(0)) + Decimal(repr(float(v[at]))).quantize(Decimal("0.000001"), ROUND_HALF_UP, _WIDE)
            whole = np.rint(np.where(small, v, 0.0) * 1e6).astype(np.int64)
            self.high[:, k] += count(g, (whole >> 20).astype(np.float64)).astype(np.int64)
            self.low[:, k] += count(g, (whole & ((1 << 20) - 1)).astype(np.float64)).astype(np.int64)

    def rows(self) -> Iterator[tuple]:
        for key, g in self.groups.items():
            for k in np.flatnonzero(self.n[g]).tolist():
                s = (Decimal((int(self.high[g, k]) << 20) + int(self.low[g, k])).scaleb(-6, _WIDE)) + self.large.get((g, k), Decimal(0))
                yield *key, k, int(self.n[g, k]), s, float(self.q[g, k]), float(self.lo[g, k]), float(self.hi[g, k])


_WIDE = Context(prec=60)
_GROUPS = 1 << 14  #: groups that a task holds before it gives its states away


def states(names: tuple[str, ...], keywords: tuple[str, ...], by: int):
    """The function of Arrow batches of `by` columns and content that gives the partial
    aggregate of each group: `by`, place of the figure among the numeric ones, n, s, q, lo, hi."""
    marks = [mark for m in names for _, mark in keys(m, False)]

    def column(x, mark: str) -> tuple[np.ndarray, np.ndarray]:
        got = _array(x, mark)
        v = got.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        return _sixth(v) if mark == "~" else v, ~got.is_null().to_numpy(zero_copy_only=False)

    def batch(s: _States, types: list[pa.DataType]) -> pa.RecordBatch:
        rows = list(zip(*s.rows(), strict=True)) or [[]] * len(types)
        return pa.record_batch([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=[f"c{k}" for k in range(len(types))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _States(sum(mark != "?" for mark in marks))
        types = [*[pa.string()] * by, pa.int64(), pa.int64(), pa.decimal128(38, 6), *[pa.float64()] * 3]
        for b in batches:
            content = b.column(by)
            own = list(zip(*(b.column(k).to_pylist() for k in range(by)), strict=True)) if by else [()] * len(content)
            for at, n in _slices(content):
                files = Files(content.slice(at, n), keywords)
                with np.errstate(all="ignore"):
                    found = [x for m in names for x in _KERNELS[m](files)]
                s.add(own[at : at + n], [column(x, mark) for x, mark in zip(found, marks, strict=True) if mark != "?"])
                if len(s.groups) > _GROUPS:
                    yield batch(s, types)
                    s = _States(s.figures)
        yield batch(s, types)

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers (SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(f: Files, k: int) -> pa.Array:
    """The distinct runs of k words of each file, as ascending 64-bit hashes; the whole, if it
    is shorter."""
    begin, end = _runs(f.has(RUN))
    length = end - begin
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    each = _mixed(_mixed(f.char[f.has(RUN)].astype(np.uint64)) + place.astype(np.uint64))
    word = _mixed(np.add.reduceat(each, np.cumsum(length) - length) + length.astype(np.uint64)) if len(begin) else each
    own = f.owner(begin)
    size = f.per_file(own)
    head = np.cumsum(size) - size
    of, runs = [], []
    for n in range(1, k + 1):  # of n words: all runs of k, shorter ones only where the file has no more
        at = np.flatnonzero(np.arange(len(own)) + k <= (head + size)[own]) if n == k else head[size == n]
        total = np.full(len(at), n, np.uint64)
        for j in range(n):
            total = total + _mixed(word[at + j] + np.uint64(j + 1) * np.uint64(0xD6E8FEB86659FD93))
        of.append(own[at])
        runs.append(_mixed(total))
    of, runs = np.concatenate(of), np.concatenate(runs).view(np.int64)
    order = np.lexsort((runs, of))
    of, runs = of[order], runs[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (runs[1:] != runs[:-1])
    ends = np.concatenate([[0], np.cumsum(f.per_file(of[fresh]))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(runs[fresh]))


def shingles(k: int):
    """The Arrow function of content that gives each file's distinct runs of k words."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for content in parts:
            with np.errstate(over="ignore"):
                done = [_shingles(Files(content.slice(at, n)), k) for at, n in _slices(content)]
            yield pa.concat_arrays([pa.array([], pa.list_(pa.int64())), *done])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType=T.ArrayType(T.LongType()))
