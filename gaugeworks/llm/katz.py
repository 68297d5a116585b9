"""Language-model scoring: a Katz backoff trigram model of the corpus.

Model.  Tokens are words, A-Z lower-cased, and one end for each text.  With c the
counts over the training texts, N tokens and V distinct ones, and x y a context h of
one or two tokens, h' the same without its first token,

    P(w)   = (c(w) + 1) / (N + V + 1)            one class for all unknown words
    P(w|h) = d(c(hw)) * c(hw) / c(h)             if c(hw) > 0
           = alpha(h) * P(w|h')                  if only c(h) > 0
           = P(w|h')                             else
    alpha(h) = (1 - sum of the first line over w) / (1 - sum of P(w|h') over these w)

d(r) is Katz's Good-Turing discount for r up to `Params.top`, from the counts of
counts of all n-grams of that order, and 1 for a larger r.  Two cases have no
Good-Turing estimate: an r whose estimate is not between 0 and 1 (tables too small for
it), and a context all of whose n-grams occur more than `top` times, so that nothing
would be left for unseen words.  There a count gives up `Params.tail` occurrences.
Every distribution sums to 1.  The first token's history is a start symbol; the second
one's is that symbol and the first.

Tables.  Texts are tokenised once, to chunks of a task: distinct word hashes, and
tokens as numbers of these (packed bytes, one row for each chunk).  The count tables
are hash-partitioned, unigrams by word, bigrams and trigrams by context; a chunk sends
each partition its distinct entries with their counts, once, and gets the counts over
the corpus back in the same order.  A context with more than `Params.part_entries`
occurrences (and a 2**20th of all) is split over as many partitions by its words, and
the figures for its alpha are summed apart; at most 2**20 contexts of an order are, so
these sums are broadcast.  No other table is broadcast or collected: the driver sees N,
V and `top` + 1 counts of counts of each order.  Then the chunks evaluate the
recursion for each token.

Rows: null or empty text is the end token alone.  Rows with a null id are scored but
not learned from.  Repeated rows are texts of their own.  Without training texts
every token is unknown and has P = 1.  Words are told apart by 64-bit hashes, contexts
by the numbers of their words (by a hash of them from 2**32 words on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .packing import groups, pack, pack_codes, rows_of, unpack, unpack_codes
from .words import mix


@dataclass(frozen=True)
class Params:
    top: int = 5  #: largest count with a Good-Turing discount
    tail: float = 0.5
    chunk_tokens: int = 1 << 20
    part_entries: int = 1 << 19  #: entries that a partition of a count table is sent, about


END = 1  #: the end token's hash


_CHUNK = [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("slice", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), ("n_train", pa.int64())]
_CHUNK_DDL = "chunk long, ids array<long>, train binary, sizes binary, codes binary, slice binary, words binary, counts binary, n_words long, n_pairs long, n_train long"


def _tokenise(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    ids: list = []
    train: list[bool] = []
    texts: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        tokens = np.concatenate(texts)
        found, code = _distinct(tokens)
        order = np.argsort(-np.bincount(code), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found, code = found[order], place[code]
        sizes = np.array([len(t) for t in texts])
        counts = np.bincount(code[np.repeat(np.array(train), sizes)], minlength=len(found))
        pairs = len(_distinct(code[:-1] * len(found) + code[1:])[0]) + len(texts)
        row = (at, ids, np.packbits(train).tobytes(), pack(sizes), pack_codes(code), pack(found >> np.uint64(48)), found.tobytes(), pack(counts), len(found), pairs, sum(train))
        return rows_of([row], _CHUNK)

    for batch in common.slices(batches, "text"):
        for doc, text, learn in zip(batch.column("doc_id"), words.each(batch.column("text")), batch.column("train"), strict=True):
            ids.append(doc.as_py())
            train.append(bool(learn.as_py()))
            texts.append(np.append(text, np.uint64(END)))
            held += len(texts[-1])
            if held >= p.chunk_tokens:
                yield out()
                at, held = at + 1, 0
                ids, train, texts = [], [], []
    if texts:
        yield out()


_ASK = [("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("weights", pa.binary()), ("counts", pa.binary())]
_ASK_DDL = "part long, chunk long, keys binary, more binary, weights binary, counts binary"
_TOLD = [("chunk", pa.int64()), ("part", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("totals", pa.list_(pa.int64()))]
_TOLD_DDL = "chunk long, part long, first binary, second binary, totals array<long>"


def _ask_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _each(batch):
            words, counts = np.frombuffer(row["words"], np.uint64), unpack(row["counts"])
            part = (words >> np.uint64(48)).astype(np.int64) % parts
            for k, at in groups(part):
                yield rows_of([(k, row["chunk"], words[at].tobytes(), None, None, pack(counts[at]))], _ASK)


def _count_words(key: tuple, table: pa.Table, parts: int) -> pa.Table:
    """Numbers (small for frequent words) and training counts of the words asked
    for; a row of chunk -1 with the partition's N, V and words."""
    asked = table.to_pylist()
    words = [np.frombuffer(r["keys"], np.uint64) for r in asked]
    found, where = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([unpack(r["counts"]) for r in asked]).astype(np.float64), minlength=len(found)).astype(np.int64)
    rank = np.empty(len(found), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(found))
    number = rank * parts + key[0].as_py() + 1
    ends = np.cumsum([0] + [len(w) for w in words])
    rows = [(r["chunk"], r["part"], pack(number[where[a:b]]), pack(counts[where[a:b]]), None) for r, a, b in zip(asked, ends[:-1], ends[1:], strict=True)]
    rows.append((-1, key[0].as_py(), None, None, [int(counts.sum()), int((counts > 0).sum()), len(found)]))
    return pa.Table.from_batches([rows_of(rows, _TOLD)])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order of their first place, and the number of each value."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: each holds a chunk."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _order(part: np.ndarray, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by part, id of the context and place."""
    n, rank = len(part), np.zeros(len(ids), np.int64)
    rank[context] = 1
    own = np.flatnonzero(rank)
    rank[own] = np.unique(ids[own], return_inverse=True)[1]
    wide, deep = len(own).bit_length(), n.bit_length()
    if n and int(part.max()).bit_length() + wide + deep > 62:
        return np.lexsort((rank[context], part))
    # one sort of numbers that end in the place is faster than a sort of places
    return np.sort((((part << wide) | rank[context]) << deep) | np.arange(n)) & ((1 << deep) - 1)


@dataclass
class _Grams:
    """The distinct n-grams of one order with a known context, of a chunk, in the order in
    which their partitions are asked for them."""

    of_token: np.ndarray  #: place of each token's n-gram, or -1
    context: np.ndarray  #: local number of the context
    ids: np.ndarray  #: of the context
    hot: np.ndarray  #: whether the context is split
    word: np.ndarray  #: local number of the last word
    part: np.ndarray
    suffix: np.ndarray  #: count of the n-gram without its first token
    train: np.ndarray  #: occurrences in the chunk's training texts


@dataclass
class _Chunk:
    """A chunk whose words have their numbers and counts."""

    sizes: np.ndarray
    train: np.ndarray  #: of each token
    code: np.ndarray
    number: np.ndarray  #: of each word; the start symbol, last, has 0
    count: np.ndarray

    @classmethod
    def of(cls, row: dict, parts: int, starts: int) -> _Chunk:
        sizes, part = unpack(row["sizes"]).astype(np.int64), unpack(row["slice"]).astype(np.int64) % parts
        number, count = np.zeros(len(part) + 1, np.int64), np.zeros(len(part) + 1, np.int64)
        told = {x["part"]: x for x in row["told"]}
        for k, at in groups(part):
            number[at], count[at] = unpack(told[k]["first"]), unpack(told[k]["second"])
        count[-1] = starts
        train = np.repeat(np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(sizes)).astype(bool), sizes)
        return cls(sizes, train, unpack_codes(row["codes"]), number, count)

    def bigrams(self, parts: int, limit: int) -> _Grams:
        before = np.empty_like(self.code)
        before[1:] = self.code[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = len(self.number) - 1
        return self._grams(before, self.count, self.number.astype(np.uint64), self.count[self.code], parts, limit)

    def trigrams(self, two: _Grams, count: np.ndarray, parts: int, limit: int, above: int) -> _Grams:
        """`count`: of the bigrams `two` over the corpus; word numbers are below `above`."""
        before = np.full(len(self.code), -1)
        before[1:] = two.of_token[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = -1
        ids = two.ids * np.uint64(above if above < 1 << 32 else 0x9E3779B97F4A7C15) + self.number[two.word].astype(np.uint64)
        suffix = np.where(two.of_token >= 0, np.append(count, 0)[two.of_token], 0)
        return self._grams(before, count, ids, suffix, parts, limit)

    def _grams(self, before: np.ndarray, count: np.ndarray, ids: np.ndarray, suffix: np.ndarray, parts: int, limit: int) -> _Grams:
        """`before`: each token's context or -1; `count` and `ids` are the contexts', `suffix`
        is that of the token's n-gram."""
        n = len(self.number)
        asked = np.flatnonzero((before >= 0) & (np.append(count, 0)[before] > 0))
        keys, where = _distinct(before[asked] * n + self.code[asked])
        context, word = keys // n, keys % n
        first = np.empty(len(keys), np.int64)
        first[where[::-1]] = asked[::-1]
        train = np.bincount(where[self.train[asked]], minlength=len(keys))
        pieces = np.where(count[context] > limit, count[context] // limit + 1, 1)
        piece = (mix(self.number[word].astype(np.uint64)) % pieces.astype(np.uint64)).astype(np.int64)
        part = ((mix(ids) >> np.uint64(32)).astype(np.int64)[context] + piece) % parts
        order = _order(part, context, ids)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        of_token = np.full(len(before), -1)
        of_token[asked] = place[where]
        context, word = context[order], word[order]
        return _Grams(of_token, context, ids[context], pieces[order] > 1, word, part[order], suffix[first[order]], train[order])


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.concatenate([[0], np.flatnonzero(np.diff(v)) + 1]) if len(v) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(v)))


def _ask(chunk: int, g: _Grams, number: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The n-grams for each partition: contexts (differences of their ids in order), how
    many n-grams each has and whether it is split, words, suffix and own counts."""
    for k, at in groups(g.part):
        start, length = _runs(g.ids[at])
        ids = g.ids[at][start]
        heads = pack(np.append(ids[:1], np.diff(ids)))
        keys = len(heads).to_bytes(8, "big") + heads + pack(length * 2 + g.hot[at][start])
        yield rows_of([(k, chunk, keys, pack(number[g.word[at]]), pack(g.suffix[at]), pack(g.train[at]))], _ASK)


def _asked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context ids, their n-grams' numbers, whether they are split."""
    end = 8 + int.from_bytes(row["keys"][:8], "big")
    length = unpack(row["keys"][end:]).astype(np.int64)
    return np.cumsum(unpack(row["keys"][8:end]), dtype=np.uint64), length >> 1, (length & 1).astype(bool)


def _figures(count: np.ndarray, own: np.ndarray, n: int, top: int) -> list[np.ndarray]:
    """For each of n owners: how many of its counts are 1 .. top, how many are larger, and
    the sum of these."""
    few, many = own[count <= top], own[count > top]
    table = np.bincount(few * top + count[count <= top] - 1, minlength=n * top).reshape(n, top).T
    return [*table, np.bincount(many, minlength=n), np.bincount(many, weights=count[count > top].astype(np.float64), minlength=n).astype(np.int64)]


def _count_grams(key: tuple, table: pa.Table, top: int, order: int) -> pa.Table:
    """Training counts of the n-grams asked for, doubled, and one more where all counts of
    the context are larger than `top`; for the contexts with an unseen n-gram, their place
    and figures: `_figures` of the counts, and of the suffixes (of bigrams: how many and
    their sum).  Rows of chunk -2 have the figures of a split context, one of chunk -1 the
    counts of counts."""
    asked = table.to_pylist()
    ids, sizes, hot = zip(*map(_asked, asked), strict=True)
    v_of, runs = _distinct(np.concatenate(ids))
    split = np.zeros(len(v_of), bool)
    split[runs] = np.concatenate(hot)
    v = np.repeat(runs, np.concatenate(sizes))
    w_of, w = _distinct(np.concatenate([unpack(r["more"]).astype(np.int64) for r in asked]))
    keys, where = _distinct(v.astype(np.int64) * len(w_of) + w)
    train = np.concatenate([unpack(r["counts"]) for r in asked]).astype(np.float64)
    count = np.bincount(where, weights=train, minlength=len(keys)).astype(np.int64)
    suffix = np.zeros(len(keys), np.int64)
    suffix[where] = np.concatenate([unpack(r["weights"]) for r in asked]).astype(np.int64)
    seen = np.flatnonzero(count)
    own, n = keys[seen] // len(w_of), len(v_of)
    below = _figures(suffix[seen], own, n, top) if order > 2 else [np.bincount(own, minlength=n), np.bincount(own, weights=suffix[seen].astype(np.float64), minlength=n).astype(np.int64)]
    figures = np.stack([*_figures(count[seen], own, n, top), *below])
    full = (figures[:top].sum(axis=0) == 0) & ~split
    rows, at, heads = [], 0, 0
    for r, size in zip(asked, sizes, strict=True):
        mine = slice(at, at + int(size.sum()))
        got = count[where[mine]]
        place = np.repeat(np.arange(len(size)), size)
        contexts = runs[heads : heads + len(size)]
        unseen = np.zeros(len(size), bool)
        unseen[place[got == 0]] = True
        unseen = np.flatnonzero(unseen & ~split[contexts])
        told = np.concatenate([[len(unseen)], unseen, figures[:, contexts[unseen]].reshape(-1)])
        rows.append((r["chunk"], r["part"], pack(got * 2 + full[v[mine]]), pack(told), None))
        at, heads = mine.stop, heads + len(size)
    rows += [(-2, r, None, None, [int(v_of[r : r + 1].view(np.int64)[0]), *figures[:, r].tolist()]) for r in np.flatnonzero(split)]
    rows.append((-1, key[0].as_py(), None, None, np.bincount(np.minimum(count[seen], top + 2), minlength=top + 3)[1 : top + 2].tolist()))
    return pa.Table.from_batches([rows_of(rows, _TOLD)])


def discounts(counts: np.ndarray, p: Params) -> np.ndarray:
    """d(1) .. d(top) from the numbers of n-grams that occur 1 .. top + 1 times."""
    r = np.arange(1, p.top + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = counts.astype(np.float64)
        common_ = (p.top + 1) * n[p.top] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common_) / (1 - common_)
    fine = np.isfinite(d) & (d > 0) & (d < 1)
    return np.where(fine, d, (r - p.tail) / r)


@dataclass
class _Told:
    """What a chunk knows of its n-grams of one order."""

    count: np.ndarray
    full: np.ndarray  #: of each n-gram: all counts of its context are larger than `top`
    backed: np.ndarray  #: the n-grams whose context has figures, one of each context
    figures: np.ndarray  #: of these contexts

    @classmethod
    def of(cls, g: _Grams, told: list[dict] | None, split: tuple[np.ndarray, np.ndarray], top: int) -> _Told:
        got = {x["part"]: x for x in told or []}
        count, backed, figures = np.zeros(len(g.word), np.int64), [], []
        for k, at in groups(g.part):
            count[at] = unpack(got[k]["first"])
            stats = unpack(got[k]["second"]).astype(np.int64)
            n = stats[0]
            backed.append(at[_runs(g.ids[at])[0][stats[1 : n + 1]]])
            figures.append(stats[n + 1 :].reshape(-1, n) if n else np.zeros((0, 0), np.int64))
        full = (count & 1).astype(bool)
        # the sums of split contexts
        ids, sums = split
        at = np.flatnonzero(g.hot)
        if len(at):
            place = np.searchsorted(ids, g.ids[at])
            full[at] = sums[:top].sum(axis=0)[place] == 0
            one = np.unique(g.context[at], return_index=True)[1]
            backed.append(at[one])
            figures.append(sums[:, place[one]])
        figures = [f for f in figures if f.size]
        return cls(count >> 1, full, np.concatenate([np.zeros(0, np.int64), *backed]), np.concatenate(figures, axis=1) if figures else np.zeros((0, 0), np.int64))


def _kept(figures: np.ndarray, full: np.ndarray, d: np.ndarray, p: Params) -> np.ndarray:
    """What the discounted counts of `_figures` add up to."""
    few = (d * np.arange(1, p.top + 1)) @ figures[: p.top]
    return few + figures[p.top + 1] - np.where(full, p.tail * figures[p.top], 0)


def _levels(row: dict, s: dict) -> tuple:
    """The chunk, its bigrams and what was told of them."""
    c = _Chunk.of(row, s["parts"], s["starts"])
    two = c.bigrams(s["parts2"], s["limit"])
    return c, two, (_Told.of(two, row["told2"], s["split2"], s["top"]) if "told2" in row else None)


def _ask_two(batches: Iterator[pa.RecordBatch], s: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _each(batch):
            c, two, _ = _levels(row, s)
            yield from _ask(row["chunk"], two, c.number)


def _ask_three(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    s = sent.value
    for batch in batches:
        for row in _each(batch):
            c, two, told = _levels(row, s)
            yield from _ask(row["chunk"], c.trigrams(two, told.count, s["parts3"], s["limit"], s["above"]), c.number)


def _discounted(g: _Grams, told: _Told, of_context: np.ndarray, d: np.ndarray, below: np.ndarray, alpha: np.ndarray, p: Params) -> np.ndarray:
    """log10 P of each token by its n-gram; `below` where that has no known context."""
    log, asked = below.copy(), g.of_token >= 0
    at = g.of_token[asked]
    r, context = told.count[at], g.context[at]
    kept = np.where(r > p.top, r - p.tail * told.full[at], (d * np.arange(1, p.top + 1))[np.clip(r, 1, p.top) - 1])
    log[asked] = np.where(r > 0, np.log10(kept / of_context[context]), alpha[context] + log[asked])
    return log


def _score(batches: Iterator[pa.RecordBatch], sent, n: int, v_all: int, d2: np.ndarray, d3: np.ndarray, p: Params) -> Iterator[pa.RecordBatch]:
    s, total = sent.value, float(n + v_all + 1)
    common.give_back()
    for batch in batches:
        for row in _each(batch):
            c, two, told2 = _levels(row, s)
            three = c.trigrams(two, told2.count, s["parts3"], s["limit"], s["above"])
            told3 = _Told.of(three, row["told3"], s["split3"], p.top)
            base = np.log10((c.count[:-1] + 1) / total)[c.code]

            alpha = np.zeros(len(c.number))  # log10 of each context's backoff weight
            if len(told2.backed):
                f, own = told2.figures, two.context[told2.backed]
                left = 1 - _kept(f, f[: p.top].sum(axis=0) == 0, d2, p) / c.count[own]
                alpha[own] = np.log10(left) - np.log10(1 - (f[-1] + f[-2]) / total)
            log = _discounted(two, told2, c.count, d2, base, alpha, p)

            alpha = np.zeros(len(two.word))
            if len(told3.backed):
                f, own = told3.figures, three.context[told3.backed]
                # the suffixes of a context's trigrams are bigrams of its last word, as is that of the token asked for
                token = np.empty(len(three.word), np.int64)
                token[three.of_token[three.of_token >= 0]] = np.flatnonzero(three.of_token >= 0)
                last = two.of_token[token[told3.backed]]
                below = _kept(f[p.top + 2 :], told2.full[last], d2, p) / c.count[two.context[last]]
                left = 1 - _kept(f, f[: p.top].sum(axis=0) == 0, d3, p) / told2.count[own]
                alpha[own] = np.log10(left) - np.log10(1 - below)
            log = _discounted(three, told3, told2.count, d3, log, alpha, p)

            begin = np.cumsum(c.sizes) - c.sizes
            known = np.add.reduceat((c.count[c.code] > 0).astype(np.int64), begin)
            yield pa.record_batch(
                [
                    pa.array(row["ids"], pa.int64()), pa.array(c.sizes), pa.array(known), pa.array(np.full(len(begin), n)),
                    pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(log, begin)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def _totals(told: DataFrame, n: int) -> np.ndarray:
    """The sums of the partitions' totals."""
    rows = told.where("chunk = -1").select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col")).collect()
    out = np.zeros(n, np.int64)
    for pos, total in rows:
        out[pos] = total
    return out


def _split(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, in order, and summed figures of the split contexts, at most 2**20."""
    rows = told.where("chunk = -2").select(F.element_at("totals", 1).alias("id"), F.posexplode(F.slice("totals", 2, 64)))
    sums = rows.groupBy("id", "pos").agg(F.sum("col").alias("n")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("f"))
    got = sums.select("id", F.col("f.n").alias("f")).collect()
    ids = np.array([r["id"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(ids)
    return ids[order], np.array([r["f"] for r in got], np.int64).reshape(len(got), -1).T[:, order] if got else np.zeros((0, 0), np.int64)


def _by_chunk(told: DataFrame, name: str) -> DataFrame:
    rows = told.where("chunk >= 0").groupBy("chunk")
    return rows.agg(F.collect_list(F.struct("part", "first", "second")).alias(name))


def score(docs: DataFrame, train, p: Params = Params()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row
    of `docs` (doc_id, text), learning from the rows where `train` holds."""
    spark, top = docs.sparkSession, p.top
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = common.stored(rows.mapInArrow(lambda b: _tokenise(b, p), _CHUNK_DDL), "chunks")
    n_words, n_pairs, starts = (x or 0 for x in chunks.agg(F.sum("n_words"), F.sum("n_pairs"), F.sum("n_train")).first())
    parts = min(1 << 16, n_words // p.part_entries + 1)

    asked = chunks.select("chunk", "words", "counts").mapInArrow(lambda b: _ask_words(b, parts), _ASK_DDL)
    words = common.stored(asked.groupBy("part").applyInArrow(lambda key, t: _count_words(key, t, parts), _TOLD_DDL), "unigrams")
    n, v_all, _ = (int(x) for x in _totals(words, 3))
    most = words.where("chunk = -1").agg(F.max(F.element_at("totals", 3))).first()[0] or 0
    s = {"parts": parts, "parts2": n_pairs // p.part_entries + 1, "starts": starts, "limit": max(p.part_entries, n >> 20), "top": top, "above": (most + 1) * parts + 1}
    s["parts3"] = 2 * s["parts2"]  # there are more trigrams

    counted = chunks.select("chunk", "ids", "train", "sizes", "codes", "slice").join(_by_chunk(words, "told"), "chunk")
    asked = counted.drop("ids").mapInArrow(lambda b: _ask_two(b, s), _ASK_DDL)
    two = common.stored(asked.groupBy("part").applyInArrow(lambda key, t: _count_grams(key, t, top, 2), _TOLD_DDL), "bigrams")
    d2 = discounts(_totals(two, top + 1), p)
    common.release(spark)

    sent = spark.sparkContext.broadcast(s | {"split2": _split(two)})
    counted = counted.join(_by_chunk(two, "told2"), "chunk", "left")
    asked = counted.drop("ids").mapInArrow(lambda b: _ask_three(b, sent), _ASK_DDL)
    three = common.stored(asked.groupBy("part").applyInArrow(lambda key, t: _count_grams(key, t, top, 3), _TOLD_DDL), "trigrams")
    d3 = discounts(_totals(three, top + 1), p)
    del asked
    common.release(spark)

    last = spark.sparkContext.broadcast(sent.value | {"split3": _split(three)})
    full = counted.join(_by_chunk(three, "told3"), "chunk", "left")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return full.mapInArrow(lambda b: _score(b, last, n, v_all, d2, d3, p), schema)


def op10_katz_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents`; rows with crc32(doc_id) mod 7 = 2 are held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, common.part_of(F.col("doc_id"), 7) != 2)
    held = F.coalesce(common.part_of(F.col("doc_id"), 7) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
