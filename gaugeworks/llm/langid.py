"""Language identification with averaged hashed subword embeddings.

Every character n-gram of a lower-cased word (word edges count as a character)
is hashed to a row of an embedding matrix; a text is the mean of its rows, and a
linear softmax turns that mean into language probabilities.  Both matrices are
trained by mini-batch stochastic gradient descent in numpy on a bounded,
documented sample of labelled rows (`Params.train_rows`).  A quarter of that
sample is held back: it sets the softmax temperature and the rejection
threshold, the confidence that all but `Params.reject_rate` of the correctly
classified held-back texts reach, though a half at most.

Since the softmax input is linear in the mean, prediction uses the product of
the two matrices: one row of language scores for each hash bucket.

Rows: text null or without letters -> ``und``, score 0, rejected.  Without any
labelled row nothing can be learned and every text is ``und``.  Ties between
languages go to the first by code point.  Repeated rows and null ids are scored
like any other; rows with a null id are never learned from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    train_rows: int = 2000  #: bound on the labelled rows that are learned from
    buckets: int = 1 << 14
    dim: int = 8
    n_min: int = 1
    n_max: int = 4
    steps: int = 700  #: of gradient descent, at least; whole passes are made
    batch: int = 32
    rate: float = 4.0
    seed: int = 7
    reject_rate: float = 0.002
    slice_chars: int = 1 << 18  #: characters hashed at once; texts may be longer


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  #: buckets x languages, divided by the temperature
    bias: np.ndarray
    threshold: float
    params: Params = field(default_factory=Params)


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash buckets, index of the text of each), slice by slice over whole texts."""
    low = [f" {t.lower()} " for t in texts]  # a text's word edges are its own
    starts = np.cumsum([0] + [len(t) for t in low])
    joined = "".join(low)
    letters = _letters()
    for at in range(0, len(joined), p.slice_chars):
        end = min(len(joined), at + p.slice_chars)
        head = 1 if at else 0  # one character before, for the word edge
        part = joined[at - head : end + p.n_max]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[np.minimum(code, 0x10FFFF)]
        code = np.where(is_letter, code, 32).astype(np.uint64)
        own = np.searchsorted(starts, np.arange(at, end), side="right") - 1
        n_all = end - at
        # a gram starts in the slice; blanks may only be its first or last character
        hashed = np.zeros(len(code), np.uint64)
        letters_only = np.ones(len(code), bool)
        for n in range(1, p.n_max + 1):
            size = len(code) - n + 1
            if size <= 0:
                break
            hashed = hashed[:size] * np.uint64(0x100000001B3) + code[n - 1 :]
            if n >= 3:
                letters_only = letters_only[:size] & is_letter[n - 2 : n - 2 + size]
            else:
                letters_only = letters_only[:size]
            if n < p.n_min:
                continue
            ok = letters_only & (is_letter[:size] | is_letter[n - 1 :])
            if n == 1:
                ok = is_letter.copy()
            ok = ok[head : head + n_all]
            pos = np.flatnonzero(ok)
            h = hashed[head : head + n_all][pos] + np.uint64(n)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield (h >> np.uint64(40)).astype(np.int64) % p.buckets, own[pos]


def _featurize(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for bucket, own in grams(texts, p):
            key, count = np.unique(own * p.buckets + bucket, return_counts=True)
            doc = key // p.buckets
            for d in np.unique(doc):
                a, b = np.searchsorted(doc, (d, d + 1))
                found[d].append(np.stack([key[a:b] % p.buckets, count[a:b]]))
        ids, counts = [], []
        for rows in found:
            pairs = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), np.int64)
            total = np.bincount(pairs[0], weights=pairs[1], minlength=1)
            ids.append(np.flatnonzero(total).astype(np.int32))
            counts.append(total[ids[-1]].astype(np.float32))
        yield pa.record_batch(
            [batch.column("lang").cast(pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
            names=["lang", "ids", "counts"],
        )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], p: Params) -> Model:
    """Trains on (language, buckets, counts); texts without letters are left out."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((p.buckets, 0), np.float32), np.zeros(0, np.float32), 0.0, p)
    y = np.array([langs.index(r[0]) for r in rows])
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(rows))
    back = order[: len(rows) // 4] if len(rows) >= 40 else order
    use = order[len(rows) // 4 :] if len(rows) >= 40 else order
    emb = rng.normal(0, 0.1, (p.buckets, p.dim))
    out = np.zeros((len(langs), p.dim))
    bias = np.zeros(len(langs))

    def mean(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b = np.concatenate([rows[i][1] for i in chosen])
        w = np.concatenate([rows[i][2] / rows[i][2].sum() for i in chosen]).astype(np.float64)
        lens = np.array([len(rows[i][1]) for i in chosen])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        return b, w, np.repeat(np.arange(len(chosen)), lens), np.add.reduceat(emb[b] * w[:, None], starts, axis=0)

    batches = -(-len(use) // p.batch)
    steps = -(-p.steps // batches) * batches
    step = 0
    while step < steps:
        mixed = rng.permutation(use)
        for at in range(0, len(mixed), p.batch):
            chosen = mixed[at : at + p.batch]
            rate = p.rate * (1 - step / steps)
            step += 1
            b, w, doc, v = mean(chosen)
            g = _softmax(v @ out.T + bias)
            g[np.arange(len(chosen)), y[chosen]] -= 1
            g /= len(chosen)
            back_v = g @ out
            out -= rate * (g.T @ v)
            bias -= 0.1 * rate * g.sum(axis=0)
            push = back_v[doc] * w[:, None]
            for k in range(p.dim):
                emb[:, k] -= rate * np.bincount(b, weights=push[:, k], minlength=p.buckets)

    z = mean(back)[3] @ out.T + bias
    heats = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(back)), y[back]], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(losses))])
    prob = _softmax(z / heat)
    sure = np.sort(prob.max(axis=1)[prob.argmax(axis=1) == y[back]])
    threshold = float(sure[int(p.reject_rate * len(sure))]) * 0.98 if len(sure) else 0.0
    return Model(langs, (emb @ out.T / heat).astype(np.float32), (bias / heat).astype(np.float32), min(threshold, 0.5), p)


def predict(texts: list[str | None], m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and rejection of each text."""
    k = len(m.langs)
    total, n = np.zeros((len(texts), k)), np.zeros(len(texts))
    if k:
        for bucket, own in grams([t or "" for t in texts], m.params):
            if len(own):
                cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                total[own[cut]] += np.add.reduceat(m.table[bucket], cut, axis=0, dtype=np.float64)
                n[own[cut]] += np.diff(np.concatenate([cut, [len(own)]]))
    known = n > 0
    score = np.zeros(len(texts))
    best = np.zeros(len(texts), np.int64)
    if known.any():
        prob = _softmax(total[known] / n[known][:, None] + m.bias)
        best[known], score[known] = prob.argmax(axis=1), prob.max(axis=1)
    lang = [m.langs[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
    return lang, score, ~known | (score < m.threshold)


def learn(docs: DataFrame, usable: Column, p: Params = Params()) -> Model:
    """Fits on at most `p.train_rows` of the `usable` rows with text, lang and id:
    those whose hashed ids are smallest, so the sample depends on nothing else.
    Only hashed counts of these rows come to the driver."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    place = F.xxhash64(F.col("doc_id"), F.lit(p.seed))
    last = rows.select(place.alias("at")).orderBy("at").limit(p.train_rows).agg(F.max("at")).first()[0]
    if last is None:
        return fit([], p)
    sample = (
        rows.where(place <= F.lit(last))
        .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda batches: _featurize(batches, p), "lang string, ids array<int>, counts array<float>")
        .limit(p.train_rows)
        .toArrow()
    )
    got = zip(sample["lang"].to_pylist(), sample["ids"], sample["counts"], strict=True)
    found = [(lang, np.asarray(i.values, np.int32), np.asarray(c.values, np.float32)) for lang, i, c in got]
    digest = lambda r: hashlib.blake2b(r[1].tobytes() + r[2].tobytes(), digest_size=16).digest()
    return fit(sorted(found, key=lambda r: (r[0], digest(r))), p)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with lang_pred, lang_score and lang_rejected appended
    (same-named columns of `docs` are replaced).  One narrow pass, no shuffle."""
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_rejected")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in common.slices(batches, "text"):
            lang, score, rejected = predict(batch.column("text").to_pylist(), m)
            extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(run, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every text of `documents`; rows with crc32(doc_id) mod 4 = 2 are
    held out of training."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = common.part_of(F.col("doc_id"), 4)
    model = learn(docs, part != 2)
    held = docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text")
    return identify(held, model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )
