"""Nearest neighbours by inner product: multi-index hashing of learned binary codes.

Codes.  A vector x gets one more component, sqrt(M - x.x) with M the largest x.x of
the table, and a query gets a zero there; cosine order is then inner-product order.
`Params.rotations` rotations are learned on a bounded sample (`Params.sample` rows):
principal axes, then iterative quantisation; the signs of the rotated components
are the code.  The rows of the index are all coded, none is sampled.

Index.  Rows are packed to blocks of `Params.block`.  Within a block every byte of
the code is a substring with its own index: the rows in order of that byte.

Search.  If two codes of m substrings differ in at most r bits, one substring
differs in at most r div m.  A query probes, in each substring's index, the bytes
within that distance, and takes the rows whose whole code is within r.  r is
learned: the distance within which `Params.reach` of the sample's true neighbours
lie.  While a block has given fewer than k rows, r grows for it, up to all bits, so
every query gets k neighbours, or all candidates if there are fewer.  The rows
found are ranked by their inner product, summed in order in double precision.

Queries are packed to blocks too; each pair of a block of rows and one of queries
is a unit of work (a stated query set against all rows, in blocks), so nothing is
broadcast but the rotations, and no task holds more than two blocks.

Rows: vectors that are null, zero, or hold null or non-finite components, and rows
with a null id, take no part; neither do vectors whose length is not the most
frequent one (ties: the smaller).  Rows with the same id are candidates each by
itself; asked is the least of their vectors, and none of them is a candidate of its
own id.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


@dataclass(frozen=True)
class Params:
    k: int = 20
    rotations: int = 5
    sample: int = 4096  #: bound on the rows that rotations and radius are learned on
    sample_queries: int = 128
    reach: float = 0.99
    iterations: int = 15
    block: int = 8192
    query_block: int = 2048
    seed: int = 3


@dataclass
class Model:
    dim: int
    largest: float  #: largest squared length
    mean: np.ndarray
    rotation: np.ndarray  #: (dim + 1) x bits
    radius: int

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Packed codes, one byte for each substring."""
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.largest - (vectors * vectors).sum(axis=1), 0))
        wide = np.concatenate([vectors, last[:, None]], axis=1)
        return np.packbits((wide - self.mean) @ self.rotation > 0, axis=1)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the order of the components."""
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total += vectors[:, d] * query[d]
    return total


def learn(sample: np.ndarray, largest: float, p: Params) -> Model:
    rng = np.random.default_rng(p.seed)
    dim = sample.shape[1]
    last = np.sqrt(np.maximum(largest - (sample * sample).sum(axis=1), 0))
    wide = np.concatenate([sample, last[:, None]], axis=1)
    mean = wide.mean(axis=0)
    centred = wide - mean
    axes = np.linalg.svd(centred.T @ centred)[0][:, :dim]
    low = centred @ axes
    turns = []
    for _ in range(p.rotations):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(p.iterations):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        turns.append(axes @ turn)
    rotation = np.concatenate(turns, axis=1)
    rotation = np.concatenate([rotation, np.zeros((dim + 1, -rotation.shape[1] % 64))], axis=1)
    model = Model(dim, largest, mean, rotation, rotation.shape[1])
    asked = rng.permutation(len(sample))[: p.sample_queries]
    far = []
    codes, probes = model.codes(sample, False), model.codes(sample[asked], True)
    for i, code in zip(asked, probes, strict=True):
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argsort(-score)[: min(p.k, len(sample) - 1)]
        far += np.bitwise_count(codes[near] ^ code).sum(axis=1).tolist()
    if far:
        model.radius = int(np.quantile(far, p.reach))
    return model


def _pack(batches: Iterator[pa.RecordBatch], model, query: bool, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most `size` rows: ids, vectors and codes as bytes."""
    m = model.value
    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []

    def out(i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        cells = [i.astype(np.int64).tobytes(), v.tobytes(), m.codes(v, query).tobytes()]
        return pa.record_batch([pa.array([c], pa.binary()) for c in cells], names=["ids", "vectors", "codes"])

    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
        vectors.append(np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, m.dim))
        held += batch.num_rows
        while held >= size:
            i, v = np.concatenate(ids), np.concatenate(vectors)
            yield out(i[:size], v[:size])
            ids, vectors, held = [i[size:]], [v[size:]], held - size
    if held:
        yield out(np.concatenate(ids), np.concatenate(vectors))


class Block:
    """A block of rows with an index for each substring of their codes."""

    def __init__(self, ids: bytes, vectors: bytes, codes: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.codes = np.frombuffer(codes, np.uint8).reshape(len(self.ids), -1)
        self.words = self.codes.view(np.uint64)
        self.columns = np.ascontiguousarray(self.codes.T)
        self.order = [np.argsort(c, kind="stable") for c in self.columns]
        self.counts = [np.bincount(c, minlength=256) for c in self.columns]
        self.ends = [np.concatenate([[0], np.cumsum(n)]) for n in self.counts]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most `radius` bits."""
        near = radius // len(self.columns)
        if near >= 8:
            rows = np.arange(len(self.ids))
        else:
            hit, rest = np.zeros(len(self.ids), bool), np.arange(len(self.ids))
            for s, byte in enumerate(code):
                probed = _APART[byte] <= near
                if self.counts[s][probed].sum() * 4 < len(rest):
                    order, ends = self.order[s], self.ends[s]
                    for b in np.flatnonzero(probed):
                        hit[order[ends[b] : ends[b + 1]]] = True
                    rest = rest[~hit[rest]]
                else:  # most rows are in the probed buckets: ask each row for its own
                    own = probed[self.columns[s][rest]]
                    hit[rest[own]] = True
                    rest = rest[~own]
                if not len(rest):
                    break
            rows = np.flatnonzero(hit)
        apart = np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1)
        return rows[apart <= radius]

    def nearest(self, qid: int, query: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the rows found, other than the query's own."""
        bits, most = 8 * self.codes.shape[1], int((self.ids != qid).sum())
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != qid]
            if len(rows) >= min(k, most) or radius >= bits:
                break
            radius += max(1, bits // 16)
        score = products(self.vectors[rows], query)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


#: Differing bits of two bytes.
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _search(batches: Iterator[pa.RecordBatch], model, k: int) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["ids"], row["vectors"], row["codes"], m.dim)
            qids = np.frombuffer(row["q_ids"], np.int64)
            queries = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, m.dim)
            codes = np.frombuffer(row["q_codes"], np.uint8).reshape(len(qids), -1)
            out: list[list[np.ndarray]] = [[], [], []]
            for qid, query, code in zip(qids, queries, codes, strict=True):
                ids, score = block.nearest(qid, query, np.ascontiguousarray(code), m.radius, k)
                for column, got in zip(out, (np.full(len(ids), qid), ids, score), strict=True):
                    column.append(got)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = fine.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    size = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("v") == (size["n"] if size else -1))


def fit(rows: DataFrame, p: Params) -> Model | None:
    """Rotations and radius, from the rows whose hashed ids are smallest."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    largest = rows.agg(F.max(square)).first()[0]
    if largest is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(p.seed)), "vec_id", "v").limit(p.sample).select("v").toArrow()
    got = np.asarray(sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
    return learn(got.reshape(sample.num_rows, -1), float(largest), p)


def search(rows: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each query row of `rows`
    (vec_id, embedding)."""
    spark = rows.sparkSession
    fine = common.stored(usable(rows), "vectors")
    model = fit(fine, p)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent, k, row_size, q_size = spark.sparkContext.broadcast(model), p.k, p.block, p.query_block
    packed = "ids binary, vectors binary, codes binary"
    asked = fine.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts, q_parts = -(-fine.count() // row_size), max(1, -(-asked.count() // q_size))
    blocks = fine.repartition(parts).mapInArrow(lambda b: _pack(b, sent, False, row_size), packed)
    blocks = blocks.withColumn("_b", F.spark_partition_id()).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    asked = asked.repartition(q_parts).mapInArrow(lambda b: _pack(b, sent, True, q_size), packed)
    asked = asked.withColumn("_q", F.spark_partition_id()).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.select("_b", "_q", *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "codes")))
    units = blocks.join(asked, ["_b", "_q"]).drop("_b", "_q")
    found = units.mapInArrow(lambda b: _search(b, sent, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of `embeddings` to each row whose vec_id is divisible by 20."""
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 20 == 0)
