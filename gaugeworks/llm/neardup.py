"""Near-duplicate documents: MinHash with tensored banding.

A document's set holds the hashes (64 bits) of its distinct word shingles.  Equal
sets form one class, which takes part once.

Tensored banding.  Two collections, A and B, hold `Params.tables` groups of
`Params.width` minhashes each.  Every pair (A_i, B_j) is a table key of
2 * width hashes, so tables**2 tables cost only 2 * tables * width minhash
functions.  A pair of similarity s meets in a table unless all A groups or all B
groups differ: a link at exactly 0.85 is missed with probability
2 * (1 - 0.85**3)**12 = 2e-5, one at 0.9 with 3e-7.  Group keys that only one
class has cannot make a table key that two classes have; they are dropped before
the pairs of groups are formed, so documents without any near copy cost two dozen
short rows and no more.

Verification, on full sets.  First every class is compared with one pivot of each
of its buckets, the class whose group keys most others have, and the confirmed
links are merged to components.  Pairs inside a component could add nothing.  The
classes of buckets that then lie in more than one component may still be linked
across.  Their members are put in one order, the rarest first: two sets that are
similar enough share one of their first members, and from the first common one on
there are enough members left on both sides.  The pairs across components for
which that holds, whatever their bucket, are compared; no other pair can be a link.
So a group of copies costs about as many comparisons as it has members, and none is
left out.

Rows: null or empty text -> no shingles, linked with nothing, its own component.
Fewer words than a shingle -> the whole sequence is its one shingle.  Rows with a
null id are linked with nothing (component null) and kept.  Rows that share an id
count as one document for reachability; each keeps its own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common, words
from .components import components
from .words import mix


@dataclass(frozen=True)
class Params:
    words: int = 5  #: words in a shingle
    percent: int = 80  #: least Jaccard similarity of a link
    tables: int = 12  #: groups in each of the two collections
    width: int = 3  #: minhashes in a group
    slice_shingles: int = 1 << 18  #: members of sets that a kernel holds at once, about
    broadcast_rows: int = 1 << 20  #: largest id table that is broadcast; beyond it a shuffled join


_ODD = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, in order; of the whole, if it is shorter."""
    return runs(words, np.array([0, len(words)]), size)[0]


def runs(flat: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many texts, one after the other, and the place of the first one
    of each text; `flat` and `at` are the words in the same form."""
    n = np.diff(at)
    total = np.full(len(flat), np.uint64(size), np.uint64)
    for k in range(min(size, len(flat))):
        total[: len(flat) - k] += flat[k:] * _ODD[k]
    for d in np.flatnonzero((n > 0) & (n < size)):
        total[at[d]] = (flat[at[d] : at[d + 1]] * _ODD[: n[d]]).sum() + np.uint64(n[d])
    whole = np.arange(len(flat)) - np.repeat(at[:-1], n) < np.repeat(np.maximum(n - size + 1, np.minimum(n, 1)), n)
    return mix(total[whole]), np.concatenate([[0], np.cumsum(np.maximum(n - size + 1, np.minimum(n, 1)))])


def sequences(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingles of each text, in order."""
    flat, at = runs(*words.hashes(texts), size)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield flat[a:b]


def _slices(batch: pa.RecordBatch, p: Params) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and shingle sets, in slices of bounded size."""
    rows, sets, total = [], [], 0
    for k, found in enumerate(sequences(batch.column("text"), p.words)):
        rows.append(k)
        sets.append(np.unique(found))
        total += len(sets[-1])
        if total >= p.slice_shingles:
            yield rows, sets
            rows, sets, total = [], [], 0
    if rows:
        yield rows, sets


def _lists(values: np.ndarray, each: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, each), pa.int32()), pa.array(values.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Set size, class and the two collections' group keys of each document."""
    import xxhash

    for batch in common.slices(batches, "text"):
        for rows, sets in _slices(batch, p):
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            keys = np.zeros((len(sets), 2 * p.tables), np.uint64)
            if len(full):
                flat = np.concatenate([sets[k] for k in full])
                starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                for g in range(2 * p.tables):
                    group = np.full(len(full), np.uint64(g + 1), np.uint64)
                    for w in range(p.width):
                        k = g * p.width + w
                        least = np.minimum.reduceat((flat ^ _ODD[k]) * _ODD[255 - k], starts)
                        group = mix(group * np.uint64(0x9E3779B97F4A7C15) + least)
                    keys[full, g] = group
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array(rows)).cast(pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(node, pa.binary()),
                    _lists(keys[:, : p.tables].reshape(-1).copy(), p.tables),
                    _lists(keys[:, p.tables :].reshape(-1).copy(), p.tables),
                ],
                names=["doc_id", "n_shingles", "node", "a", "b"],
            )


def _sets(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The sets of the rows that are of the class they are wanted for (rows that
    share an id may differ)."""
    import xxhash

    for batch in common.slices(batches, "text"):
        nodes = batch.column("node").to_pylist()
        for rows, sets in _slices(batch, p):
            own = [k for k, (r, s) in enumerate(zip(rows, sets, strict=True)) if xxhash.xxh3_128_digest(s.tobytes()) == nodes[r]]
            ends = np.cumsum([0] + [len(sets[k]) for k in own])
            flat = np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in own)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.record_batch([pa.array([nodes[rows[k]] for k in own], pa.binary()), lists], names=["node", "members"])


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose key more than one row has, and how many (held)."""
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "key")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, near) of the tensored tables, without keys that one node has
    alone.  near: how often other nodes have the node's group keys."""
    sides = [
        _shared(nodes.select("node", F.explode(c).alias("key"))).groupBy("node").agg(F.collect_list("key").alias(c), F.sum("held").alias(f"near_{c}"))
        for c in "ab"
    ]
    both = sides[0].join(sides[1], "node").join(nodes.select("node", "n"), "node").withColumn("near", F.col("near_a") + F.col("near_b"))
    pairs = both.select("node", "n", "near", F.explode("a").alias("ka"), "b").select("node", "n", "near", "ka", F.explode("b").alias("kb"))
    return _shared(pairs.select(F.xxhash64("ka", "kb").alias("key"), "node", "n", "near")).drop("held")


def _prefixes(placed: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(s, id, n, c, at): of each placed set, the rarest members in which it must
    share one with a set similar enough, and their places in the order by rarity."""
    members = placed.join(sets, "node").select("node", "n", "c", F.explode("members").alias("s"))
    rare = members.groupBy("s").agg(F.count("*").alias("df"))
    order = F.row_number().over(W.partitionBy("node").orderBy("df", "s"))
    # a link of n has n * percent / 100 members in common, or more
    return members.join(rare.where("df > 1"), "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", order).where(
        ((F.col("n") - F.col("at") + 1) * 100 >= F.col("n") * p.percent) & (F.col("df") > 1)
    )


def _across(prefixes: DataFrame, p: Params) -> DataFrame:
    """Pairs of sets of different components that may be similar enough: the members
    from their first common one on suffice on both sides."""
    x, y = (prefixes.select("s", *(F.col(k).alias(f"{k}{side}") for k in ("node", "n", "c", "at"))) for side in "xy")
    least = (F.col("nx") + F.col("ny")) * p.percent
    enough = [(F.col(f"n{k}") - F.col(f"at{k}") + 1) * (100 + p.percent) >= least for k in "xy"]
    both = x.join(y, (x["s"] == y["s"]) & (F.col("cx") < F.col("cy")) & enough[0] & enough[1])
    return both.select(F.col("nodex").alias("x"), F.col("nodey").alias("y")).distinct()


def _fits(p: Params):
    """The set sizes alone allow the similarity."""
    return F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * p.percent


def _links(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (x, y) that are similar enough, by their full sets."""
    x = sets.select(F.col("node").alias("x"), F.col("members").alias("sx"))
    y = sets.select(F.col("node").alias("y"), F.col("members").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(x, "x").join(y, "y").where(both * 100 >= (F.size("sx") + F.size("sy") - both) * p.percent).select("x", "y")


def small(ids: DataFrame, p: Params) -> DataFrame:
    """`ids`, broadcast if its size allows."""
    return F.broadcast(ids) if ids.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows else ids


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = common.stored(
        docs.mapInArrow(lambda b: _sign(b, p), "doc_id long, n_shingles long, node binary, a array<long>, b array<long>"), "signed"
    )
    alive = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = common.stored(
        alive.groupBy("node").agg(F.min("doc_id").alias("leader"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "nodes"
    )
    buckets = common.stored(_buckets(nodes), "buckets")

    pivot = buckets.groupBy("key").agg(F.max(F.struct("near", "node", "n")).alias("pivot"))
    starred = buckets.join(pivot, "key").select(
        F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pivot.node").alias("y"), F.col("pivot.n").alias("ny")
    )
    tested = common.stored(starred.where(F.col("x") != F.col("y")).where(_fits(p)).select("x", "y").distinct(), "stars")

    # every class of a bucket may be compared, so their sets are taken once
    wanted = buckets.select("node").distinct().join(nodes.select("node", "leader"), "node")
    by_id = small(common.stored(wanted, "wanted"), p)
    of_node = docs.join(by_id, docs["doc_id"] == by_id["leader"]).select("node", "text")
    raw = of_node.mapInArrow(lambda b: _sets(b, p), "node binary, members array<long>")
    sets = common.stored(raw, "sets")
    # rows of the same id and text have one set: its members are counted
    if not sets.groupBy("node").count().where("count > 1").isEmpty():
        repeated, sets = sets, common.stored(sets.dropDuplicates(["node"]), "sets")
        common.forget(repeated)
    names = nodes.select("node", "leader")
    common.release(docs.sparkSession)

    def by_leader(links: DataFrame) -> DataFrame:
        u, v = (names.select(F.col("node").alias(c), F.col("leader").alias(n)) for c, n in (("x", "u"), ("y", "v")))
        return links.join(u, "x").join(v, "y").select("u", "v")

    links = common.stored(by_leader(_links(tested, sets, p)), "links")
    first = components(links)
    common.release(docs.sparkSession)

    placed = buckets.join(names, "node").join(first.withColumnRenamed("id", "leader"), "leader", "left")
    placed = placed.select("key", "node", "n", F.coalesce("component", "leader").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    placed = placed.join(mixed, "key").select("node", "n", "c").distinct()
    across = _across(common.stored(_prefixes(placed, sets, p), "prefixes"), p)
    known = tested.unionByName(tested.select(F.col("y").alias("x"), F.col("x").alias("y")))
    rest = common.stored(across.join(known, ["x", "y"], "left_anti"), "rest")
    more = by_leader(_links(rest, sets, p))
    final = components(links.unionByName(more)).withColumnRenamed("id", "leader")

    of_class = names.join(final, "leader", "left").select("node", F.coalesce("component", "leader").alias("class_id"))
    out = signed.select("doc_id", "n_shingles", "node").join(of_class, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of `documents`: 3-word shingles, similarity 0.85."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), Params(words=3, percent=85))


def sql() -> str:
    """The query in DuckDB's SQL: all pairs that share a shingle, and reachability."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{common.WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) FOR i IN range(1, len(w) - 1)]) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id)
SELECT doc_id, any_value(len(g))::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN r ON r.id = doc_id GROUP BY doc_id"""
