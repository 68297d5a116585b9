"""Similarity by compression."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import r4


#: Texts are dealt to so many parts; pairs of texts of two parts are one task's work.
PARTS = 8


def _cell(_key, pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """Distances of the pairs of one cell; each text is packed once."""
    body = dict(sorted(zip(texts["path"].to_pylist(), texts["content"].to_pylist(), strict=True), reverse=True))
    body = {k: v.encode() for k, v in body.items()}
    alone = {k: len(zlib.compress(v)) for k, v in body.items()}
    a, b, ncd = [], [], []
    for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        if x in body and y in body:
            a.append(x)
            b.append(y)
            ncd.append((len(zlib.compress(body[x] + body[y])) - min(alone[x], alone[y])) / max(alone[x], alone[y]))
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "ncd": pa.array(ncd, pa.float64())})


def distances(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """a, b, ncd: the normalised compression distance of the files of each pair.
    Pairs come from a cheaper candidate search.  Contents are not joined to the pairs: a
    text goes once to each cell of two parts where it has a pair, 2 * PARTS at most."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS))
    p = pairs.select("a", "b", (part("a") * PARTS + part("b")).alias("cell"))
    wanted = p.select("cell", F.explode(F.array("a", "b")).alias("path")).distinct()
    texts = wanted.join(files.select("path", F.coalesce("content", F.lit("")).alias("content")), "path").select(F.col("cell").alias("at"), "path", "content")
    d = p.groupBy("cell").cogroup(texts.groupBy("at")).applyInArrow(_cell, "a string, b string, ncd double")
    return d.select("a", "b", r4(F.col("ncd")).alias("ncd"))


def nearest(scored: DataFrame, n: int | None = None) -> DataFrame:
    """path, other, ncd, rank: each file's pairs, the closest first."""
    both = scored.select(F.col("a").alias("path"), F.col("b").alias("other"), "ncd").union(scored.select("b", "a", "ncd"))
    both = both.withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy("ncd", "other")).cast("long"))
    return both if n is None else both.where(F.col("rank") <= n)


def cross_file_density(files: DataFrame, chunk: int = 1 << 24) -> DataFrame:
    """density: deflated sizes of the files over that of all of them, joined by line feeds
    in order of their paths; 0 under two files.

    Deflate refers back 32 KB at most, so the joined text can be packed in stretches: it is
    cut, by running sizes, to chunks of about `chunk` bytes, and each is packed after its
    predecessor's last 32 KB, as a stream would be."""
    sized = files.select("path", F.encode("content", "UTF-8").alias("body")).withColumn("size", F.octet_length("body").cast("long") + 1)
    # running sizes over range partitions: the totals of those before are one row each
    ranged = sized.select("path", "size").repartitionByRange("path").withColumn("part", F.spark_partition_id())
    own = F.sum("size").over(W.partitionBy("part").orderBy("path"))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    start = ranged.withColumn("run", own).join(before, "part").select("path", (F.col("before") + F.col("run") - F.col("size")).alias("at"))
    placed = sized.join(start, "path").withColumn("chunk", F.floor(F.col("at") / chunk))
    # what the next chunk may refer back to
    tail = placed.select(F.explode(F.when(F.floor((F.col("at") + F.col("size") + (1 << 15)) / chunk) > F.col("chunk"), F.sequence(F.col("chunk"), F.floor((F.col("at") + F.col("size") + (1 << 15)) / chunk))).otherwise(F.array("chunk"))).alias("chunk"), "at", "size", "body")

    def pack(key, table):
        rows = sorted(zip(table["at"].to_pylist(), table["body"].to_pylist(), strict=True))
        mine = [(at, b) for at, b in rows if at // chunk == key[0].as_py()]
        seen = b"".join(b + b"\n" for at, b in rows if at // chunk < key[0].as_py())[-(1 << 15) :]
        packer = zlib.compressobj(zdict=seen) if seen else zlib.compressobj()
        packed = sum(len(packer.compress(b + b"\n")) for _, b in mine) + len(packer.flush(zlib.Z_SYNC_FLUSH))
        single = sum(len(zlib.compress(b)) for _, b in mine)
        return pa.table({"n": [len(mine)], "single": [single], "joined": [packed]})

    parts = tail.groupBy("chunk").applyInArrow(pack, "n long, single long, joined long")
    total = parts.agg(F.sum("n").alias("n"), F.sum("single").alias("single"), F.sum("joined").alias("joined"))
    return total.select(F.when(F.col("n") > 1, r4(F.col("single") / F.greatest("joined", F.lit(1)))).otherwise(0.0).alias("density"))
