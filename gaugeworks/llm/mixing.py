"""Mixing sources to target weights with a low-discrepancy schedule.

DataFrame operations only.  Sizes are words.  The sources, by code point with
null last, get the weights of `Params.weights` in turn and share the total of all
sizes by weight; a target stops at `Params.most` times its source's size and the
excess is shared again by weight, until none is above.

1. Each source's documents are shuffled (hash of id and seed) and laid end to end
   on a line of words, which is cut into blocks of equal length B.
2. Slot t = 0, 1, ... of the mix goes to the source on whose stretch of the
   cumulative targets the van der Corput point of t lies (bits of t mirrored), so
   every stretch of the schedule follows the targets.
3. The slots of a source are ranked; rank r takes block r mod n of its n blocks,
   in pass r div n.  Slots of a pass beyond `Params.most` take nothing.
4. The slots are joined with the pieces of documents in their blocks.

A source gets its target within a few blocks, and B is the total / 2**18, within 1
and `Params.block`.  Ranks and running sums come from range partitions and their
totals, so no source has to fit one task; single-task windows see only one row
for each source or each partition.

Rows: a null or empty text has size 0 and is never taken.  Repeated rows and null
ids are rows like any other.  An empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: int = 3  #: passes over a source
    block: int = 4096  #: longest block, in words
    parts: int = 1 << 18  #: shorter blocks before the mix has fewer slots
    seed: int = 11


_BITS = 40  #: of a van der Corput point


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, str], tag: str) -> DataFrame:
    """`df` with, for each (name, column) of `sums`, the sum of the column over the
    rows of the group before the row.  The rows of a group are spread over range
    partitions; each adds the totals of those before it."""
    ranged = df.repartitionByRange(common.slots(df.sparkSession), group, *order)
    placed = common.stored(ranged.withColumn("_part", F.spark_partition_id()), tag)
    totals = placed.groupBy(group, "_part").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(group, "_part", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums))
    before = W.partitionBy(group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = placed.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()))
    joined = inside.join(offsets, [group, "_part"])
    return joined.select(*df.columns, *((F.col(n) + F.col(f"_t_{n}")).alias(n) for n in sums))


def targets(sizes: DataFrame, p: Params) -> DataFrame:
    """source_key, source_size, target, lo and hi (its stretch of the cumulative
    targets) of each source of `sizes` (source_key, size)."""
    spark = sizes.sparkSession
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source_key") == "n", "source_key")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in p.weights)), (rank % len(p.weights) + 1).cast("int"))
    sources = common.stored(by_source.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(float(p.most))), "sources")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while total:
        # sources whose share at this level is beyond their top stop there
        over = F.col("top") < F.lit(level) * F.col("weight")
        n, held, free = sources.agg(
            F.sum(over.cast("int")), F.sum(F.when(over, F.col("top")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - held) / free
    out = sources.withColumn("target", F.least("top", F.lit(level) * F.col("weight")))
    share = F.col("target") / F.lit(total or 1.0)
    order = W.orderBy(F.col("source_key") == "n", "source_key")
    cum = F.sum(share).over(order)
    return common.stored(out.withColumn("hi", cum).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))), "targets")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source_key, size of every row, written once: texts are read once."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return common.stored(docs.select("doc_id", key.alias("source_key"), size.alias("size")), "sizes")


@dataclass
class Mix:
    line: DataFrame  #: documents with their source's figures, row and start on its line
    schedule: DataFrame  #: slot, source_key, pass, block, row, from_word, n_words
    block: int


def mix(docs: DataFrame, p: Params = Params()) -> Mix:
    """The mix of `docs` (doc_id, text, source).  A row of the schedule takes the
    words from_word .. from_word + n_words - 1 of the document in that row."""
    spark = docs.sparkSession
    sizes = sized(docs)
    goal = targets(sizes, p)
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    block = max(1, min(p.block, total // p.parts))

    shuffled = sizes.withColumn("_place", F.xxhash64("doc_id", F.lit(p.seed))).withColumn("_one", F.lit(1))
    line = running(shuffled, "source_key", ["_place", "doc_id", "size"], {"start": "size", "row": "_one"}, "shuffled")
    line = common.stored(line.drop("_place", "_one").join(goal.select("source_key", "source_size", "target"), "source_key"), "line")

    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = line.where("size > 0").select("source_key", "row", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    head = F.greatest("start", F.col("block") * block)
    pieces = pieces.select(
        "source_key", "block", "row", (head - F.col("start")).alias("from_word"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - head).alias("n_words"),
    )

    n_slots = -(-total // block)
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), _BITS, "0")), 2, 10).cast("double") / float(1 << _BITS)
    points = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("x", point)
    cells = max(1024, 4 * goal.count())
    stretch = goal.where("hi > lo").select("source_key", "source_size", "lo", "hi")
    stretch = stretch.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    taken = points.withColumn("cell", F.floor(F.col("x") * cells)).join(stretch, "cell").where("x >= lo AND x < hi")
    taken = taken.select("slot", "source_key", "source_size").withColumn("_one", F.lit(1))
    ranked = running(taken, "source_key", ["slot"], {"rank": "_one"}, "slots")
    n_blocks = F.ceil(F.col("source_size") / block)
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / n_blocks)).withColumn("block", F.col("rank") % n_blocks)
    schedule = ranked.where(F.col("pass") < p.most).select("slot", "source_key", "pass", "block").join(pieces, ["source_key", "block"])
    return Mix(line, schedule, block)


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document of `documents`."""
    mixed = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = mixed.schedule.groupBy("source_key", "row").agg(F.sum("n_words").alias("taken"))
    return mixed.line.join(taken, ["source_key", "row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
