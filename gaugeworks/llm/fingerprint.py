"""Document fingerprints by consistent weighted sampling.

DataFrame operations only.  A document's terms are its words, A-Z and other
letters lower-cased, weighted by how often they occur.  For sample k every term
has r, c ~ Gamma(2, 1) and b ~ U(0, 1), the same in every document; with
t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1) the sample is the pair
(term, t) of the term with the least a.  Two documents agree on a sample with a
probability equal to the generalised Jaccard similarity of their weights, so the
share of equal samples estimates it.

A term is the 64-bit hash of its word; no two words are merged.  r, b and c are looked
up in three tables of `Params.features` rows (their size is fixed, so they are
broadcast), each at its own bits of the hash: two words may have one of the three in
common, but not the triple, unless 48 bits of their hashes are equal.

Order.  "Next" is by id, null first, rows of one id by the hash of their text.  Rows
of the same id and text are one key, counted.  Only keys are sorted (range partitions,
and the first key of the next one); texts are shuffled once, by key, and of the next
document only the part that is put in place of the end, cut to its length.  So neither
an outlying id nor many equal ids land in one task.

Rows: null text is the empty text.  A text without words has the empty
fingerprint; two of them have likeness 1, one and another text 0.  The only
document is its own next one.  Repeated rows are documents of their own; each but the
last is followed by its copy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


@dataclass(frozen=True)
class Params:
    samples: int = 64
    features: int = 1 << 16  #: rows of a table of variates, a power of two
    seed: int = 17


def _uniform(k: Column, which: int, p: Params) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64("feature", k, F.lit(which), F.lit(p.seed)), 11)
    return (bits.cast("double") + 1.0) / float(1 << 53)


def _gamma(k: Column, which: int, p: Params) -> Column:
    return -F.ln(_uniform(k, which, p) * _uniform(k, which + 1, p))


def variates(spark: SparkSession, name: str, p: Params) -> DataFrame:
    """{name}_at and the array `name` over the samples: r, b, or c (its logarithm)."""
    of = {"r": lambda k: _gamma(k, 0, p), "b": lambda k: _uniform(k, 2, p), "c": lambda k: F.ln(_gamma(k, 3, p))}[name]
    each = F.transform(F.sequence(F.lit(0), F.lit(p.samples - 1)), lambda k: of(k).cast("float"))
    return spark.range(p.features).select(F.col("id").cast("int").alias("feature")).select(F.col("feature").alias(f"{name}_at"), each.alias(name))


def term_weights(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, weight of each term of each row of `texts` (keys, t).  Counts
    are run lengths of the row's sorted terms: no shuffle, no hash table."""
    words = F.regexp_extract_all(F.lower("t"), F.lit(f"({common.WORD})"), F.lit(1))
    term = F.transform(words, lambda w: F.xxhash64(w))
    sorted_ = texts.select(*keys, F.sort_array(term).alias("f")).where(F.size("f") > 0)
    n = F.size("f")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("f", i - 1) != F.get("f", i)))
    runs = sorted_.select(*keys, "f", ends.alias("ends"))
    pairs = F.arrays_zip(F.col("ends").alias("to"), F.concat(F.array(F.lit(0)), F.col("ends")).alias("at"))
    runs = runs.select(*keys, "f", F.explode(F.slice(pairs, 1, F.size("ends"))).alias("run"))
    return runs.select(*keys, F.get("f", F.col("run.to") - 1).alias("term"), (F.col("run.to") - F.col("run.at")).alias("weight"))


_LOW = (1 << 32) - 1


def signatures(texts: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """keys, sig (array of one int for each sample) of the rows with a word."""
    spark, width = texts.sparkSession, p.features.bit_length() - 1
    terms = term_weights(texts, keys).withColumn("w", F.ln("weight")).withColumn("name", F.col("term").bitwiseAND(F.lit(_LOW)))
    for k, name in enumerate("rbc"):
        at = F.shiftrightunsigned("term", k * width).bitwiseAND(F.lit(p.features - 1)).cast("int")
        terms = terms.withColumn(f"{name}_at", at).join(F.broadcast(variates(spark, name, p)), f"{name}_at").drop(f"{name}_at")

    def least(k: int) -> Column:
        r, b, c = (F.get(x, F.lit(k)).cast("double") for x in "rbc")
        t = F.floor(F.col("w") / r + b)
        a = c - r * (t.cast("double") - b + 1.0)
        # the upper bits order by a, the lower 32 name the sample
        high = F.floor((F.greatest(F.least(a, F.lit(63.0)), F.lit(-63.0)) + 64.0) * float(1 << 24))
        return F.min(F.shiftleft(high, 32) + (F.col("name") + t * 0x9E3779B1).bitwiseAND(F.lit(_LOW)))

    least_of = terms.groupBy(*keys).agg(*(least(k).alias(f"m{k}") for k in range(p.samples)))
    low = [F.col(f"m{k}").bitwiseAND(F.lit(_LOW)) for k in range(p.samples)]
    return least_of.select(*keys, F.array(*(F.when(x > _LOW >> 1, x - (1 << 32)).otherwise(x).cast("int") for x in low)).alias("sig"))


def text_of(sig: Column) -> Column:
    """A signature as a string; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(_LOW))), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a).cast("double"))


#: A document's key: its id (0 if null), whether it has one, and the hash of its text.
_KEY = ["named", "id", "h"]


def keyed(docs: DataFrame) -> DataFrame:
    """The key, without nulls, and the text of each row."""
    named, number = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id"), F.lit(0))
    return docs.select(named.alias("named"), number.alias("id"), F.xxhash64("text").alias("h"), "text")


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in _KEY})


def in_order(rows: DataFrame) -> DataFrame:
    """Key, copies, n_chars and the key of the next document (next_named, next_id,
    next_h) of each distinct row of `rows` (key, text)."""
    keys = rows.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max(F.char_length("text").cast("long")).alias("n_chars"))
    ranged = keys.repartitionByRange(common.slots(rows.sparkSession), *_KEY)
    placed = common.stored(ranged.withColumn("part", F.spark_partition_id()), "keys")
    key = F.struct(*_KEY)
    # one row for each range partition
    parts = placed.groupBy("part").agg(F.min(key).alias("head"))
    everything = W.orderBy("part")
    heads = parts.select("part", F.coalesce(F.lead("head").over(everything), F.first("head").over(everything)).alias("ahead"))
    following = F.lead(key).over(W.partitionBy("part").orderBy(*_KEY))
    out = placed.withColumn("following", following).join(F.broadcast(heads), "part").withColumn("next", F.coalesce("following", "ahead"))
    return common.stored(out.select(*_KEY, "copies", "n_chars", *(F.col(f"next.{c}").alias(f"next_{c}") for c in _KEY)), "order")


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common.release(spark)
    order = in_order(keyed(docs))
    common.release(spark)  # before the driver builds the tables of variates
    cut = F.floor(F.col("n_chars") / 4).cast("int")

    # each distinct text once, at its key: the one exchange of texts, used twice
    texts = keyed(docs).groupBy(*_KEY).agg(F.first("text").alias("text"))
    asked = _renamed(order, "prev_").withColumnsRenamed({f"next_{c}": c for c in _KEY}).withColumn("cut", cut)
    heads = texts.join(asked, _KEY).select(*(F.col(f"prev_{c}").alias(c) for c in _KEY), "copies", "n_chars", "cut", F.substr("text", F.lit(1), "cut").alias("head"))
    ordered = texts.join(heads, _KEY)
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut"))
    edited, own = F.concat(kept, F.col("head")), F.concat(kept, F.substr("text", F.lit(1), F.col("cut")))
    ordered = ordered.withColumns({"edited": edited, "again": F.when(F.col("copies") > 1, own)})

    forms = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("t")) for k, c in enumerate(("text", "edited", "again"))))
    each = ordered.select(*_KEY, F.explode(forms).alias("x")).select(*_KEY, "x.kind", "x.t").where(F.col("t").isNotNull())
    sigs = signatures(each, [*_KEY, "kind"], p).groupBy(*_KEY)
    sigs = sigs.agg(*(F.max(F.when(F.col("kind") == k, F.col("sig"))).alias(n) for k, n in enumerate(("sig", "edited_sig", "again_sig"))))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rows = ordered.select(*_KEY, "n_chars", "copies", sha("edited").alias("edited_sha"), sha("again").alias("again_sha"))
    rows = common.stored(rows.join(sigs, _KEY, "left"), "signatures")
    common.release(spark)

    following = _renamed(rows.select(*_KEY, F.col("sig").alias("next_sig")), "next_")
    following = order.select(*_KEY, *(f"next_{c}" for c in _KEY)).join(following, [f"next_{c}" for c in _KEY]).select(*_KEY, "next_sig")
    rows = rows.join(following, _KEY)
    last = F.struct(F.col("edited_sha").alias("sha"), F.col("edited_sig").alias("other"), "next_sig")
    copy = F.struct(F.col("again_sha").alias("sha"), F.col("again_sig").alias("other"), F.col("sig").alias("next_sig"))
    each = F.concat(F.array(last), F.array_repeat(copy, (F.col("copies") - 1).cast("int")))
    rows = rows.select(F.when(F.col("named"), F.col("id")).alias("doc_id"), "n_chars", "sig", F.explode(each).alias("x"))
    sig, other, ahead = F.col("sig"), F.col("x.other"), F.col("x.next_sig")
    return rows.select(
        "doc_id", "n_chars", F.col("x.sha").alias("edited_sha256"), text_of(sig).alias("fingerprint"), text_of(other).alias("edited_fingerprint"),
        likeness(sig, other).alias("near_edited"), likeness(sig, ahead).alias("near_next"),
    )


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents` and of their edited texts."""
    return fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
