"""Pairs of similar texts by shared shingles.

Shingles are 64-bit hashes of runs of words.  Texts with the same shingles are one
class, compared once.  Classes are paired by prefixes: in one order, the rarest
shingles first, two sets that are similar enough share one of the first members of
each, as many as could be missing from the other and one more.  So frequent shingles
pair nothing as long as a text has others, and no pair is lost; the pairs found are
compared on their full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import r4
from . import folds


def shingled(files: DataFrame, k: int = 5) -> DataFrame:
    """path, grams: the distinct k-grams of a file's words, as hashes in order."""
    return files.select("path", folds.shingles(k)(F.lower("content")).alias("grams"))


def exact_classes(files: DataFrame) -> DataFrame:
    """path, class (least path with the same text), copies."""
    w = files.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("h")).agg(F.min("path").alias("class"), F.count("*").alias("copies"))
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("h")).join(w, "h").select("path", "class", "copies")


def _same(grams: DataFrame) -> DataFrame:
    """`grams` of the files with shingles, with `same`: equal for equal shingles."""
    return grams.where(F.size("grams") > 0).withColumn("same", F.struct(F.xxhash64("grams").alias("x"), F.hash("grams").alias("h"), F.size("grams").alias("n")))


def classes(grams: DataFrame) -> DataFrame:
    """class (least path), grams, of the files with equal shingles; none without."""
    s = _same(grams)
    least = s.groupBy("same").agg(F.min("path").alias("path"))  # the sets themselves are not dealt out
    return s.join(least, ["same", "path"]).select(F.col("path").alias("class"), "grams")


def jaccard_pairs(grams: DataFrame, least: float = 0.2, most: int | None = None) -> DataFrame:
    """a, b, shared, jaccard of the classes whose shingle sets reach the similarity.
    Shingles of more than `most` classes pair nothing; without it no pair is lost.

    Shingles of one class only are dropped where they are counted: they are the first of
    their class, so the places of the others follow from how many these are."""
    c = classes(grams)
    sides = c.select(F.xxhash64("class").alias("id"), "class", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    shared = sides.select("id", "n", "g").withColumn("df", F.count("*").over(W.partitionBy("g"))).where("df > 1")
    if most is not None:
        shared = shared.where(F.col("df") <= most)
    # ties by dense rank: a path that two equal files have counts once
    own = W.partitionBy("id")
    ranked = shared.withColumn("k", F.dense_rank().over(own.orderBy("df", "g")))
    ranked = ranked.withColumn("at", F.col("n") - F.max("k").over(own) + F.col("k"))
    first = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    a, b = (first.select("g", F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("at").alias(f"at_{k}")) for k in "ab")
    # neither the sizes nor the members after this one rule the pair out
    possible = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    d = a.join(b, "g").where("a < b").where(possible & (rest + F.least("at_a", "at_b") - 1 >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-9))
    d = d.select("a", "b").distinct()
    of = lambda k: c.select(F.xxhash64("class").alias(k), F.col("class").alias(f"class_{k}"), F.col("grams").alias(f"grams_{k}"))
    d = d.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("grams_a", "grams_b")).cast("long"))
    d = d.withColumn("j", F.col("shared") / (F.size("grams_a") + F.size("grams_b") - F.col("shared"))).where(F.col("j") >= least)
    return d.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "shared", r4(F.col("j")).alias("jaccard")).distinct()


def text_pairs(files: DataFrame, k: int = 5, least: float = 0.2) -> DataFrame:
    """a, b: every two different texts whose shingle sets reach the similarity, those with
    equal sets too, by their least paths (`exact_classes`); and each copy with the least path
    of its text, which no other pair of copies adds to."""
    exact = exact_classes(files)
    copies = exact.where("path <> class").select(F.col("class").alias("a"), F.col("path").alias("b")).distinct()
    texts = exact.where("path = class").select("path").distinct()
    grams = shingled(files, k)  # of all files: what has to be dealt out are paths, not contents
    s = _same(grams).select("path", "same").join(texts, "path", "left_semi").distinct()
    least_of = s.groupBy("same").agg(F.min("path").alias("set"), F.count("*").alias("n"))
    members = s.join(least_of, "same").select("set", "path", "n")
    a, b = (members.select(F.col("set").alias(f"set_{x}"), F.col("path").alias(x), "n") for x in "ab")
    equal = a.where("n > 1").join(b.where("n > 1"), F.col("set_a") == F.col("set_b")).where("a < b").select("a", "b")
    pairs = jaccard_pairs(grams, least).select(F.col("a").alias("set_a"), F.col("b").alias("set_b"))
    other = pairs.join(a.drop("n"), "set_a").join(b.drop("n"), "set_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(other).unionByName(copies)


def contained(probes: DataFrame, files: DataFrame, k: int = 8, least: float = 0.5) -> DataFrame:
    """item, path, shared, share: files that hold at least this share of a probe's
    shingles (probes: item, content)."""
    p = shingled(probes.withColumnRenamed("item", "path"), k).select(F.col("path").alias("item"), F.col("grams").alias("g"))
    p = p.select("item", F.size("g").alias("n"), F.explode("g").alias("g"))
    f = shingled(files, k).select("path", F.explode("grams").alias("g"))
    d = f.join(p, "g").groupBy("item", "path", "n").agg(F.count("*").alias("shared"))
    return d.where(F.col("shared") >= least * F.col("n")).select("item", "path", "shared", r4(F.col("shared") / F.col("n")).alias("share"))


def bucket(distance: Column, least: Column) -> Column:
    """Band of an edit distance, relative to the shorter length; null beyond a half."""
    share = distance / F.nullif(least, F.lit(0))
    out = F.when(least == 0, F.lit(None).cast("long")).when(distance == 0, 0)
    for k, top in enumerate((0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50), 1):
        out = out.when(share <= top, k)
    return out.cast("long")


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The n first pairs of each bucket, and how many the bucket has."""
    w = W.partitionBy("bucket")
    return pairs.withColumns({"in_bucket": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("a", "b")).cast("long")}).where(F.col("rank") <= n)
