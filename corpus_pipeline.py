"""The corpus pipeline: every stage works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
`documents`; the last returns the encoded corpus.  No stage drops, caps or samples
rows but for its own decision, and none of them reads another table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugeworks.llm import bpe, common, langid, mixing, neardup, surrogates

#: SQL has neither the learned model nor the keyed surrogates of the first stages.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others are unchanged."""
    common.relieve(spark)
    model = langid.learn(docs, F.lit(True))
    return langid.identify(docs, model).where(~F.col("lang_rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: its least id.  Of rows
    that share an id, the one with the least text stays; rows without an id stay."""
    common.relieve(spark)
    classes = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = common.stored(classes.where("NOT kept").select("doc_id").distinct(), "gone")
    kept = docs.join(neardup.small(gone, neardup.Params()), "doc_id", "left_anti").select(*docs.columns)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if ids.isEmpty():
        return kept
    again = W.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    first = kept.withColumn("_again", F.row_number().over(again)).where("doc_id IS NULL OR _again = 1")
    return first.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text."""
    common.relieve(spark)
    clean = surrogates.replace(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each row is what one pass takes of a document, whole
    or cut at the end of the pass; documents without words are not taken."""
    common.relieve(spark)
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    same = ["_id", "_source", "_size"]  # rows that share these are told apart by their order
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select("*", number.alias("_id"), source.alias("_source"), size.alias("_size")).where("_size > 0")
    keyed = keyed.withColumn("_copy", F.row_number().over(W.partitionBy(*same).orderBy("text")))
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    taken = mixed.schedule.groupBy("source_key", "row", "pass").agg(F.sum("n_words").alias("n_words")).groupBy("source_key", "row")
    taken = taken.agg(F.sort_array(F.collect_list("n_words"), asc=False).alias("passes"))
    line = mixed.line.where("size > 0").select(number.alias("_id"), F.col("source_key").alias("_source"), F.col("size").alias("_size"), "source_key", "row")
    line = line.join(taken, ["source_key", "row"], "left")
    lists = line.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("row", "passes"))).alias("_lists"))
    rows = keyed.join(lists, same).withColumn("_n", F.explode(F.get("_lists", F.col("_copy") - 1)["passes"]))
    words = F.regexp_extract_all("text", F.lit(f"({common.WORD})"), F.lit(1))
    text = F.when(F.col("_n") >= F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_n").cast("int")), " "))
    out = rows.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of tokens and digests of ids and decoded text."""
    common.relieve(spark)
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.production())


STAGES = [
    ("language identification", language),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", mix),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = common.stored(docs, name.split()[0].lower())
    return docs
