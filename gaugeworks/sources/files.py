"""Files as a source, and results as JSON and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators import metrics


#: Globs that a scan leaves out.
IGNORED = ("**/*.md", "**/*.mdx")


def extension(path: Column) -> Column:
    """Lower-case extension, or the whole name where there is none."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"\.([^.]+)$", 1)
    return F.when(ext == "", base).otherwise(F.lower(ext))


def scanned(path: Column, ignore: list[str] = (), extensions: list[str] | None = None) -> Column:
    """A scan takes the path: known extension, no skipped or hidden folder or file on
    the way, no glob of `ignore` that fits."""
    known = [e for e in extensions or vocab.language_of()]
    known += [e.lower() for e in known]
    skipped = "|".join(x.replace(".", r"\.") for x in vocab.SKIPPED)
    hidden = path.rlike(rf"(^|/)(\.[^/]*|({skipped})(?=/))")
    return extension(path).isin(*dict.fromkeys(known)) & ~hidden & ~X.ignored(path, list(ignore))


def scan(spark: SparkSession, root: str, ignore: list[str] = IGNORED, extensions: list[str] | None = None) -> DataFrame:
    """path (below root), content, language of the files below a folder.  Paths are
    filtered before contents are decoded; bytes that aren't UTF-8 become marks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^.*{X._quoted(root.rstrip('/').rsplit('/', 1)[-1])}/", "")
    d = found.withColumn("path", path).where(scanned(F.col("path"), list(ignore), extensions))
    return d.select("path", F.decode("content", "UTF-8").alias("content"), X.language(F.col("path")).alias("language"))


def write_analysis(files: DataFrame, figures: DataFrame, aggregate: DataFrame, path: str, with_files: bool = False) -> None:
    """Folders below `path`: metadata (files, bytes, time, version), codebase, and, if asked
    for, one object for each file with its figures by metric."""
    meta = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("total_bytes"))
    meta.withColumns({"timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "version": F.lit("1")}).write.mode("overwrite").json(f"{path}/metadata")
    write_report(aggregate, f"{path}/codebase")
    if with_files:
        rows = figures.groupBy("path", "metric").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("figures"))
        rows = rows.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("metric", "figures"))).alias("metrics"))
        sizes = files.select("path", F.octet_length("content").alias("bytes"), F.size(X.lines(F.col("content"))).alias("lines"))
        rows.join(sizes, "path").write.mode("overwrite").json(f"{path}/files")


def write_report(aggregate: DataFrame, path: str) -> None:
    """One JSON object for each metric: key -> mean, std, min, max."""
    figures = F.struct("mean", "std", "min", "max")
    rows = aggregate.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("key", figures))).alias("figures"))
    rows.write.mode("overwrite").json(path)


def write_history(history: DataFrame, path: str) -> None:
    """Aggregates of snapshots, a folder for each."""
    history.write.mode("overwrite").partitionBy("snapshot").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    schema = "metric string, key string, mean double, std double, min double, max double, snapshot string"
    return spark.read.schema(schema).json(path)


def cached_metrics(files: DataFrame, store: str, names: list[str] | None = None) -> DataFrame:
    """File metrics by way of a store of results, keyed by the digest of the content:
    only contents that the store doesn't have are computed, each once."""
    spark = files.sparkSession
    keyed = files.select("path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    schema = "digest string, metric string, key string, value double"
    try:
        known = spark.read.schema(schema).parquet(store)
        known.limit(1).count()
    except Exception as e:  # the store doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], schema)
    new = keyed.join(known.select("digest").distinct(), "digest", "left_anti").dropDuplicates(["digest"])
    fresh = metrics.file_metrics(new.select(F.col("digest").alias("path"), "content"), names).withColumnRenamed("path", "digest")
    fresh.write.mode("append").parquet(store)
    return keyed.select("path", "digest").join(spark.read.schema(schema).parquet(store), "digest").select("path", "metric", "key", "value")
