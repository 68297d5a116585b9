"""Helpers shared by the operators of this subpackage.

Scratch tables
    Lineage is cut by writing Parquet below the shared folder that the cluster
    names in ``spark.checkpoint.dir``; only where that setting is absent (local
    tests, local master only) a temporary folder of this process is used.

Shipping code
    Python kernels are pickled by value, so executors need only numpy and
    pyarrow, not this package.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: What the contracts call a word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="gaugeworks-"))
    return _own[0]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to a fresh shared table and read back: later stages and
    retries after a lost executor start from these files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/gaugeworks/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a `stored` table that nothing reads any more."""
    path, spark = getattr(df, "_stored_at", None), df.sparkSession
    if path:
        jvm, jsc = spark._jvm, spark._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets the driver's garbage collector find the shuffles that nothing refers to any
    more, so that their files go before the next step writes its own.  The memory that
    this and native code gave up goes back to the system."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def relieve(spark: SparkSession) -> None:
    """`release`, and the JVM of each executor collects its garbage too: after that it gives
    the heap that it does not need back to the system, and otherwise keeps the most that
    any step has needed.  One task for each core, so that every idle executor gets some."""
    release(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def trim(spark: SparkSession) -> str | None:
    """Has the driver's JVM give unused native memory back to the system, as its command
    System.trim_native_heap does; None where it has none.  Without this each plan leaves
    the driver a little larger, whatever the input."""
    of = spark._jvm.java.lang.Class.forName
    array, objects = spark.sparkContext._gateway.new_array, spark._jvm.java.lang.Object
    types, args = array(spark._jvm.java.lang.Class, 4), array(objects, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[k] = of(name)
    args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    beans = spark._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:  # by the interface: the class of the server is not exported
        return of("javax.management.MBeanServer").getMethod("invoke", types).invoke(beans, args)
    except Py4JError:
        return None


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_of(column, modulus: int):
    """crc32 of a value's text, modulo `modulus` (null for a null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


#: Bytes of text that a kernel works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of a string column, whatever the
    length of its rows; no empty ones."""
    import pyarrow.compute as pc

    give_back()
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for k, n in enumerate(size.tolist()):
            if held and held + n > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)
    give_back()


def give_back() -> None:
    """Returns memory that earlier tasks of this worker no longer use to the system: workers
    are reused, and would otherwise keep the most that any of them has needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
