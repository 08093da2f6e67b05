"""What the corpus operators share: the shared folder, staged tables and batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.store import scratch

#: Words are runs of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def cleaned(spark: SparkSession, ordered: bool = False, batch_bytes: int = 0) -> Iterator[None]:
    """While a table is written: shuffle files go as soon as it ends, plans with long literals are printed in short; with
    ordered, sorted bucket files are taken as sorted; with batch_bytes, Python gets no more at once."""
    wanted = {CLEANUP: "true", "spark.sql.maxPlanStringLength": "65536"} | ({ORDERED: "true"} if ordered else {}) | ({BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, name: str, ordered: bool = False, batch_bytes: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    The shuffle files of the write go as soon as it ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with cleaned(spark, ordered, batch_bytes):
        df.write.parquet(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give back the memory of this Python process that nobody holds any more."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Give back the driver's memory that nobody holds any more now rather than at some later collection: Python's, the
    heap's, which shrinks to what is in use (a collection by itself leaves it over three times that), and the JVM's other."""
    gc.collect()
    trim()
    jvm = spark.sparkContext._jvm
    management = jvm.java.lang.management.ManagementFactory
    array = spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):  # other JVMs than HotSpot have no such options or commands
        hotspot = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        options = management.getPlatformMXBean(hotspot)
        before = {k: options.getVMOption(k).getValue() for k in ("MinHeapFreeRatio", "MaxHeapFreeRatio")}
        try:
            options.setVMOption("MinHeapFreeRatio", "10")
            options.setVMOption("MaxHeapFreeRatio", "20")
            jvm.System.gc()
        finally:
            options.setVMOption("MaxHeapFreeRatio", before["MaxHeapFreeRatio"])
            options.setVMOption("MinHeapFreeRatio", before["MinHeapFreeRatio"])
        args = array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.Object, 0), array(jvm.String, 0)
        # the server's class is not public, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(management.getPlatformMBeanServer(), args)
        return
    jvm.System.gc()


def relieve(spark: SparkSession, most: int = 512 << 20) -> None:
    """release(), where the driver's heap has grown beyond `most` bytes: many small plans leave it full of what nobody holds."""
    if spark.sparkContext._jvm.java.lang.Runtime.getRuntime().totalMemory() > most:
        release(spark)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same wherever no other character has a lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[^\x00-\x7f\xdf-\xff]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about max_bytes of the text column, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 64
    if start < batch.num_rows:
        yield batch.slice(start)
