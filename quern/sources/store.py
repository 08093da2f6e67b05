"""The index folder on any Hadoop file system: an atomic manifest, segment tables, tombstones and the log."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, set once; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not held.isDefined() and not local:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextlib.contextmanager
def reading(spark: SparkSession, most: int) -> Iterator[None]:
    """Meanwhile a task reads at most so many bytes of files (one row group, if that is larger)."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame, size: int, *keys: str, each: int = 16 << 20) -> DataFrame:
    """Rows that take `size` bytes as files, dealt out by keys so that a task gets some `each` of them, where the session's partitions are too few for that."""
    n = size // each + 1
    return rows.repartition(n, *keys) if n > partitions(rows.sparkSession) else rows


def dealt(rows: DataFrame, *keys: str, each: int) -> DataFrame:
    """Rows dealt out by keys so that a task gets some `each` bytes of what the planner takes them for; in the session's partitions where it cannot tell."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(size // each + 1, *keys) if size < 1 << 44 else rows.repartition(*keys)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        if not root:
            raise ValueError("the index needs a folder")
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.full(name)))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.full(name)), True)

    def size(self, name: str) -> int:
        """Bytes of all files below."""
        return self._fs.getContentSummary(self._path(self.full(name))).getLength()

    def names(self, folder: str) -> list[str]:
        path = self._path(self.full(folder))
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def write_bytes(self, name: str, data: bytes) -> None:
        """Write beside the name, make it durable and rename it, so readers see the old file or the new one."""
        aside = self._path(self.full(name + ".new"))
        out = self._fs.create(aside, True)
        out.write(bytearray(data))
        out.hsync()
        out.close()
        final = self._path(self.full(name))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, final, overwrite)

    def read_bytes(self, name: str) -> bytes:
        source = self._fs.open(self._path(self.full(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def load_manifest(self) -> dict:
        empty = {"next_id": 1, "segments": [], "tombstones": [], "log_from": 0, "next_log": 0, "next_seq": 1, "last_batch": -1, "format": 2}
        return empty | ({"format": 1} | json.loads(self.read_bytes("catalog.json")) if self.exists("catalog.json") else {})

    def save_manifest(self, manifest: dict) -> None:
        self.write_bytes("catalog.json", json.dumps(manifest, indent=2).encode())
