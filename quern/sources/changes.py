"""The change log: rows (seq, op, doc_id, text), op 1 add, 2 delete, 3 flush; its frames and its folding."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ADD, DELETE, FLUSH = 1, 2, 3
MAX_RECORD = 16 << 20
SCHEMA = "seq long, op int, doc_id long, text string"
SCHEMA_NAMES = ["seq", "op", "doc_id", "text"]


class CorruptLog(ValueError):
    """A log that cannot be read to its end; `records` has those before."""

    def __init__(self, what: str, records: list[dict]):
        super().__init__(what)
        self.records = records


def op_name(op: Column) -> Column:
    return F.when(op == ADD, "add").when(op == DELETE, "delete").when(op == FLUSH, "flush").otherwise(F.format_string("op(%d)", op))


def valid(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("op").isin(ADD, DELETE, FLUSH))


def checksum(payload: Column) -> Column:
    """CRC-32 of bytes."""
    return F.crc32(payload.cast("binary"))


def verified(payload: Column, want: Column) -> Column:
    return checksum(payload) == want


def frame(payload: bytes) -> bytes:
    """Length and checksum, lowest byte first, then the payload."""
    return struct.pack("<II", len(payload), zlib.crc32(payload)) + payload


def record(op: int, doc_id: int = 0, text: str = "") -> bytes:
    return frame(json.dumps({"op": op, "doc_id": doc_id, "text": text}, ensure_ascii=False).encode())


def replay(data: bytes) -> list[dict]:
    """The records of a log; a torn header at its end is a clean end, anything else that is wrong is an error."""
    out: list[dict] = []
    at = 0
    while len(data) - at >= 8:
        size, crc = struct.unpack_from("<II", data, at)
        if size > MAX_RECORD:
            raise CorruptLog("record too large", out)
        payload = data[at + 8 : at + 8 + size]
        if len(payload) < size:
            raise CorruptLog("truncated payload", out)
        if zlib.crc32(payload) != crc:
            raise CorruptLog("checksum mismatch", out)
        try:
            out.append(json.loads(payload))
        except ValueError as e:
            raise CorruptLog("payload is not JSON", out) from e
        at += 8 + size
    return out


def _little(n: Column) -> Column:
    """The four bytes of a number, lowest first."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.unhex(F.concat(*[byte(k) for k in range(4)]))


def frames(changes: DataFrame) -> DataFrame:
    """(file, data): the framed records of each document's changes, in the order of seq."""
    payload = F.to_json(F.struct(*SCHEMA_NAMES), {"ignoreNullFields": "false"}).cast("binary")
    one = changes.select("doc_id", "seq", payload.alias("p"))
    one = one.select("doc_id", F.struct("seq", F.concat(_little(F.octet_length("p")), _little(checksum(F.col("p"))), "p").alias("data")).alias("r"))
    held = one.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    joined = F.aggregate("rs", F.lit(b"").cast("binary"), lambda out, r: F.concat(out, r["data"]))
    return held.select(F.col("doc_id").cast("string").alias("file"), joined.alias("data"))


def replayed(files: DataFrame) -> DataFrame:
    """files(file, data) -> (file, seq, op, doc_id, text), by `replay`; a log that cannot be read is an error."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, r) for name, data in zip(*(batch.column(c).to_pylist() for c in ("file", "data"))) for r in replay(data)]
            cols = [pa.array([n for n, _ in rows], pa.string())]
            for key, kind in zip(SCHEMA_NAMES, (pa.int64(), pa.int32(), pa.int64(), pa.string())):
                cols.append(pa.array([r.get(key) for _, r in rows], kind))
            yield pa.RecordBatch.from_arrays(cols, ["file", *SCHEMA_NAMES])

    return files.select("file", "data").mapInArrow(records, f"file string, {SCHEMA}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """`replayed` over log files; a file is read whole, in one task."""
    return replayed(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("data")))


def fingerprint(changes: DataFrame) -> tuple[int, int, int]:
    """(rows, largest seq or -1, sum of the rows' hashes) of a batch, whatever its order."""
    row = F.xxhash64("seq", "op", "doc_id", "text").bitwiseAND(F.lit((1 << 31) - 1))
    return tuple(changes.agg(F.count("*"), F.coalesce(F.max("seq"), F.lit(-1)), F.coalesce(F.sum(row), F.lit(0))).first())


def changed(changes: DataFrame) -> DataFrame:
    """doc_id of every change, so several times where a document changes again."""
    return changes.where(F.col("op").isin(ADD, DELETE)).select("doc_id")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each document; of changes with equal seq, a delete, then the largest text."""
    last = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("seq"), F.desc("op"), F.desc("text")))
    return changes.where(F.col("op").isin(ADD, DELETE)).withColumn("_n", last).where("_n = 1").drop("_n")


def live(changes: DataFrame) -> DataFrame:
    """(doc_id, text) after all changes."""
    return latest(changes).where(F.col("op") == ADD).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def pending_deletes(changes: DataFrame) -> DataFrame:
    return latest(changes).where(F.col("op") == DELETE).select("doc_id")
