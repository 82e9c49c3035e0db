"""Pieces that the operators of this subpackage share: table access, intermediate tables and byte-bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as numpy arrays at a time; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return where or f"{spark.conf.get('spark.sql.warehouse.dir')}/gistmill-intermediate"


class Scratch:
    """The intermediate tables of one operator call: Parquet in a folder of their own below the shared folder.

    A table cuts lineage: a lost executor costs no more than the read. It can be dropped as soon as what was made of it
    is itself written; the shuffle files behind a written table go when the driver's JVM collects its plan, which it is
    asked for after each table: what it holds in between (plans, broadcasts, where shuffled blocks lie) would grow with
    the tasks of all tables, and its heap with that.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back."""
        self.made += 1
        path = f"{self.folder}/{self.made}-{name}"
        df.write.parquet(path)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this folder that no frame in use reads any more."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for t in tables:
            path = hadoop(t.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM find plans that nobody holds, so that Spark deletes their shuffle files."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    return Scratch(df.sparkSession, name).cut(df, name)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a column: one scan inside the JVM, used to size bucket counts."""
    return int(df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def trim() -> None:
    """Give freed memory back to the system, so that a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about `limit` bytes of `column`, whole rows always."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for start, stop in byte_runs(lengths, limit):
            yield batch.slice(start, stop - start)
    trim()


def byte_runs(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, at least one each, whose lengths add up to about `limit`."""
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed) from (doc_id, text): texts compressed for a shuffle, to about a third of what it would make of them."""
    for part in by_bytes(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed_texts(part.column("text"))], ["doc_id", "packed"])


def packed_texts(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=1)
    return pa.array([None if t is None else pack.compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
