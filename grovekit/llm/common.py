"""Shared helpers: table reading, checkpoints, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.shipping import ship


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20  # of an Arrow batch, at most: texts are long, and executors small
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
PARTITION_BYTES = 16 << 20  # of input files that one task of a shuffle answers for


def prepare(spark: SparkSession) -> None:
    """Send the code to executors and keep Arrow batches small; a smaller setting of the session stays."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset and all runs on one machine, a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="grovekit-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of what ``df`` reads: the session's number, and more where its inputs are larger."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    known = size if size < 1 << 60 else 0  # inputs that can't tell say the largest number
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // PARTITION_BYTES)


def small(df: DataFrame, payload: str) -> DataFrame:
    """``df`` marked for broadcast if its rows and the bytes of its largest column are within the bounds."""
    kind = df.schema[payload].dataType.typeName()
    size = F.octet_length(payload) if kind in ("string", "binary") else F.octet_length(F.to_json(payload))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def binary_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only what a scan needs: the id and the text as bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *more)


def trim() -> None:
    """Give memory that earlier tasks of this worker freed back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``max_bytes`` at most (or one row)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        if b.nbytes <= max_bytes:
            yield b
            continue
        step = max(1, int(b.num_rows * max_bytes / b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
