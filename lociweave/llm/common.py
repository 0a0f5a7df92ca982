"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to the vectorised steps in slices of about this many bytes.
SLICE_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode, where the session names none."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{os.path.join(tempfile.gettempdir(), 'lociweave-scratch')}"
    return f"{shared.rstrip('/')}/lociweave"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing else reads the shuffle files of this one write
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and no later step reads."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    ours = scratch_dir(spark).split("://")[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if ours in folder:
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that are written on the way to a result and deleted once nothing reads them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            drop_materialized(t)
        self.tables = [t for t in self.tables if not any(t is x for x in tables)]

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t in self.tables if not any(t is x for x in tables)))


def fold(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo parts; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def text_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of text and at most `rows` rows, or a single row."""
    tidy()
    yield from _slices(batches, column, limit, rows)
    tidy()


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = offsets[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(offsets, base + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
