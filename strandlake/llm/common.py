"""What the training-data operators share: shared work folders, written tables, clash-free names, text as bytes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on bytes; every other byte, those of non-ASCII characters among them, stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one is made only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:  # a local session, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandlake-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there and outlives executors."""
    spark = df.sparkSession
    df.write.parquet(path := work_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system classes, in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Frees what plans that are done hold on the driver: Python's handles first, then the JVM's objects. Spark deletes broadcasts and shuffle files when their owners are collected."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def give_back_memory() -> None:
    """Called by a worker at a task's end: what it freed goes back to the system, where Arrow and the C library would keep it for a next task that may not come."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # GNU only
        trim(0)


class Scratch:
    """Written tables that one job needs for a while. ``clear`` deletes them; all that read them must have been written by then, since a lost executor's work is done again from them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet to the shared folder and read again."""
        self.paths.append(path := work_path(self.spark, name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()
        collect_garbage(self.spark)


def sent_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a narrow table of ids, to be broadcast if it has at most ``most`` rows, which are counted; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under new names; a missing one is an error, further ones of any name are left out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least_bytes: int = 4_000_000) -> DataFrame:
    """``df`` dealt out to all cores if the planner takes it for so small that a core would get less than ``least_bytes``; larger inputs stay as they are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * least_bytes else df


def portions(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows, views of the same memory: what is made of a portion, and sent back, stays small however large a batch arrives."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(values: list, most: int = 4_000_000, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Bounds of runs of a batch with at most ``most`` characters or ``rows`` rows, one row at least."""
    return slices_of([len(v) if v is not None else 0 for v in values], most, rows)


def slices_of(sizes: list[int], most: int, rows: int) -> Iterator[tuple[int, int]]:
    """The same of values whose sizes are known."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def lengths(texts: pa.Array) -> list[int]:
    """Bytes of each text; a null one has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


