"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators.history import checkpoint_dir


#: Bytes of input for each task that writes a merged table.
TASK_BYTES = 4 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session (a cluster must name one)."""
    return checkpoint_dir(spark)


class Scratch:
    """Tables written to the shared folder to cut lineage between the phases of one operator.

    A lost executor costs the tasks it ran, never a table: the files are in the
    shared folder. ``drop`` removes a table that no later phase reads.
    """

    def __init__(self, spark: SparkSession, name: str, like: DataFrame | None = None):
        """``like`` is the input that the tables derive from; its size bounds the number of tasks that ``merge`` writes with."""
        self.spark = spark
        small_batches(spark)
        size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if like is not None else 0
        self.tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)) if like is not None else 0
        self.root = f"{shared_dir(spark)}/arborlake/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, merge: bool = False) -> DataFrame:
        """Writes and rereads ``df``. With ``merge`` many small partitions are written by fewer tasks, a file each, as the
        input's size asks for; no task gets more than it would at that size, and larger inputs keep their partitions."""
        path = f"{self.root}/{name}"
        if merge:
            df = self.merged(df)
        before = self.spark.conf.get(CLEAN_UP, None)
        # Once a phase's table is written, its shuffle files are of no more use.
        if before is not None:
            self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def merged(self, df: DataFrame) -> DataFrame:
        """``df`` in no more partitions than the input's size asks for."""
        return df.coalesce(self.tasks) if self.tasks else df

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits (the MD5, as bytes) that name a row by id and text; null is a value of its own."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.when(F.col(text_col).isNull(), "|").otherwise(":"), F.coalesce(F.col(text_col), F.lit("")))))


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


#: Bytes of an Arrow batch between the JVM and a Python worker. Buffers grow by doubling and both sides hold a copy.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python operator's task holds in Arrow buffers, whatever the length of the texts: the
    session's batches are set to BATCH_BYTES unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None:
        return
    number, unit = held.rstrip("bBkKmMgG"), held.rstrip("bB")[-1:].lower()
    if int(number) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(unit, 1) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole rows whose ``column`` (binary) holds about ``max_bytes``."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= max_bytes:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
