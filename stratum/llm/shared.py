"""Session plumbing shared by the operators: tables cut out of the lineage,
joins against tables whose size is checked, and Arrow batches in small slices."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that may be sent to every executor.
BROADCAST_ROWS = 200_000
#: Largest size, as text, of the rows that may be sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that the numpy kernels work on at a time.
SLICE_BYTES = 1 << 18


_own: dict[str, str] = {}
#: Bytes of a batch that is sent to a Python worker, unless the session has a limit of its own.
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in small batches: a worker then holds a few megabytes of them."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a session whose
    executors are threads of this machine may name none; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="stratum-"))
    return found.rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores, dealt out over all of them; large tables are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratum-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here,
    and a lost executor costs a reread instead of the whole computation."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more. The JVM learns a
    little after Python's own collection what Python no longer holds, so it collects twice."""
    for pause in (0.3, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that is not read again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/stratum-" in folder:
            path.getFileSystem(conf).delete(path, True)
    release(spark)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows and, written out, ``most_bytes``
    bytes. Beyond that it is joined by shuffling, where adaptive execution splits the partitions of
    hot keys. ``df`` is read twice: let it be a table."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    rows, length = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= limit and (length or 0) <= most_bytes else df


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with about ``most`` bytes of text (one row at least).
    Yields the rows, their text's bytes and the offsets of each text; a null text is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
            last = min(max(last, first + 1), len(texts))
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of integers without nulls."""
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns)
    )


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
