"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that a task's Python works on at a time, but for one longer text.
AT_A_TIME = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Give freed memory back to the system, so that a Python worker that waits for its next task keeps little."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts in ``column`` have about ``size`` bytes in all."""
    for batch in batches:
        start = total = 0
        for n, own in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            total += own or 0
            if total >= size or n == batch.num_rows - 1:
                yield batch.slice(start, n + 1 - start)
                start, total = n + 1, 0
        del batch
        tidy()


def of_text(kind: str, arrow: pa.DataType, function: Callable, *texts: Column) -> Column:
    """A column of ``function`` of each row's text (or texts, or other values), which a task holds as Python objects one row at a time."""

    if len(texts) == 1:

        def apply(values: pa.Array) -> pa.Array:
            out = pa.array([function(x.as_py()) for x in values], arrow)
            tidy()
            return out
    else:

        def apply(a: pa.Array, b: pa.Array) -> pa.Array:
            out = pa.array([function(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], arrow)
            tidy()
            return out

    return F.arrow_udf(apply, kind)(*texts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place in local mode (tests, a
    laptop), where one machine does all; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyspark.shared", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("tallyspark.shared", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives lost executors. The reread frame also has
    a known size, from which Spark decides by itself whether to broadcast it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.shared_path = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete materialised frames that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
