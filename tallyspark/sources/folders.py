"""Where jobs put what several of their machines read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of this machine in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyspark.scratch", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("tallyspark.scratch", folder)
    return folder


_staging: ContextVar[list[str] | None] = ContextVar("staging", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is :func:`staged` within is deleted at the end, when the job that reads it has written its result."""
    paths: list[str] = []
    token = _staging.set(paths)
    try:
        yield
    finally:
        _staging.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several branches of a job read: written once to the shared folder, in the order of their partitions, and read back."""
    spark = rows.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _staging.get()) is not None:
        paths.append(path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
