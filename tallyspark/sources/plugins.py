"""Readers and writers that Spark knows by name: a folder of claims as a stream, and delivery with exactly one commit for each batch.

``register(spark)`` makes all of READERS known; others may be added to it by name.
Files are reached by pyarrow's file systems, so a path may lie in any shared store
that these know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class ClaimReader(DataSourceStreamReader):
    """Claims of the files of a folder in the order of their names, a task for each file; an offset is the last name read.

    A writer of claims must not add a file whose name comes before one that is there; names
    that begin with the time do.
    """

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.fieldNames(), options["path"]

    def _files(self) -> list[str]:
        fs, root = _place(self.path)
        return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": (self._files() or [""])[-1]}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(n) for n in self._files() if start["after"] < n <= end["after"]]

    def read(self, partition: File) -> Iterator[tuple]:
        fs, root = _place(self.path)
        with fs.open_input_stream(f"{root}/{partition.name}") as file:
            for line in file.read().decode().splitlines():
                try:
                    claim = json.loads(line)
                except ValueError:  # not written whole, or no claim
                    continue
                if isinstance(claim, dict):
                    yield tuple(claim.get(c) for c in self.names)


class ClaimSource(DataSource):
    """``spark.readStream.format("tally_claims").option("path", folder)``; JSON lines of the schema's fields."""

    @classmethod
    def name(cls) -> str:
        return "tally_claims"

    def schema(self) -> str:
        return "job long, board string, worker string"

    def streamReader(self, schema: StructType) -> ClaimReader:  # noqa: N802
        return ClaimReader(schema, self.options)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class DeliveryWriter(DataSourceStreamWriter):
    """Each task writes a file of its own; a batch counts by one file of ``commits``, which says what its files are.

    A batch that is committed already, as by a query that ended before Spark had noted it,
    is not committed again: what its second run wrote goes.
    """

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.fieldNames(), options["path"]

    def write(self, iterator) -> Written:
        fs, root = _place(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.json", 0
        with fs.open_output_stream(f"{root}/data/{name}") as file:
            for row in iterator:
                file.write((json.dumps(dict(zip(self.names, row, strict=True)), default=str) + "\n").encode())
                rows += 1
        return Written(name, rows)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        fs, root = _place(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        mark = f"{root}/commits/{batchId:012d}.json"
        if fs.get_file_info(mark).is_file:
            self.abort(messages, batchId)
            return
        with fs.open_output_stream(f"{root}/commits/.{batchId}") as file:
            file.write("\n".join(json.dumps({"batch": batchId, "file": m.file, "rows": m.rows}) for m in messages if m and m.rows).encode())
        fs.move(f"{root}/commits/.{batchId}", mark)
        for m in messages:
            if m and not m.rows:
                fs.delete_file(f"{root}/data/{m.file}")

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        fs, root = _place(self.path)
        for m in messages:
            if m and fs.get_file_info(f"{root}/data/{m.file}").is_file:
                fs.delete_file(f"{root}/data/{m.file}")


class Delivery(DataSource):
    """``writeStream.format("tally_delivery").option("path", folder)``, a checkpoint and a folder for each query; read by :func:`delivered_once`."""

    @classmethod
    def name(cls) -> str:
        return "tally_delivery"

    def schema(self) -> str:
        return "job long, kind string, body string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DeliveryWriter:  # noqa: N802
        return DeliveryWriter(schema, self.options)


#: Sources by the name that Spark knows them by.
READERS: dict[str, type[DataSource]] = {c.name(): c for c in (ClaimSource, Delivery)}


def register(spark: SparkSession) -> list[str]:
    for source in READERS.values():
        spark.dataSource.register(source)
    return sorted(READERS)


def delivered_once(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What committed batches delivered; files of runs that never were committed do not count."""
    commits = spark.read.schema("batch long, file string, rows long").json(f"{folder}/commits")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = spark.read.schema(schema).json(f"{folder}/data").withColumn("file", name)
    return rows.join(commits.select("file"), "file", "left_semi").drop("file")
