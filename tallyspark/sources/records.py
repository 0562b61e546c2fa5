"""Stored records, uploaded files, settings and progress logs as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_uuid, trimmed


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document a file; files that are no JSON are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)


def record(records: DataFrame, id_: str) -> DataFrame:
    return records.filter(is_uuid(F.lit(id_)) & (F.col("id") == id_))


def newest_first(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("queued_at"), "id")


def interrupted(records: DataFrame) -> DataFrame:
    """Records to take up again after a restart."""
    return records.filter(F.col("status").isin("queued", "processing"))


def readiness(records: DataFrame) -> DataFrame:
    """Adds ``readiness``: failed, pending or ready."""
    ready = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "completed", "ready").otherwise("pending")
    return records.withColumn("readiness", ready)


def summaries(records: DataFrame) -> DataFrame:
    """What a list shows of ``records(id, status, file, progress, raw, processed, error)``: no read page or row is touched."""
    return records.select(
        "id",
        "status",
        F.struct(*[F.col(f"file.{c}").alias(c) for c in ("original_name", "size_bytes", "uploaded_at")]).alias("file"),
        "progress",
        F.col("processed.document_type").alias("document_type"),
        F.col("processed.summary.transactions").alias("transactions"),
        "error",
    )


def part(records: DataFrame, name: str) -> DataFrame:
    """``raw`` or ``processed`` of the records that are ready."""
    return readiness(records).filter("readiness = 'ready'").select("id", "file", name)


def to_analyse_again(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the stored pages of records that have any, the ids of records that have none and cannot be analysed again)."""
    pages = records.filter("raw IS NOT NULL").select(F.col("id").alias("doc"), F.explode("raw.pages").alias("p"))
    return pages.select("doc", "p.page", "p.text"), records.filter("raw IS NULL").select("id")


def duplicate_urls(backends: DataFrame) -> DataFrame:
    """``(url, ids)`` of the addresses that more than one of ``backends(id, url)`` has, a last slash aside."""
    url = F.regexp_replace(F.trim("url"), "/+$", "")
    found = backends.groupBy(url.alias("url")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return found.filter(F.size("ids") > 1)


def deliver(outcomes: DataFrame, folder: str) -> None:
    """What a job sends back, ``(job, kind, body)``, appended by kind: raw, resolved, failed or progress."""
    outcomes.write.mode("append").partitionBy("kind").json(folder)


def delivered(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``(job, body)`` of one kind, each once, however often it was sent."""
    return spark.read.schema("job long, body string, kind string").json(folder).filter(F.col("kind") == kind).select("job", "body").distinct()


def without(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records but those of ``ids``, of which none in work may go."""
    return records.join(ids.select("id"), "id", "left_anti").unionByName(
        records.join(ids.select("id"), "id", "left_semi").filter("status = 'processing'")
    )


def save(records: DataFrame, folder: str) -> None:
    """Appends ``records(id, status, saved_at, ...)`` to a store that :func:`live` reads; a later one of an id takes an earlier one's place."""
    records.write.mode("append").parquet(f"{folder}/records/generation={_generation(records.sparkSession, folder)}")


def _generation(spark: SparkSession, folder: str) -> int:
    """The latest generation that was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/records/generation=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)


def _buried(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tombstones")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema("id string, at timestamp").parquet(f"{folder}/tombstones") if there else spark.createDataFrame([], "id string, at timestamp")
    return rows.groupBy("id").agg(F.max("at").alias("at"))


def live(spark: SparkSession, folder: str) -> DataFrame:
    """The store's records, of each id the one saved last, but for those deleted since."""
    rows = spark.read.parquet(f"{folder}/records/generation={_generation(spark, folder)}")
    fields = [c for c in rows.columns if c != "id"]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*fields), "saved_at").alias("r")).select("id", "r.*")
    return last.join(_buried(spark, folder), "id", "left").filter("at IS NULL OR saved_at > at").drop("at")


def delete(ids: DataFrame, folder: str, at: Column) -> None:
    """Notes that the records of ``ids`` go, but for those in work; no record is written again."""
    idle = live(ids.sparkSession, folder).filter("status <> 'processing'")
    ids.select("id").distinct().join(idle.select("id"), "id", "left_semi").select("id", at.alias("at")).write.mode("append").parquet(f"{folder}/tombstones")


def compact(spark: SparkSession, folder: str) -> int:
    """Writes what is live as the next generation, whose number it returns; readers go over to it once it is whole.

    Nothing may be saved meanwhile. Deletions may be noted at any time, as they hold for every
    generation; an earlier generation may go when no reader has it open.
    """
    after = _generation(spark, folder) + 1
    live(spark, folder).write.mode("overwrite").parquet(f"{folder}/records/generation={after}")
    return after


def with_links(records: DataFrame, base: str) -> DataFrame:
    """Adds ``links``: where a record and its parts are found."""
    self_ = F.concat(F.lit(base.rstrip("/") + "/"), F.col("id"))
    parts = {"self": self_, "raw": F.concat(self_, F.lit("/raw")), "processed": F.concat(self_, F.lit("/processed"))}
    return records.withColumn("links", F.struct(*[c.alias(n) for n, c in parts.items()]))


def write_records(records: DataFrame, folder: str) -> None:
    """All or nothing: readers see the folder once the job has committed."""
    records.write.mode("overwrite").json(folder)


def read_uploads(spark: SparkSession, folder: str, most_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """``(path, length, sha256, content)`` of the PDF files of a folder up to a size; the content is read once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.filter(F.col("length") <= most_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest is the one that ``expected(path, sha256)`` gives."""
    return files.join(expected, ["path", "sha256"], "left_semi")


def read_settings(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(key, value)`` of KEY=value files; a later file wins, blank values and comments count for nothing."""
    lines = None
    for order, path in enumerate(files):
        one = spark.read.text(path).select(
            F.lit(order).alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text")
        )
        lines = one if lines is None else lines.unionByName(one)
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    pairs = lines.select(
        "file", "line", F.regexp_extract("text", pattern, 1).alias("key"), trimmed(F.regexp_extract("text", pattern, 2)).alias("value")
    )
    bare = F.regexp_replace("value", r"""^(["'])(.*)\1$""", "$2")
    pairs = pairs.withColumn("value", bare).filter("key <> '' AND value <> ''")
    return pairs.groupBy("key").agg(F.max_by("value", F.struct("file", "line")).alias("value"))


def read_progress(lines: DataFrame) -> DataFrame:
    """``(status, percent)`` of JSON lines of (status, total, completed); lines that are no JSON are skipped, percents thinned to tens."""
    parsed = lines.select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    percent = F.floor(get("completed", "double") / F.nullif(get("total", "double"), F.lit(0.0)) * 10) * 10
    return parsed.select(get("status", "string").alias("status"), percent.cast("int").alias("percent")).distinct()
