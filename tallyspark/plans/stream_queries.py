"""Queries on event logs, as tables and as streams, and on stored records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import plugins, records
from ..sources.folders import scratch
from ..streaming import events as E
from ..streaming import stateful as S
from . import ledger as L
from .sql import EVENTS




def log(spark, sf_dir) -> DataFrame:
    return L.event_log(L.table(spark, sf_dir, "events"))


def event_dedupe(spark, sf_dir):
    return E.once(log(spark, sf_dir)).groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


def latest_progress(spark, sf_dir):
    return E.latest(E.once(log(spark, sf_dir))).select("job", "seq", "type")


def merged_progress(spark, sf_dir):
    """Each event sets one of two fields, by its kind."""
    patches = E.once(log(spark, sf_dir)).select(
        "job", "seq", "at", F.when(F.col("seq") % 2 == 0, F.col("type")).alias("stage"), F.when(F.col("seq") % 3 == 0, F.col("seq")).alias("page")
    )
    return E.merged_progress(patches)


def tail_after(spark, sf_dir):
    return E.tail_after(E.once(log(spark, sf_dir)), 3).groupBy("job").agg(F.count(F.lit(1)).alias("n"))


def end_of_log(rows: DataFrame) -> Column:
    return F.lit(rows.agg(F.max("at")).first()[0])


def liveness(spark, sf_dir):
    """Users as workers, their events as heartbeats; alive if heard in the log's last day."""
    rows = log(spark, sf_dir)
    beats = rows.select(F.col("job").alias("worker"), "at")
    return E.liveness(beats, end_of_log(rows), 86_400).select("worker", "alive")


def stale_claims(spark, sf_dir):
    rows = log(spark, sf_dir)
    claims = rows.groupBy((F.col("job") * 10).alias("claim"), F.col("job").alias("worker")).agg(F.max(F.when(F.col("seq") % 2 == 0, F.col("at"))).alias("touched"))
    beats = rows.select(F.col("job").alias("worker"), "at")
    return E.stale_claims(claims, beats, end_of_log(rows), 86_400, 43_200).select("claim", "worker")


def next_claims(spark, sf_dir):
    jobs = L.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("board"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").cast("timestamp").alias("created"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status")
    )
    return E.next_claims(jobs).select("board", "job")


def idempotent_jobs(spark, sf_dir):
    uploads = L.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("business"), F.col("o_orderpriority").alias("content"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").cast("timestamp").alias("at")
    )
    return E.first_of_each_upload(uploads).select("key", "job")


def state_changes(spark, sf_dir):
    rows = E.once(log(spark, sf_dir)).select(F.col("job").alias("worker"), F.col("seq").alias("at"), F.col("type").alias("state"))
    return E.state_changes(rows).groupBy("worker").agg(F.count(F.lit(1)).alias("changes"))


def relay_batches(spark, sf_dir):
    rows = E.once(log(spark, sf_dir)).withColumn("type", F.when(F.col("seq") % 17 == 0, "ocr:done").otherwise(F.col("type")))
    out = E.relay_batches(rows, 5)
    return out.groupBy("job", F.col("batch").cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def progress_percent(spark, sf_dir):
    stages = F.array(*map(F.lit, ("fetching", "reading", "analyzing", "reconciling", "done", "else")))
    k = F.col("event_id")
    rows = L.table(spark, sf_dir, "events").select(k.alias("id"), E.percent(F.element_at(stages, (k % 6 + 1).cast("int")), (k % 13 - 1) / 10).alias("percent"))
    return rows


def stream_dedupe(spark, sf_dir):
    """The same log as a stream: read, numbered events de-duplicated under a watermark, relayed in micro-batches, and read back."""
    place = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    log(spark, sf_dir).write.parquet(f"{place}/in")
    stream = spark.readStream.schema("job long, seq long, type string, at timestamp, value double").parquet(f"{place}/in")

    def send(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={batch_id}")

    E.relay(stream, send, f"{place}/checkpoint").awaitTermination()
    sent = spark.read.parquet(f"{place}/out")
    return sent.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


def as_stream(rows: DataFrame, place: str, parts: list[Column] | None = None, files: int | None = 4) -> DataFrame:
    """The rows as a stream of files, those of each of ``parts`` in files of their own and one after the other.

    A micro-batch has ``files`` of them, all that there are if null: files of a part are in no order of time.
    """
    spark = rows.sparkSession
    for part in parts or [F.lit(True)]:
        rows.filter(part).write.mode("append").parquet(f"{place}/in")
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{place}/in")


def place_of(spark) -> str:
    return f"{scratch(spark)}/stream-{uuid.uuid4().hex}"


def replayed(rows: DataFrame, place: str) -> DataFrame:
    """All that a stream gives until its source has no more."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={batch_id}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{place}/out").drop("batch")


def gappy(spark, sf_dir) -> DataFrame:
    """The log without every fortieth event of every fifth job."""
    return log(spark, sf_dir).filter("job % 5 <> 0 OR seq % 40 <> 0").select("job", "seq", "type", "at")


def up_to_gap(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.min_by("type", "seq").alias("first_type"))


def ordered_events(spark, sf_dir):
    return up_to_gap(S.in_order(gappy(spark, sf_dir)))


def ordered_stream(spark, sf_dir):
    """The same from a stream that gets each job's later events before its earlier ones."""
    place = place_of(spark)
    stream = as_stream(gappy(spark, sf_dir), place, [F.col("seq") % 3 == n for n in (2, 0, 1)])
    return up_to_gap(replayed(S.in_order(stream), place))


def worker_beats(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).select(F.col("job").alias("worker"), "at")


def changes_of(rows: DataFrame) -> DataFrame:
    return rows.select("worker", F.unix_millis("at").alias("ms"), "alive")


def liveness_changes(spark, sf_dir):
    """Users as workers, alive for six hours after each event, up to the log's last event."""
    return changes_of(S.liveness_changes(worker_beats(spark, sf_dir), 21_600))


def liveness_stream(spark, sf_dir):
    """The same replayed as a stream, with timers, up to an hour before the log's last event."""
    place = place_of(spark)
    stream = as_stream(worker_beats(spark, sf_dir), place, files=None)  # files in no order of time would be late for one another
    return changes_of(replayed(S.liveness_changes(stream, 21_600, "1 hour"), place))


def progress_stream(spark, sf_dir):
    """The patches of merged_progress as a stream, later ones first, kept as a view."""
    place = place_of(spark)
    patches = log(spark, sf_dir).select(
        "job", "seq", "at", F.when(F.col("seq") % 2 == 0, F.col("type")).alias("stage"), F.when(F.col("seq") % 3 == 0, F.col("seq")).alias("page")
    )
    stream = as_stream(patches, place, [F.col("seq") % 2 == n for n in (1, 0)])
    S.live_progress(stream, f"{place}/out", f"{place}/checkpoint", 365 * 86_400).awaitTermination()
    return S.progress_view(spark, f"{place}/out")


def went_stale(spark, sf_dir):
    """Orders as touches of their customer's claims by a clerk, other customers' orders as the clerk's beats: idle for 60 days, silent for 30."""
    orders = L.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_custkey") % 97).alias("worker"), F.col("o_orderdate").cast("timestamp").alias("day"))
    touches = orders.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("claim"), "worker", F.col("day").alias("touched"))
    beats = orders.filter("o_orderkey % 50 = 1").select("worker", F.col("day").alias("at"))
    return S.went_stale(touches, beats, 60 * 86_400, 30 * 86_400).select("claim", "worker", F.unix_seconds("touched").alias("touched")).distinct()


def uploads_stream(spark, sf_dir):
    """The uploads of idempotent_jobs as a stream, year by year, against what is stored."""
    place = place_of(spark)
    orders = L.table(spark, sf_dir, "orders")
    uploads = orders.select(F.col("o_custkey").alias("business"), F.col("o_orderpriority").alias("content"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").cast("timestamp").alias("at"))
    years = [(F.col("at") >= F.lit(a).cast("timestamp")) & (F.col("at") < F.lit(b).cast("timestamp")) for a, b in (("1900-01-01", "1994-01-01"), ("1994-01-01", "1996-01-01"), ("1996-01-01", "2100-01-01"))]
    for year in years:  # each time the stream goes on where it ended, with all of the next years at once
        stream = as_stream(uploads, place, [year], files=None)
        S.accept_uploads(stream, f"{place}/jobs", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/jobs").select("key", "job")


def record_store(spark, sf_dir):
    """Customers as records: readiness and links, newest balances first in each state."""
    rows = L.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("status"),
    )
    gone = rows.filter(F.col("id").cast("bigint") % 3 == 0)
    kept = records.with_links(records.readiness(records.without(rows, gone)), "/api/v1/extract/statements/")
    return kept.select("id", "status", "readiness", F.col("links.raw").alias("raw"))


def record_log(spark, sf_dir):
    """Customers as a store: every third is deleted, every sixth saved again, the store compacted, and every fifth deleted."""
    place = place_of(spark)
    rows = L.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_custkey") % 7 == 0, "processing").otherwise("completed").alias("status"),
        F.lit(1).cast("bigint").alias("version"),
        F.timestamp_seconds(F.lit(1)).alias("saved_at"),
    )
    every = lambda n: F.col("id").cast("bigint") % n == 0
    records.save(rows, place)
    records.delete(rows.filter(every(3)), place, F.timestamp_seconds(F.lit(2)))
    records.save(rows.filter(every(6)).withColumns({"version": F.lit(2).cast("bigint"), "saved_at": F.timestamp_seconds(F.lit(3))}), place)
    records.compact(spark, place)
    records.delete(rows.filter(every(5)), place, F.timestamp_seconds(F.lit(4)))
    return records.live(spark, place).select("id", "status", "version")


def delivery_stream(spark, sf_dir):
    """The log delivered by the named sink, in micro-batches that are committed once each."""
    place = place_of(spark)
    plugins.register(spark)
    sent = log(spark, sf_dir).select("job", F.col("type").alias("kind"), F.col("seq").cast("string").alias("body"))
    stream = as_stream(sent, place, [F.col("job") % 3 == n for n in range(3)])
    folder = f"{place}/out"
    stream.writeStream.format("tally_delivery").option("path", folder).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = plugins.delivered_once(spark, folder, "job long, kind string, body string")
    return got.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("body").cast("bigint")).alias("last"), F.count_if(F.col("kind") == "error").alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (
        event_dedupe, latest_progress, merged_progress, tail_after, liveness, stale_claims, next_claims, idempotent_jobs, state_changes,
        relay_batches, progress_percent, stream_dedupe, record_store, ordered_events, ordered_stream, liveness_changes, liveness_stream,
        progress_stream, went_stale, uploads_stream, record_log, delivery_stream,
    )
}



def liveness_sql(late: str) -> str:
    return f"""WITH {EVENTS}, b AS (SELECT DISTINCT job AS worker, epoch_us(sent_at) // 1000 AS ms FROM log), e AS (SELECT max(ms) - {late} AS until FROM b),
      g AS (SELECT worker, ms, lag(ms) OVER w AS before, lead(ms) OVER w AS after, until FROM b, e WHERE ms <= until WINDOW w AS (PARTITION BY worker ORDER BY ms))
      SELECT worker, ms, true AS alive FROM g WHERE before IS NULL OR ms - before > 21600000
      UNION ALL SELECT worker, ms + 21600000, false FROM g WHERE coalesce(after > ms + 21600000, ms + 21600000 <= until)"""


ORDERED_SQL = f"""WITH {EVENTS} SELECT job, count(*) AS n, max(seq) AS last, arg_min(type, seq) AS first_type FROM log WHERE job % 5 <> 0 OR seq < 40 GROUP BY job"""
COUNTS = f"WITH {EVENTS} SELECT job, count(*) AS n, max(seq) AS last FROM log GROUP BY job"
MERGED = f"""WITH {EVENTS} SELECT job, arg_max(type, seq) FILTER (seq % 2 = 0) AS stage, max(seq) FILTER (seq % 3 = 0) AS page, max(seq) AS seq FROM log GROUP BY job"""
UPLOADS = """SELECT o_custkey || ':' || sha256(o_orderpriority) AS key, job FROM (SELECT *, o_orderkey AS job,
      row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1"""
ORACLES = {
    "ordered_events": ORDERED_SQL,
    "ordered_stream": ORDERED_SQL,
    "liveness_changes": liveness_sql("0"),
    "liveness_stream": liveness_sql("3600000"),
    "progress_stream": MERGED,
    "uploads_stream": UPLOADS,
    "went_stale": """WITH o AS (SELECT o_custkey AS claim, o_orderkey AS k, o_custkey % 97 AS worker, epoch(o_orderdate::TIMESTAMP)::BIGINT AS t FROM orders)
      SELECT DISTINCT claim, worker, t AS touched FROM o WHERE k % 2 = 0
        AND NOT EXISTS (SELECT 1 FROM o a WHERE a.k % 2 = 0 AND a.claim = o.claim AND a.t > o.t AND a.t <= o.t + 60 * 86400)
        AND NOT EXISTS (SELECT 1 FROM o b WHERE b.k % 50 = 1 AND b.worker = o.worker AND b.t > o.t + 30 * 86400 AND b.t <= o.t + 60 * 86400)""",
    "record_log": """SELECT CAST(k AS VARCHAR) AS id, status, CASE WHEN k % 6 = 0 THEN 2::BIGINT ELSE 1::BIGINT END AS version
      FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'processing' ELSE 'completed' END AS status FROM customer)
      WHERE status = 'processing' OR k % 5 <> 0 AND (k % 3 <> 0 OR k % 6 = 0)""",
    "delivery_stream": f"WITH {EVENTS} SELECT job, count(*) AS n, max(seq) AS last, count(*) FILTER (type = 'error') AS errors FROM sent GROUP BY job",
    "event_dedupe": COUNTS,
    "stream_dedupe": COUNTS,
    "latest_progress": f"WITH {EVENTS} SELECT job, seq, type FROM log l WHERE seq = (SELECT max(seq) FROM log m WHERE m.job = l.job)",
    "merged_progress": MERGED,
    "tail_after": f"WITH {EVENTS} SELECT job, count(*) - 3 AS n FROM log GROUP BY job HAVING count(*) > 3",
    "liveness": f"""WITH {EVENTS} SELECT job AS worker, max(sent_at) >= (SELECT max(sent_at) FROM log) - INTERVAL 1 DAY AS alive FROM log GROUP BY job""",
    "stale_claims": f"""WITH {EVENTS}, e AS (SELECT max(sent_at) AS t FROM log), c AS (SELECT job, max(sent_at) FILTER (seq % 2 = 0) AS touched, max(sent_at) AS heard FROM log GROUP BY job)
      SELECT job * 10 AS claim, job AS worker FROM c, e WHERE touched < t - INTERVAL 1 DAY AND heard < t - INTERVAL 12 HOUR""",
    "next_claims": """SELECT board, job FROM (SELECT o_custkey AS board, o_orderkey AS job, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r
      FROM orders WHERE o_orderstatus = 'O') WHERE r = 1""",
    "idempotent_jobs": UPLOADS,
    "state_changes": f"""WITH {EVENTS} SELECT job AS worker, count(*) AS changes FROM log l
      WHERE NOT EXISTS (SELECT 1 FROM log p WHERE p.job = l.job AND p.seq = l.seq - 1 AND p.type = l.type) GROUP BY job""",
    "relay_batches": f"""WITH {EVENTS}, p AS (SELECT job, seq, (seq - 1) // 17 AS part, ((seq - 1) % 17) // 5 AS within FROM log)
      SELECT job, batch, count(*) AS n FROM (SELECT job, part * 4 + within + 1 AS batch FROM p) GROUP BY ALL""",
    "progress_percent": """SELECT event_id AS id, CAST(floor(CASE event_id % 6 WHEN 0 THEN 0 + 5 * p WHEN 1 THEN 5 + 55 * p WHEN 2 THEN 60 + 32 * p WHEN 3 THEN 92 + 7 * p WHEN 4 THEN 100 ELSE 100 * p END + 0.5) AS INTEGER) AS percent
      FROM (SELECT event_id, greatest(0.0, least(1.0, (event_id % 13 - 1) / 10))::DOUBLE AS p FROM events)""",
    "record_store": """SELECT CAST(c_custkey AS VARCHAR) AS id, s AS status, CASE s WHEN 'failed' THEN 'failed' WHEN 'completed' THEN 'ready' ELSE 'pending' END AS readiness,
      '/api/v1/extract/statements/' || c_custkey || '/raw' AS raw FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS s FROM customer)
      WHERE c_custkey % 3 <> 0 OR s = 'processing'""",
}
