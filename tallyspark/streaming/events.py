"""Ordered event logs: de-duplication, progress, liveness and job claims, on streams and on tables alike.

The log is at-least-once: a producer numbers a job's events and may send any of
them again. What needs state beyond a micro-batch is in :mod:`stateful`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalars import STAGES, stage_percent
from .stateful import in_order

TERMINAL = ("ocr:done",)
BATCH_EVENTS = 50
WINDOW_MS = 400
#: After the first failure, and at most.
WAIT_SECONDS = (1, 15)


def once(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each (job, seq) once; on a stream by a watermark ``late`` behind the latest event, and what comes later is left out.

    :func:`stateful.in_order` leaves none out.
    """
    if events.isStreaming:
        if late is None:
            raise ValueError("say how late an event of the stream may be")
        return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["job", "seq"])
    return events.dropDuplicates(["job", "seq"])


def latest(events: DataFrame) -> DataFrame:
    """Each job's last event by ``seq``: ``(job, seq, type, at)``."""
    last = F.max_by(F.struct("seq", "type", "at"), "seq").alias("e")
    return events.groupBy("job").agg(last).select("job", "e.seq", "e.type", "e.at")


def merged_progress(patches: DataFrame) -> DataFrame:
    """Each record after all its patches: of every field the last value set, by ``seq``."""
    fields = [c for c in patches.columns if c not in ("job", "seq", "at")]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    return patches.groupBy("job").agg(*last, F.max("seq").alias("seq"))


def tail_after(events: DataFrame, seq: int) -> DataFrame:
    """What a reader that has seen up to ``seq`` is still to get."""
    return events.filter(F.col("seq") > seq)


def percent(stage: Column, progress: Column) -> Column:
    """How far the bar is at a stage's progress of 0 to 1; an unknown stage owns the whole bar."""
    out = stage_percent(0, 100, progress)
    for name, (low, high) in STAGES.items():
        out = F.when(stage == name, stage_percent(low, high, progress)).otherwise(out)
    return out


def liveness(beats: DataFrame, now: Column, seconds: int = 45) -> DataFrame:
    """``(worker, last_seen, alive)``: a worker is alive that was heard within ``seconds``."""
    seen = beats.groupBy("worker").agg(F.max("at").alias("last_seen"))
    return seen.withColumn("alive", F.unix_micros(now) - F.unix_micros("last_seen") <= seconds * 1_000_000)


def stale_claims(claims: DataFrame, beats: DataFrame, now: Column, idle_seconds: int = 1200, silent_seconds: int = 45) -> DataFrame:
    """Claims idle for ``idle_seconds`` whose worker has been silent for ``silent_seconds``."""
    idle = F.unix_micros(now) - F.unix_micros("touched") > idle_seconds * 1_000_000
    heard = beats.filter(F.unix_micros(now) - F.unix_micros("at") <= silent_seconds * 1_000_000).select("worker")
    return claims.filter(idle).join(heard, "worker", "left_anti")


def next_claims(jobs: DataFrame) -> DataFrame:
    """Of each board the oldest queued job, by (created, job)."""
    first = F.min_by(F.struct("job", "created"), F.struct("created", "job")).alias("j")
    return jobs.filter("status = 'queued'").groupBy("board").agg(first).select("board", "j.job", "j.created")


def first_of_each_upload(uploads: DataFrame) -> DataFrame:
    """An upload of the same business and content is the same job: the first of each key stays."""
    key = F.concat_ws(":", "business", F.sha2(F.col("content").cast("binary"), 256))
    first = F.min_by(F.struct("job", "at"), F.struct("at", "job")).alias("j")
    return uploads.withColumn("key", key).groupBy("key").agg(first).select("key", "j.job", "j.at")


def state_changes(states: DataFrame) -> DataFrame:
    """Rows of ``(worker, at, state)`` at which the state differs from the one before; the first one too."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("worker").orderBy("at"))
    return states.withColumn("before", before).filter(~F.col("state").eqNullSafe(F.col("before"))).drop("before")


def relay_batches(events: DataFrame, size: int = BATCH_EVENTS) -> DataFrame:
    """Adds ``batch``: a job's events in order, at most ``size`` to a batch, and a terminal event ends its batch."""
    from pyspark.sql import Window

    in_order = Window.partitionBy("job").orderBy("seq")
    ended = F.coalesce(F.sum(F.col("type").isin(*TERMINAL).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = events.withColumn("part", ended)
    place = F.row_number().over(Window.partitionBy("job", "part").orderBy("seq"))
    within = out.withColumn("within", F.floor((place - 1) / size))
    return within.withColumn("batch", F.dense_rank().over(Window.partitionBy("job").orderBy("part", "within"))).drop("part", "within")


def read_log(spark: SparkSession, folder: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A folder of JSON event files as a stream."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(folder)


def relay(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, live: bool = False):
    """Hands each micro-batch of new events to ``send(batch, batch_id)``, each job's in order over all micro-batches, at least once.

    Until none is left, or ``live``, every WINDOW_MS. ``send`` gets a batch in the order
    (job, seq); one that fails is sent again when the query is started again, under the
    same id. An event that comes before its turn waits for those before it.
    """

    def sorted_batch(batch: DataFrame, batch_id: int) -> None:
        send(batch.repartition("job").sortWithinPartitions("job", "seq"), batch_id)

    trigger = {"processingTime": f"{WINDOW_MS} milliseconds"} if live else {"availableNow": True}
    return in_order(events).writeStream.foreachBatch(sorted_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def posted(events: DataFrame, post: Callable[[object, list[dict]], int], size: int = BATCH_EVENTS, tries: int = 8, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Posts :func:`relay_batches` of a table and returns ``(job, batch, n, last, status, tried)`` of each, by the tasks that hold the jobs.

    ``post(job, events)`` returns a status as HTTP has them. A job's batches go one after
    the other, the oldest first. One that is not taken is posted again after a wait, that of
    :func:`waits`; after ``tries`` the task fails, and no later batch of the job has gone. With
    404 the receiver no longer knows the job, whose further batches are left out.
    """
    kind = events.schema["job"].dataType.simpleString()
    columns = [c for c in events.columns if c != "job"]
    first, most = WAIT_SECONDS

    def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refused = None  # the last job refused; rows are sorted by job
        for rows in batches:
            out = {name: [] for name in ("job", "batch", "n", "last", "status", "tried")}
            for job, batch, own in zip(*[rows.column(c).to_pylist() for c in ("job", "batch", "events")], strict=True):
                if job == refused:
                    continue
                for tried in range(1, tries + 1):
                    try:
                        status = post(job, own)
                    except OSError as e:
                        status, why = 0, str(e)
                    else:
                        why = f"the receiver answered {status}"
                    if 200 <= status < 300 or status == 404:
                        break
                    if tried == tries:
                        raise OSError(f"job {job}, batch {batch}: {why}")
                    pause(min(most, first * 2 ** (tried - 1)))
                refused = job if status == 404 else refused
                for name, value in zip(out, (job, batch, len(own), own[-1]["seq"], status, tried), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("job", rows.schema.field("job").type), *[(c, pa.int64()) for c in list(out)[1:]]]))

    cut = relay_batches(events, size).groupBy("job", "batch").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in columns if c != "seq"]))).alias("events"))
    dealt = cut.select("job", F.col("batch").cast("long").alias("batch"), "events").repartition("job").sortWithinPartitions("job", "batch")
    return dealt.mapInArrow(deliver, f"job {kind}, batch long, n long, last long, status long, tried long")


def relay_posts(events: DataFrame, post: Callable[[object, list[dict]], int], folder: str, checkpoint: str, live: bool = False, **how):
    """The whole relay of a stream: events in order, :func:`posted` in batches, refused jobs dropped for good; ``folder`` has what was posted.

    A micro-batch whose posts fail ends the query; started again, it posts that
    micro-batch's batches once more, and the receiver knows the events by (job, seq).
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        if batch_id:
            done = batch.sparkSession.read.schema(f"job {batch.schema['job'].dataType.simpleString()}, status long, part long").parquet(folder)
            batch = drop_refused(batch, done.filter(f"status = 404 AND part < {batch_id}"))
        posted(batch, post, **how).write.mode("overwrite").parquet(f"{folder}/part={batch_id}")

    return relay(events, send, checkpoint, live)


class Progress(StreamingQueryListener):
    """Tells ``told(query name, rows, batch)`` of every micro-batch that had rows, and ``ended(query id, error)`` of a query's end."""

    def __init__(self, told: Callable[[str | None, int, int], None], ended: Callable[[str, str | None], None] = lambda q, e: None):
        self.told, self.ended = told, ended

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.numInputRows:
            self.told(event.progress.name, event.progress.numInputRows, event.progress.batchId)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended(str(event.id), event.exception)


def waits(attempts: Column, first: int = WAIT_SECONDS[0], most: int = WAIT_SECONDS[1]) -> Column:
    """Seconds to wait after so many failures in a row: ``first``, doubling up to ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), attempts - 1)).cast("int")


def drop_refused(batch: DataFrame, refused: DataFrame) -> DataFrame:
    """A batch without the jobs that the receiver no longer knows."""
    return batch.join(refused.select("job").distinct(), "job", "left_anti")
