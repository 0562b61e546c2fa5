"""Streams that remember: events in order, liveness with timers, live progress, stale claims and uploads seen before.

Each has a twin on tables that gives the same rows, in :mod:`events` or here. State
is kept by key in RocksDB and is bounded: by the gap of a job's log, by the beats
that the watermark has yet to pass, by a time to live. What comes late is not lost
in silence: :func:`in_order` knows no lateness, and :func:`too_late` gives what the
watermark has overtaken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Events that wait are stored so many to a value.
CHUNK = 100


def with_rocks(spark: SparkSession) -> None:
    """Keyed state needs this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _InOrder(StatefulProcessor):
    """Hands a job's events on by ``seq`` without a gap; state: the next one wanted, and those that came before their turn.

    Those lie in chunks of at most CHUNK events, each under its least ``seq``, an array for each column: every call to
    the state store has its price, whatever it carries, and a chunk bounds what one carries.
    """

    def __init__(self, start: int, columns: list[str], kind: T.StructType):
        self.start, self.out = start, Row("job", "seq", *columns)
        self.kind = T.StructType([T.StructField(c.name, T.ArrayType(c.dataType)) for c in (T.StructField("seq", T.LongType()), *kind)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wanted = handle.getValueState("wanted", "seq long")
        self.early = handle.getMapState("early", "seq long", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.wanted.get()
        wanted = known[0] if known else self.start
        chunks = {first: list(zip(*events, strict=True)) for (first,), events in self.early.iterator()} if known else {}
        held = {event[0]: event for events in chunks.values() for event in events}
        new = {}
        for row in rows:
            seq = row[1]
            if seq >= wanted and seq not in held and seq not in new:
                new[seq] = row[1:]
        before = wanted
        while wanted in held or wanted in new:
            yield self.out(key[0], *(new.pop(wanted) if wanted in new else held[wanted]))
            wanted += 1
        for first in [c for c in chunks if c < wanted]:  # what is left of these is stored anew
            self.early.removeKey((first,))
            new.update((event[0], event) for event in chunks[first] if event[0] >= wanted)
        left = [new[seq] for seq in sorted(new)]
        for chunk in (left[i : i + CHUNK] for i in range(0, len(left), CHUNK)):
            self.early.updateValue((chunk[0][0],), tuple(map(list, zip(*chunk, strict=True))))
        if wanted != before or not known:
            self.wanted.update((wanted,))

    def close(self) -> None:
        pass


def in_order(events: DataFrame, start: int = 1) -> DataFrame:
    """A stream's ``(job, seq, ...)`` with each job's events once and by ``seq``, from ``start`` on without a gap, over all micro-batches.

    An event that comes before its turn waits for those before it, however long they
    take; one that comes again is left out. None is lost to a watermark. On a table:
    each job's events up to its first gap.
    """
    columns = [c for c in events.columns if c not in ("job", "seq")]
    if not events.isStreaming:
        once = events.dropDuplicates(["job", "seq"]).filter(F.col("seq") >= start)
        place = F.row_number().over(Window.partitionBy("job").orderBy("seq")) - 1 + start
        return once.withColumn("place", place).filter("place = seq").drop("place")
    with_rocks(events.sparkSession)
    rest = T.StructType([events.schema[c] for c in columns])
    out = T.StructType([events.schema["job"], T.StructField("seq", T.LongType()), *rest.fields])
    picked = events.select("job", F.col("seq").cast("long").alias("seq"), *columns)
    return picked.groupBy("job").transformWithState(_InOrder(start, columns, rest), out, "append", "none")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(job, seq)`` of the events that :func:`in_order` holds back in a query's state, by its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "early").load()
    return state.select(F.col("key.job").alias("job"), F.explode("user_map_value.seq").alias("seq"))


class _Liveness(StatefulProcessor):
    """Beats in the order of their time, as the watermark passes them; a timer for the next beat or the end of the silence allowed.

    State is read and written a worker at a time, not a beat at a time.
    """

    def __init__(self, seconds: int):
        self.allowed = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, alive boolean")
        self.beats = handle.getListState("beats", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = {row.ms for row in rows}
        self.beats.appendList([(ms,) for ms in new])
        self.handle.registerTimer(min(new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """All that the watermark has passed at once; later timers of the same key find nothing left."""
        passed = timerValues.getCurrentWatermarkInMs()
        last, alive = self.last.get() if self.last.exists() else (None, False)
        held = sorted({ms for (ms,) in self.beats.get()}) if self.beats.exists() else []
        due, early = [ms for ms in held if ms <= passed], [ms for ms in held if ms > passed]
        if due and early:
            self.beats.put([(ms,) for ms in early])
            self.handle.registerTimer(early[0])
        elif due:
            self.beats.clear()
        for now in due:
            if alive and now - last > self.allowed:
                yield Row(worker=key[0], ms=last + self.allowed, alive=False)
                alive = False
            if not alive:
                yield Row(worker=key[0], ms=now, alive=True)
            last, alive = now, True
        if alive and last + self.allowed <= passed:
            yield Row(worker=key[0], ms=last + self.allowed, alive=False)
            alive = False
        elif due:
            self.handle.registerTimer(last + self.allowed)
        if last is not None:
            self.last.update((last, alive))

    def close(self) -> None:
        pass


def liveness_changes(beats: DataFrame, seconds: int = 45, late: str = "0 seconds", until=None) -> DataFrame:
    """``(worker, at, alive)``: when each of ``beats(worker, at)`` came alive, and when it had been silent for ``seconds`` and more.

    On a stream a worker's beats count once the watermark, ``late`` behind the latest
    beat of any, has passed them, in the order of their time whatever order they came in, and a
    timer tells its end although no beat comes. On a table ``until`` is what the
    watermark has passed, the latest beat if null. Times are in whole milliseconds.
    """
    ms = F.unix_millis("at")
    if beats.isStreaming:
        with_rocks(beats.sparkSession)
        rows = beats.withWatermark("at", late).select("worker", "at", ms.alias("ms"))
        out = T.StructType([beats.schema["worker"], *T.StructType.fromDDL("ms long, alive boolean").fields])
        told = rows.groupBy("worker").transformWithState(_Liveness(seconds), out, "append", "eventTime")
        return told.select("worker", F.timestamp_millis("ms").alias("at"), "alive")
    rows = beats.select("worker", ms.alias("ms")).distinct()
    end = rows.agg(F.max("ms").alias("end")) if until is None else beats.sparkSession.range(1).select(F.unix_millis(until).alias("end"))
    rows = rows.crossJoin(F.broadcast(end)).filter("ms <= end")  # one row
    by_time = Window.partitionBy("worker").orderBy("ms")
    allowed = seconds * 1000
    rows = rows.withColumn("before", F.lag("ms").over(by_time)).withColumn("after", F.lead("ms").over(by_time))
    came = F.when(F.col("before").isNull() | (F.col("ms") - F.col("before") > allowed), F.struct("ms", F.lit(True).alias("alive")))
    gone = F.col("ms") + allowed
    went = F.when(F.when(F.col("after").isNull(), gone <= F.col("end")).otherwise(F.col("after") > gone), F.struct(gone.alias("ms"), F.lit(False).alias("alive")))
    each = rows.select("worker", F.explode(F.array_compact(F.array(came, went))).alias("c"))
    return each.select("worker", F.timestamp_millis("c.ms").alias("at"), "c.alive")


def too_late(rows: DataFrame, watermark: str) -> DataFrame:
    """What a query with this watermark (ISO time, from its progress) no longer counts of ``rows(at, ...)``."""
    return rows.filter(F.col("at") < F.lit(watermark).cast("timestamp"))


class _Merged(StatefulProcessor):
    """Of every field the last value set, by ``seq``; forgotten when the watermark passes the job's latest patch."""

    def __init__(self, columns: list[str], kind: T.StructType):
        self.columns, self.kind = columns, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        more = [T.StructField(c, T.LongType()) for c in (*[f"{c}_seq" for c in self.columns], "seq", "ms")]
        self.state = handle.getValueState("merged", T.StructType([*self.kind.fields, *more]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = len(self.columns)
        have = list(self.state.get()) if self.state.exists() else [None] * (2 * n + 2)
        before = have[-1]
        for row in rows:
            for k, c in enumerate(self.columns):
                if row[c] is not None and (have[n + k] is None or row.seq > have[n + k]):
                    have[k], have[n + k] = row[c], row.seq
            have[-2:] = [x if y is None else max(x, y) for x, y in zip((row.seq, row.ms), have[-2:], strict=True)]
        if before != have[-1]:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(have[-1])
        self.state.update(tuple(have))
        yield Row(**{"job": key[0]} | dict(zip(self.columns, have, strict=False)) | {"seq": have[-2]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_progress(patches: DataFrame, folder: str, checkpoint: str, forget_after: int = 7 * 86_400, live: bool = False):
    """Keeps the records that ``patches(job, seq, at, fields...)`` of a stream make, field by field the last value set; see :func:`progress_view`.

    What a micro-batch changes is written under its number, in place of what a run of the
    same micro-batch that failed has left, so that a patch counts once. A job leaves the
    state when the latest patch of any is ``forget_after`` seconds after its own; its record
    stays. Patches as late as that are left out, see :func:`too_late`.
    """
    with_rocks(patches.sparkSession)
    columns = [c for c in patches.columns if c not in ("job", "seq", "at")]
    kind = T.StructType([patches.schema[c] for c in columns])
    out = T.StructType([patches.schema["job"], *kind.fields, T.StructField("seq", T.LongType())])
    picked = patches.withWatermark("at", f"{forget_after} seconds").select("job", "at", F.unix_millis("at").alias("ms"), F.col("seq").cast("long").alias("seq"), *columns)
    merged = picked.groupBy("job").transformWithState(_Merged(columns, kind), out, "update", "eventTime")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    trigger = {"processingTime": "1 second"} if live else {"availableNow": True}
    return merged.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def progress_view(spark: SparkSession, folder: str) -> DataFrame:
    """Each job's record as the last micro-batch that touched it left it."""
    rows = spark.read.parquet(folder)
    fields = [c for c in rows.columns if c not in ("job", "batch")]
    return rows.groupBy("job").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("job", "r.*")


def went_stale(touches: DataFrame, beats: DataFrame, idle: int = 1200, silent: int = 45, late: str = "1 minute") -> DataFrame:
    """``(claim, worker, touched, at)``: claims that were idle for ``idle`` seconds while their worker was silent for the last ``silent`` of these.

    ``touches(claim, worker, touched)``, ``beats(worker, at)``, streams or tables. A claim
    goes stale at ``touched + idle`` unless it was touched after ``touched`` or its worker
    was heard in the last ``silent`` seconds until then. On streams both sides have a
    watermark of ``late``, and a claim is told once both have passed that time.
    """
    streaming = touches.isStreaming
    if streaming:
        touches, beats = touches.withWatermark("touched", late), beats.withWatermark("at", late)
    end = F.expr(f"touched + INTERVAL {int(idle)} SECONDS")
    heard = beats.select(F.col("worker").alias("by"), F.lit(None).cast(touches.schema["claim"].dataType).alias("of"), "at")
    again = touches.select(F.col("worker").alias("by"), F.col("claim").alias("of"), F.col("touched").alias("at"))
    same = F.col("worker") == F.col("by")
    within = (F.col("at") > F.col("touched")) & (F.col("at") <= end)
    own = F.when(F.col("of").isNull(), F.col("at") > end - F.expr(f"INTERVAL {int(silent)} SECONDS")).otherwise(F.col("of") == F.col("claim"))
    signs = heard.unionByName(again)
    if streaming:
        joined = touches.join(signs, same & within & own, "left_outer").filter(F.col("by").isNull())
    else:
        joined = touches.join(signs, same & within & own, "left_anti")
    return joined.select("claim", "worker", "touched", end.alias("at"))


def accept_uploads(uploads: DataFrame, folder: str, checkpoint: str, live: bool = False):
    """Stores the first of each upload of a stream ``(business, content, job, at)`` under ``folder``, as ``(key, job, at)``.

    What is stored is what is remembered: a key that came in any earlier micro-batch,
    however long ago, is no new job. A micro-batch that runs again does not see what its first run stored.
    """
    from .events import first_of_each_upload

    def accept(batch: DataFrame, batch_id: int) -> None:
        new = first_of_each_upload(batch)
        if batch_id:
            stored = batch.sparkSession.read.schema("key string, batch long").parquet(folder).filter(F.col("batch") < batch_id)
            new = new.join(stored.select("key"), "key", "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    trigger = {"processingTime": "1 second"} if live else {"availableNow": True}
    return uploads.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(**trigger).start()
