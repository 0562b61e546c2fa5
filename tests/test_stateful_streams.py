"""Streams with state against their twins on tables, their rows arriving in several files and out of order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import plugins, records
from tallyspark.streaming import events as E
from tallyspark.streaming import stateful as S

LOG = "job long, seq long, type string, at timestamp"


def at(second):
    return f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def put(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))


def stream(spark, folder, schema):
    return E.read_log(spark, str(folder), schema, 1)


def gathered(rows, folder, mode="append"):
    """All that a stream gives, by the tables that its micro-batches make."""
    out = []
    query = rows.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_order_over_micro_batches(spark, tmp_path):
    """Events overtake each other over micro-batches and restarts, come again, and one never comes."""
    events = [{"job": j, "seq": s, "type": f"t{s}", "at": at(s)} for j in (1, 2, 3) for s in range(1, 9) if (j, s) != (3, 5)]
    rng = random.Random(1)
    rng.shuffle(events)
    events += rng.sample(events, 8)
    out = []
    for n in range(3):  # each time all that is there, then the query ends
        put(tmp_path / "in", n, events[n::3])
        out += gathered(S.in_order(stream(spark, tmp_path / "in", LOG)), tmp_path / "state")
    for job, last in ((1, 8), (2, 8), (3, 4)):
        assert [(r.seq, r.type) for r in out if r.job == job] == [(s, f"t{s}") for s in range(1, last + 1)]
    table = S.in_order(spark.read.schema(LOG).json(str(tmp_path / "in")))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, out))
    assert sorted(map(tuple, S.waiting(spark, str(tmp_path / "state")).collect())) == [(3, 6), (3, 7), (3, 8)]


def test_liveness_with_timers(spark, tmp_path):
    """Beats in disorder within the lateness allowed; a worker's end is told by a timer, without a beat of its own."""
    kind, rng = "worker string, at timestamp", random.Random(2)
    beats = [("a", s) for s in range(0, 300, 20)] + [("b", 5), ("b", 5), ("b", 50), ("b", 51)] + [("c", s) for s in (10, 40, 200, 240, 299)] + [("d", 340)]
    beats.sort(key=lambda x: x[1] + rng.randint(0, 25))
    for n in range(4):
        put(tmp_path / "in", n, [{"worker": w, "at": at(s)} for w, s in beats[n * len(beats) // 4 : (n + 1) * len(beats) // 4]])
    got = gathered(S.liveness_changes(stream(spark, tmp_path / "in", kind), 45, "30 seconds"), tmp_path / "state")
    table = spark.read.schema(kind).json(str(tmp_path / "in"))
    until = F.lit("2024-01-01 00:05:10").cast("timestamp")  # 340 s less 30
    want = S.liveness_changes(table, 45, until=until).collect()
    key = lambda r: (r.worker, r.at, r.alive)
    assert sorted(map(key, got)) == sorted(map(key, want))
    seconds = [(r.worker, int(r.at.timestamp()) % 86400, r.alive) for r in sorted(want, key=key)]
    assert seconds == [("a", 0, True), ("b", 5, True), ("b", 96, False), ("c", 10, True), ("c", 85, False), ("c", 200, True), ("c", 285, False), ("c", 299, True)]
    assert S.too_late(table, "2024-01-01T00:00:06Z").count() == 3


def test_live_progress_is_written_once(spark, tmp_path):
    kind, rng = "job long, seq long, at timestamp, stage string, page long", random.Random(3)
    patches = [{"job": j, "seq": s, "at": at(s), "stage": f"s{s}" if s % 2 else None, "page": s if s % 3 == 0 else None} for j in (1, 2) for s in range(1, 12)]
    rng.shuffle(patches)
    folder = str(tmp_path / "out")
    for n in range(3):
        put(tmp_path / "in", n, patches[n::3] + patches[n : n + 2])
        S.live_progress(stream(spark, tmp_path / "in", kind), folder, str(tmp_path / "state")).awaitTermination()
    view = {r.job: (r.stage, r.page, r.seq) for r in S.progress_view(spark, folder).collect()}
    table = E.merged_progress(spark.read.schema(kind).json(str(tmp_path / "in")).drop("at"))
    assert view == {r.job: (r.stage, r.page, r.seq) for r in table.collect()} == {1: ("s11", 9, 11), 2: ("s11", 9, 11)}


def test_claims_go_stale_on_streams(spark, tmp_path):
    touches = [(1, "a", 0), (2, "a", 0), (2, "a", 60), (3, "b", 10), (4, "c", 30), (5, "d", 390)]
    beats = [("a", 90), ("b", 10), ("b", 20), ("c", 129), ("d", 400), ("e", 500)]
    for n in range(2):
        put(tmp_path / "touches", n, [{"claim": c, "worker": w, "touched": at(s)} for c, w, s in touches[n::2]])
        put(tmp_path / "beats", n, [{"worker": w, "at": at(s)} for w, s in beats[n::2]])
    put(tmp_path / "touches", 2, [{"claim": 9, "worker": "z", "touched": at(500)}])
    kinds = "claim long, worker string, touched timestamp", "worker string, at timestamp"
    sides = [stream(spark, tmp_path / name, kind) for name, kind in zip(("touches", "beats"), kinds, strict=True)]
    got = gathered(S.went_stale(*sides, idle=100, silent=30, late="400 seconds"), tmp_path / "state")
    tables = [spark.read.schema(kind).json(str(tmp_path / name)) for name, kind in zip(("touches", "beats"), kinds, strict=True)]
    want = S.went_stale(*tables, idle=100, silent=30).collect()
    # by 500 s, less the lateness, the watermark has passed none but the first ends
    told = sorted((r.claim, int(r.touched.timestamp()) % 86400) for r in want)
    assert told == [(2, 60), (3, 10), (5, 390), (9, 500)]
    assert {(r.claim, int(r.touched.timestamp()) % 86400) for r in got} <= set(told)
    more = gathered(S.went_stale(*sides, idle=100, silent=30, late="1 second"), tmp_path / "other")
    assert len(more) == len({tuple(r) for r in more}) and {r.claim for r in more} <= {2, 3, 5}


def test_uploads_are_remembered_beyond_any_watermark(spark, tmp_path):
    kind = "business long, content string, job long, at timestamp"
    folder = str(tmp_path / "jobs")
    rows = [(1, "x", 1, 0), (1, "y", 2, 10), (2, "x", 3, 20), (1, "x", 4, 30), (1, "x", 5, 3000), (2, "y", 6, 80_000)]
    for n in range(3):
        put(tmp_path / "in", n, [dict(zip(("business", "content", "job"), r, strict=False), at=at(r[3])) for r in rows[2 * n : 2 * n + 2]])
        S.accept_uploads(stream(spark, tmp_path / "in", kind), folder, str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(folder)
    want = E.first_of_each_upload(spark.read.schema(kind).json(str(tmp_path / "in")))
    assert sorted((r.key, r.job) for r in stored.collect()) == sorted((r.key, r.job) for r in want.collect())
    assert sorted(r.job for r in stored.collect()) == [1, 2, 3, 6]


def receiver(folder, down=()):
    """Posts to files, from whatever process; refuses job 2 after its first batch, and job 3 twice before it takes it."""
    folder = str(folder)

    def post(job, events):
        import json
        import os
        import time

        os.makedirs(folder, exist_ok=True)
        before = [n for n in os.listdir(folder) if n.startswith(f"{job}-")]
        if job in down:
            raise OSError("away")
        status = 404 if job == 2 and before else 503 if job == 3 and len(before) < 2 else 200
        with open(f"{folder}/{job}-{time.time_ns()}-{status}", "w") as f:
            f.write(json.dumps([e["seq"] for e in events]))
        return status

    return post


def taken(folder):
    out = {}
    for path in sorted(folder.iterdir(), key=lambda p: int(p.name.split("-")[1])):
        job, _, status = path.name.split("-")
        out.setdefault(int(job), []).append((int(status), json.loads(path.read_text())))
    return out


def test_relay_posts_in_batches_waits_and_drops_refused_jobs(spark, tmp_path):
    log = lambda job, seqs: [{"job": job, "seq": s, "type": "ocr:done" if s == 6 else "page", "at": at(s)} for s in seqs]
    put(tmp_path / "in", 0, log(1, [2, 3, 1, 5, 4, 6, 7]) + log(2, [1, 2, 3, 4, 5]) + log(3, [1, 3]))
    how = {"size": 4, "pause": lambda s: None}
    arguments = receiver(tmp_path / "got"), str(tmp_path / "posted"), str(tmp_path / "state")
    E.relay_posts(stream(spark, tmp_path / "in", LOG), *arguments, **how).awaitTermination()
    put(tmp_path / "in", 1, log(1, [8]) + log(2, [6, 7]) + log(3, [2]))
    E.relay_posts(stream(spark, tmp_path / "in", LOG), *arguments, **how).awaitTermination()
    got = taken(tmp_path / "got")
    assert got[1] == [(200, [1, 2, 3, 4]), (200, [5, 6]), (200, [7]), (200, [8])]  # the end of a job ends its batch
    assert got[2] == [(200, [1, 2, 3, 4]), (404, [5])]
    assert got[3] == [(503, [1]), (503, [1]), (200, [1]), (200, [2, 3])]
    rows = spark.read.parquet(str(tmp_path / "posted"))
    assert {(r.job, r.last): r.tried for r in rows.collect() if r.job == 3} == {(3, 1): 3, (3, 3): 1}


def test_relay_that_cannot_reach_its_receiver_loses_nothing(spark, tmp_path):
    put(tmp_path / "in", 0, [{"job": 1, "seq": s, "type": "page", "at": at(s)} for s in (1, 2, 3)])
    place, waited = (str(tmp_path / "posted"), str(tmp_path / "state")), tmp_path / "waited"

    def pause(seconds):
        with open(waited, "a") as f:
            f.write(f"{seconds} ")

    down = E.relay_posts(stream(spark, tmp_path / "in", LOG), receiver(tmp_path / "got", (1,)), *place, tries=6, pause=pause)
    with pytest.raises(Exception, match="away"):
        down.awaitTermination()
    assert waited.read_text().split()[:5] == ["1", "2", "4", "8", "15"]
    E.relay_posts(stream(spark, tmp_path / "in", LOG), receiver(tmp_path / "got"), *place).awaitTermination()
    assert taken(tmp_path / "got") == {1: [(200, [1, 2, 3])]}


def test_a_stream_needs_its_lateness(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="how late"):
        E.once(stream(spark, tmp_path / "in", LOG))


def test_claims_are_read_by_name_and_offset(spark, tmp_path):
    assert plugins.register(spark) == ["tally_claims", "tally_delivery"]
    claims = tmp_path / "claims"
    put(claims, "001", [{"job": 1, "board": "a", "worker": "w"}, {"job": 2, "board": "a"}])
    (claims / "002.json").write_text('{"job": 3\n{"job": 4, "board": "b", "worker": null}\n7')
    read = lambda: spark.readStream.format("tally_claims").option("path", str(claims)).load()
    out = []
    for _ in range(2):
        query = read().writeStream.foreachBatch(lambda b, n: out.append(sorted(map(tuple, b.collect())))).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        put(claims, "003", [{"job": 5, "board": "b", "worker": "x"}])
    assert [b for b in out if b] == [[(1, "a", "w"), (2, "a", None), (4, "b", None)], [(5, "b", "x")]]


def test_delivery_commits_each_batch_once(spark, tmp_path):
    plugins.register(spark)
    kind, folder = "job long, kind string, body string", str(tmp_path / "out")
    for n in range(2):
        put(tmp_path / "in", n, [{"job": n, "kind": "raw", "body": "é"}, {"job": n, "kind": "resolved", "body": None}])
        rows = stream(spark, tmp_path / "in", kind)
        rows.writeStream.format("tally_delivery").option("path", folder).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = [(n, k, b) for n in range(2) for k, b in (("raw", "é"), ("resolved", None))]
    assert sorted(map(tuple, plugins.delivered_once(spark, folder, kind).collect())) == want
    # a batch that runs again after its commit, and a run that ends before one
    writer = plugins.DeliveryWriter(spark.read.schema(kind).json(str(tmp_path / "in")).schema, {"path": folder})
    writer.commit([writer.write(iter([(0, "raw", "again")]))], 0)
    writer.write(iter([(9, "raw", "lost")]))
    assert sorted(map(tuple, plugins.delivered_once(spark, folder, kind).collect())) == want
    writer.abort([lost := writer.write(iter([(9, "raw", "lost")]))], 7)
    assert not (tmp_path / "out/data" / lost.file).exists()


def test_records_are_deleted_without_being_written_again(spark, tmp_path):
    kind, folder = "id string, status string, n int, saved_at timestamp", str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(r, "id string, status string, n int, second long").select("id", "status", "n", F.timestamp_seconds("second").alias("saved_at"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    now = lambda s: F.timestamp_seconds(F.lit(s))
    state = lambda: {r.id: r.n for r in records.live(spark, folder).collect()}
    records.save(rows(("a", "completed", 1, 1), ("b", "processing", 2, 1), ("c", "failed", 3, 1)), folder)
    records.save(rows(("c", "completed", 4, 2)), folder)
    assert state() == {"a": 1, "b": 2, "c": 4}
    before = sorted(p.name for p in (tmp_path / "store/records").rglob("*.parquet"))
    records.delete(ids("a", "b", "zz"), folder, now(3))
    assert state() == {"b": 2, "c": 4} and sorted(p.name for p in (tmp_path / "store/records").rglob("*.parquet")) == before
    records.save(rows(("a", "queued", 5, 4)), folder)  # the id comes back
    assert state() == {"a": 5, "b": 2, "c": 4} and records.compact(spark, folder) == 1
    assert state() == {"a": 5, "b": 2, "c": 4}
    records.delete(ids("c"), folder, now(6))
    assert state() == {"a": 5, "b": 2} and records.live(spark, folder).schema.simpleString() == spark.createDataFrame([], kind).schema.simpleString()
