import json
import os
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import jobs, repair
from tallyspark.sources import folders, records
from tallyspark.streaming import events as E

REPO = Path(__file__).resolve().parents[1]
KIND = "id string, status string, queued_at string"
A, B = "0" * 8 + "-0000-4000-8000-" + "0" * 12, "1" * 8 + "-0000-4000-8000-" + "0" * 12


def test_record_files(spark, tmp_path):
    for name, body in (("a", {"id": A, "status": "completed", "queued_at": "2"}), ("b", {"id": B, "status": "queued", "queued_at": "3"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "bad.json").write_text('{"id": ')
    rows = records.read_records(spark, str(tmp_path), KIND)
    assert [r.id for r in records.newest_first(rows).collect()] == [B, A]
    assert records.record(rows, A).count() == 1 and records.record(rows, "x").count() == 0
    assert [r.id for r in records.interrupted(rows).collect()] == [B]
    records.write_records(rows, str(tmp_path / "out"))
    assert records.read_records(spark, str(tmp_path / "out"), KIND).count() == 2


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.PDF").write_bytes(b"x" * 50)
    (tmp_path / "c.txt").write_bytes(b"no")
    files = records.read_uploads(spark, str(tmp_path), 20)
    found = files.collect()
    assert [Path(r.path).name for r in found] == ["a.pdf"]
    right = spark.createDataFrame([(found[0].path, found[0].sha256)], "path string, sha256 string")
    assert records.verified(files, right).count() == 1
    assert records.verified(files, right.withColumn("sha256", F.lit("0"))).count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "one").write_text("A=1\n# no\nB = 'two'\nC=x\n")
    (tmp_path / "two").write_text("A=3\nC=\n")
    got = records.read_settings(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()
    assert {r.key: r.value for r in got} == {"A": "3", "B": "two", "C": "x"}


def test_progress_lines(spark):
    lines = spark.createDataFrame([('{"status":"pull","total":100,"completed":37}',), ("oops",), ('{"status":"done"}',)], "value string")
    assert sorted(map(tuple, records.read_progress(lines).collect()), key=str) == [("done", None), ("pull", 30)]


def test_stream_of_files(spark, tmp_path):
    schema = "job long, seq long, type string, at timestamp"
    (tmp_path / "in").mkdir()
    event = lambda j, s: json.dumps({"job": j, "seq": s, "type": "t", "at": f"2024-01-01T00:00:{s:02d}Z"})
    (tmp_path / "in/1.json").write_text("\n".join([event(1, 1), event(1, 2), event(1, 1)]))
    got = []

    def send(batch, n):
        got.extend((r.job, r.seq) for r in batch.collect())

    def run():
        E.relay(E.read_log(spark, str(tmp_path / "in"), schema, 1), send, str(tmp_path / "state")).awaitTermination()

    run()
    (tmp_path / "in/2.json").write_text("\n".join([event(1, 2), event(1, 3), event(2, 1)]))
    run()
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_refused_jobs(spark):
    batch = spark.createDataFrame([(1, 1), (2, 1)], "job long, seq long")
    assert [r.job for r in E.drop_refused(batch, spark.createDataFrame([(2,)], "job long")).collect()] == [1]


def test_live_relay_and_order(spark, tmp_path):
    schema = "job long, seq long, type string, at timestamp"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"job": j, "seq": s, "type": "t", "at": "2024-01-01T00:00:00Z"}) for s in (3, 1, 2) for j in (1, 2)))
    got, told, ended = [], [], []
    listener = E.Progress(lambda *x: told.append(x), lambda *x: ended.append(x))
    spark.streams.addListener(listener)
    query = E.relay(E.read_log(spark, str(tmp_path / "in"), schema), lambda b, n: got.extend((r.job, r.seq) for r in b.collect()), str(tmp_path / "state"), live=True)
    query.processAllAvailable()
    query.stop()
    deadline = time.time() + 20
    while not (told and ended) and time.time() < deadline:
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert [n for _, n, _ in told] == [6] and [e for _, e in ended] == [None]
    assert [s for j, s in got if j == 1] == [1, 2, 3] and sorted(got) == [(j, s) for j in (1, 2) for s in (1, 2, 3)]


def test_a_failed_batch_is_sent_again(spark, tmp_path):
    schema = "job long, seq long, type string, at timestamp"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"job": 1, "seq": 1, "type": "t", "at": "2024-01-01T00:00:00Z"}))
    got, calls = [], []

    def send(batch, n):
        calls.append(n)
        if len(calls) == 1:
            raise OSError("the receiver is away")
        got.extend(r.seq for r in batch.collect())

    for _ in range(2):
        try:
            E.relay(E.read_log(spark, str(tmp_path / "in"), schema), send, str(tmp_path / "state")).awaitTermination()
        except Exception as e:  # the first run's
            assert "the receiver is away" in str(e)
    assert got == [1] and calls[:2] == [0, 0]


def test_waits(spark):
    rows = spark.range(1, 8).select(E.waits(F.col("id")).alias("s")).collect()
    assert [r.s for r in rows] == [1, 2, 4, 8, 15, 15, 15]


def test_delivery(spark, tmp_path):
    sent = spark.createDataFrame([(1, "raw", "a"), (1, "resolved", "b"), (2, "failed", "c"), (1, "progress", "50")], "job long, kind string, body string")
    for _ in range(2):  # at least once
        records.deliver(sent, str(tmp_path / "out"))
    assert records.delivered(spark, str(tmp_path / "out"), "resolved").collect() == [(1, "b")]
    assert records.delivered(spark, str(tmp_path / "out"), "failed").collect() == [(2, "c")]


def test_pages_to_json_files(spark, tmp_path):
    text = "Bank Ltd\nOpening balance 10.00\n2024-01-02 SALARY 5.00 15.00\n2024-01-03 RENT PAYMENT 4.00 11.00"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, " \n"), (3, 1, "Nothing is paid here.")], "doc long, page int, text string")
    place = Path(folders.scratch(spark).removeprefix("file://"))
    before = set(place.iterdir())
    jobs.extract(pages, str(tmp_path / "out"))
    assert set(place.iterdir()) == before  # what it staged is gone
    rows = sorted((json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()), key=lambda r: r["doc"])
    assert [r["doc"] for r in rows] == [1, 3] and [t["amount"] for t in rows[0]["rows"]] == [5.0, -4.0]
    assert (rows[0]["opening"], rows[0]["closing"], rows[0]["closes"], rows[0]["net"]) == (10.0, 11.0, True, 1.0)
    assert rows[1]["rows"] is None and rows[1]["total_credits"] == 0
    assert jobs.run("statement", pages).summary.count() == 2
    with pytest.raises(ValueError, match="no job of kind"):
        jobs.run("other", pages)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        folders.scratch(Elsewhere)


def test_a_long_document_is_repaired_in_linear_time(spark):
    """Half a million rows of one document, every third balance lost, and the last for good."""
    rows = spark.range(500_000).select(
        F.lit(1).alias("doc"), F.col("id").alias("seq"), F.lit(1.0).alias("amount"), F.when(F.col("id") % 3 != 1, F.col("id") + 1.0).alias("balance"),
        F.lit("credit").alias("type"), F.lit(None).cast("array<double>").alias("alt_amounts"), F.lit(False).alias("desc_only"),
    )
    start = time.time()
    out = repair.repair(rows).agg(F.count("balance").alias("n"), F.count_if(F.col("balance") != F.col("seq") + 1).alias("wrong")).first()
    assert (out.n, out.wrong) == (499_999, 0) and time.time() - start < 60


def test_stands_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    # the copy first, and whatever this process finds its libraries by
    path = os.pathsep.join([str(copy), *(p for p in sys.path if p and Path(p) != REPO)])
    env = os.environ | {"PYTHONPATH": path}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    some = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_cases.py", "tests/test_catalogue.py", "-k", "money or ledger_summary or header_mapping"]
    done = subprocess.run(some, cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout


def test_nothing_else_imports_them():
    for path in (REPO / "tallyspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("``tallyspark.llm``", ""), path
