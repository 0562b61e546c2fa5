"""What went wrong, or cost too much, only on larger tables."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import hints, parsers, reads, vote
from tallyspark.plans import catalogue
from tallyspark.plans.job_queries import SAID


@pytest.fixture
def many_files(spark):
    """Tables are read in many tasks, so that what is written of them lies in many files."""
    for name, value in (("spark.sql.files.maxPartitionBytes", "4096"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(name, value)
    yield spark
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def by_sql(sf_dir: str, name: str, *tables: str) -> Counter:
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return Counter(con.sql(catalogue.ORACLES[name]).fetchall())


def test_headings_meet_patterns_once(spark):
    """Headings are made lower once, not once for each pattern of each role."""
    roles = spark.sql("SELECT array('Date', 'Details', null, 'Amount', ' ', 'Balance') AS cells").select(parsers.header_roles("cells").alias("r"))
    assert roles.first().r == [0, 1, -1, -1, -1, 5, -1, 3]
    assert roles._jdf.queryExecution().analyzed().toJSON().count("expressions.Lower") == 1


def test_uploads_of_many_files(many_files, spark, sf_dir, tmp_path):
    """The files of a part are in no order of time: all of them are one micro-batch."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderdate", ascending=False)
    rows = orders.collect()
    for n in range(0, len(rows), 100):
        spark.createDataFrame(rows[n : n + 100], orders.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    got = Counter(map(tuple, catalogue.QUERIES["uploads_stream"](spark, str(tmp_path)).collect()))
    assert got == by_sql(sf_dir, "uploads_stream", "orders")


def written(spark, run) -> list[str]:
    """What a query stages, by name."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    run()
    return sorted(re.sub("-[0-9a-f]{32}$", "", p.name) for p in folder.iterdir() if p.name not in before)


@pytest.mark.parametrize(
    ("name", "staged"),
    [
        ("refused_documents", []),
        ("consensus_rows", ["final-attempts", "loose-matches", "read-rows", "strict-matches", "voted-fields"]),
        ("row_vote_accepted", ["loose-matches", "reads", "strict-matches"]),
    ],
)
def test_only_what_is_read_twice_is_written(spark, sf_dir, name, staged):
    assert written(spark, lambda: catalogue.QUERIES[name](spark, sf_dir)) == staged


def test_one_attempt_is_carried_along(spark):
    """Not one by each of the two rules."""
    tries = spark.createDataFrame(
        [("d", "r", 0, 1, False, "timed out"), ("d", "r", 0, 2, True, None), ("d", "r", 1, 1, False, "cancelled"), ("d", "r", 1, 2, True, None), ("d", "r", 2, 1, False, "timed out")],
        "doc string, reader string, chunk int, attempt int, ok boolean, reason string",
    )
    final = reads.final_attempts(tries)
    assert sorted((r.chunk, r.attempt) for r in final.collect()) == [(0, 2), (1, 1), (2, 1)]
    assert len(re.findall(r"aggregate\.(?:MinBy|MaxBy)", final._jdf.queryExecution().analyzed().toJSON())) == 1


def test_quorum_counts_hold_no_rows(spark):
    """Counts by reader, without a window over a task's rows."""
    rows = spark.createDataFrame(
        [("d", f"r{k}", k, n, "2024-01-01", None, 5, 5, None, "x") for k, m in ((1, 2), (2, 2), (3, 1)) for n in range(m)],
        "doc string, reader string, reader_ord int, idx int, date_iso string, date_raw string, amount long, credit long, debit long, description string",
    )
    readers = rows.select("doc", "reader", "reader_ord").distinct()
    got = vote.quorum_counts(rows, readers)
    assert [(r.agreed, r.seen_by) for r in got.collect()] == [(2, ["r1", "r2", "r3"])]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_beats_of_many_files(spark, sf_dir, tmp_path):
    """The whole log is one micro-batch, however many files it lies in: none of its beats is late for another."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(12)
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = Counter(map(tuple, catalogue.QUERIES["liveness_stream"](spark, str(tmp_path)).select("worker", "ms", "alive").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert got == by_sql(sf_dir, "liveness_stream", "events")


def test_tables_sort_lines_with_bars_only(spark):
    """Lines without bars are left out before a table's lines are put in order."""
    text = "word\n| Date | Amount |\n|---|---|\n| 1995-02-03 | 5.00 |\nword\nword\n| a |\n| b |"
    page = spark.createDataFrame([(1, 1, text, None, "DMY")], "doc long, page int, text string, year_hint int, date_order string")
    tables = parsers.pipe_tables(page)
    assert sorted((r.table_no, r.row_no, r.cells) for r in tables.collect()) == [(1, 1, ["Date", "Amount"]), (1, 2, ["1995-02-03", "5.00"]), (3, 1, ["a"]), (3, 2, ["b"])]
    plan = tables._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in plan.split("Window")[-1]


def test_headings_end_at_the_role_they_take(spark):
    roles = spark.sql("SELECT array('Date', 'Value Date', 'Details', 'Amount') AS cells").select(parsers.header_roles("cells").alias("r"))
    assert roles.first().r == [0, 2, -1, -1, -1, -1, -1, 3]
    assert "ZipWith" not in roles._jdf.queryExecution().analyzed().toJSON()


def test_plain_pairs_are_read_as_all_tokens_are(spark):
    """A row that ends with two plain amounts takes no walk along its tokens, and gives the same."""
    lines = ["POS 1234 1,234.00 -5.00", "| Row 7 | 6.00 | 1,101.00 |", "5.00 6.00", "-5.00 6.00", "a  7.00 8.00"]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, t string")
    plain = rows.select("n", scalars.money_tokens(F.col("t")).alias("m")).orderBy("n").collect()
    walked = rows.select("n", scalars.money_tokens(F.concat("t", F.lit(" #"))).alias("m")).orderBy("n").collect()
    assert [[(t.raw, t.value, t.rest + 2) for t in r.m] for r in plain] == [[tuple(t) for t in r.m] for r in walked]
    assert all(x for (x,) in rows.select(F.col("t").rlike(scalars.PLAIN_PAIR)).collect())


def test_signals_are_searched_where_their_words_stand(spark):
    """A phrase of each signal holds a word without which its pattern is not tried; a text without any tries none."""
    for name, phrases in SAID.items():
        for pattern, phrase in zip(hints.CLASS_SIGNALS[name], phrases, strict=True):
            assert any(word in phrase for word in hints.needed(pattern))
    rows = spark.createDataFrame([("INVOICE Tk. 5 and 7 EUR, 8 EUR",), ("nothing",), (None,)], "t string")
    found = rows.select(hints.currency(F.col("t")).alias("c"), hints.class_scores(F.col("t")).alias("s"))
    assert [(r.c, r.s and r.s.invoice) for r in found.collect()][:2] == [("EUR", 0.2), (None, 0.0)]
    assert found._jdf.queryExecution().analyzed().toJSON().count("expressions.Contains") > len(hints.CURRENCY_SIGNALS)
