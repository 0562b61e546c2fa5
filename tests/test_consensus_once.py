"""Consensus does its dear steps once: whole replies are told without Python, the first pass of the row vote is not run again."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reads, vote

ODD = [
    None, "", " ", '{"a":1}', "{}", '{"a":1}]', '{"a":1}}', '{"a":1}] }', '{"a":1},{"b":2}', '{"a":1},"b":{}', '{"a":1}, "a":{}', '{"a":1}],"x":{}', '{"a":1}},"x":{}',
    '{"a":"```{}```"}', "{'a':1}", '{"a":"b\nc"}', '{\n"a":1}\n', '{"a":1,"a":2}', '{"a":1,}', '{"a":01}', '{"a":NaN}', '{"a":1}/**/', '{"a":"O\'B"}', 'so {"a":{"b":"}"}} it is', '{"a":',
]


def test_whole_replies_are_told_without_python(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "n int, text string")
    got = {r.n: r for r in reads.recovered(rows).withColumn("bare", reads.is_bare_object(F.col("text"))).collect()}
    assert [got[n].body for n in range(len(ODD))] == [reads._json_object(x) for x in ODD]
    assert all(r.ok == (r.body is not None) and (r.reason is None) == r.ok for r in got.values())
    # what is said to be whole is, and is the text itself
    assert {ODD[n] for n, r in got.items() if r.bare} == {'{"a":1}', "{}", '{"a":1,"a":2}', '{"a":"O\'B"}'}


ROW = "doc long, reader string, reader_ord int, idx int, page int, date_iso string, date_raw string, description string, reference string, credit long, debit long, amount long, balance long"


def read(reader, idx, text, amount=500):
    return (1, f"r{reader}", reader, idx, 1, "2024-01-01", "2024-01-01", text, None, amount, None, amount, None)


@pytest.mark.parametrize("carried", [False, True])
def test_the_first_pass_runs_once(spark, monkeypatch, carried):
    written, kept = {}, vote.staged
    monkeypatch.setattr(vote, "staged", lambda rows, name: written.setdefault(name, kept(rows, name)))
    said = [read(k, i, "SALARY") for k, n in ((1, 2), (2, 2), (3, 3)) for i in range(n)]
    said += [read(1, 2, "GHOST", 7), read(2, 2, "FEE", 5), read(3, 3, "F3E", 5)]
    rows = spark.createDataFrame(said, ROW)
    readers = spark.createDataFrame([(1, f"r{k}", k) for k in (1, 2, 3)], "doc long, reader string, reader_ord int")
    accepted, disputes = vote.vote_rows(rows.withColumn("voters", F.lit(3)) if carried else rows, readers)
    # a row for each key and occurrence, accepted or not
    assert written["strict-matches"].count() == 6
    assert "Window" not in accepted._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.matched_by, r.description or "", r.occurrence, r.readers) for r in accepted.collect())
    assert got == [("amount+date", "", 1, ["r2", "r3"]), ("exact", "SALARY", 1, ["r1", "r2", "r3"]), ("exact", "SALARY", 2, ["r1", "r2", "r3"])]
    assert sorted((r.kind, r.reader or "") for r in disputes.collect()) == [("duplicate_row", "r3"), ("row_description", ""), ("unmatched_row", "r1")]


def test_rows_of_chunks_take_their_places_without_moving(spark):
    rows = spark.createDataFrame([(1, "r1", 0, 0, 2), (1, "r1", 0, 1, None), (1, "r1", 1, 0, 2), (1, "r1", 1, 1, 1)], "doc int, reader string, chunk int, idx int, page int")
    placed = reads.merged_rows(rows)
    assert "Window" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.page, tuple(r.idx)) for r in placed.orderBy("idx").collect()] == [(None, (0, 0, 1)), (1, (1, 1, 1)), (2, (2, 0, 0)), (2, (2, 1, 0))]
