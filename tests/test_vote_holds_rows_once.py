"""The first pass of the row vote sorts its rows, and holds them in no aggregate beside the sort."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_consensus_once import ROW

from tallyspark.operators import vote


def odd_rows(spark):
    """Readers who repeat rows, read the same or not, are not named, or have one name and two places."""
    rng, rows = random.Random(5), []
    for doc in (1, 2, None):
        for reader, ord_ in (("r1", 1), ("r2", 2), ("r3", 3), (None, 3), ("r4", None), ("r5", 5), ("r5", 6)):
            for idx in range(rng.randint(0, 40)):
                day, amount = rng.choice(["2024-01-01", "2024-01-02", None]), rng.choice([500, -7, None])
                text = rng.choice(["SALARY", "salary", "FEE", None, ""])
                rows.append((doc, reader, ord_, idx * 10 + (ord_ or 0), rng.choice([1, None]), day, rng.choice([day, "1/1"]), text, None, amount, None, amount, rng.choice([None, idx])))
    return spark.createDataFrame(rows, ROW)


def test_windows_gather_what_an_aggregate_gathers(spark):
    dealt = vote.keyed(odd_rows(spark)).drop("loose").withColumn("voters", F.lit(3)).repartition(4, "doc", "key")
    first = F.min(F.struct("reader_ord", "idx")).over(Window.partitionBy("doc", "key"))
    want = vote._grouped(vote.with_counts(dealt, "key", ["idx"]).withColumn("first", first), "key", "seen", "first", "voters")
    got = vote._side_by_side(vote.numbered(dealt, "key", ["idx"]))
    got = got.withColumn("said", F.transform("said", lambda s: s.dropFields("n")))
    plain = lambda d: sorted(map(repr, vote.told_quorum(d).select(*[c for c in sorted(want.columns) if c != "seen"], "agreed", "seen_by").collect()))
    assert plain(got) == plain(want) and got.count() > 100


def test_the_first_pass_has_no_aggregate(spark, monkeypatch):
    plans, kept = {}, vote.staged

    def staged(rows, name):
        plans[name] = rows._jdf.queryExecution().sparkPlan().toString()
        return kept(rows, name)

    monkeypatch.setattr(vote, "staged", staged)
    rows = odd_rows(spark).withColumn("voters", F.lit(3))
    vote.vote_rows(rows, rows.select("doc", "reader", "reader_ord").distinct())
    assert "Aggregate" not in plans["strict-matches"]
