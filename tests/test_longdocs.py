"""Documents longer than a task against the windows by document."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import chain, longdocs, repair, vote


def rows_of(seed):
    rng = random.Random(seed)
    out = []
    for doc, n in ((1, 400), (2, 1), (3, 7), (None, 30), (4, 60)):
        for seq in range(n):
            cents = rng.choice([None, *range(-5, 6)])
            out.append((doc, seq * 3, cents, rng.choice([None, None, rng.randrange(50)]), rng.choice([None, "credit", "debit"])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_same_as_windows_by_document(spark, ranges):
    rows = spark.createDataFrame(rows_of(ranges), "doc long, seq long, cents long, printed long, type string")
    key = lambda frame: sorted(map(str, frame.select(sorted(frame.columns)).collect()))
    assert key(longdocs.walk_balances(rows, ranges)) == key(chain.walk_balances(rows))
    money = rows.select("doc", "seq", "type", (F.col("cents") / 100).alias("amount"), (F.col("printed") / 100).alias("balance"))
    assert key(longdocs.mark_breaks(money, ranges)) == key(chain.mark_breaks(money))
    assert key(longdocs.resolve_signs(money, ranges)) == key(chain.resolve_signs(money))


def test_one_document_lies_in_all_tasks(spark):
    """A million rows of one document: every range has its share, and the walk is that of the arithmetic."""
    rows = spark.range(1_000_000).select(
        F.lit(7).alias("doc"), F.col("id").alias("seq"), F.lit(1).cast("long").alias("cents"), F.when(F.col("id") % 1000 == 0, F.col("id") + F.when(F.col("id") % 100_000 == 0, 1).otherwise(0)).alias("printed")
    )
    sizes = [r["count"] for r in longdocs.Ranges(rows, 16).rows.groupBy("range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 120_000
    walked = longdocs.walk_balances(rows, 16)
    got = walked.agg(F.count_if("checked").alias("checked"), F.count_if("broken").alias("broken"), F.sum("expected").alias("total")).first()
    # a printed balance a unit too high breaks the chain at itself and at the next one
    want = chain.walk_balances(rows).agg(F.count_if("checked").alias("checked"), F.count_if("broken").alias("broken"), F.sum("expected").alias("total")).first()
    assert got == want and got.checked == 999 and got.broken == 9 + 10


def test_empty(spark):
    rows = spark.createDataFrame([], "doc long, seq long, cents long, printed long")
    assert longdocs.walk_balances(rows).count() == 0


def fold_row_by_row(rows):
    """One carried balance over each document's rows, as a loop has it."""
    out = []
    for doc in {r[0] for r in rows}:
        own, prev = sorted((r for r in rows if r[0] == doc), key=lambda r: r[1]), None
        for n, (_, seq, *row) in enumerate(own):
            nxt = own[n + 1][2:4] if n + 1 < len(own) else (None, None)
            done = repair.repaired_row(prev, *row, None if None in nxt else nxt)
            prev = done[1] if done[1] is not None else prev
            if done[0] is not None:
                out.append((doc, seq, *done))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_repair_same_as_a_loop(spark, seed):
    """Chains that close, with all kinds of damage, runs of rows with several numbers among them, and noise."""
    rng = random.Random(seed)
    rows = []
    for doc in range(60):
        balance = 100.0
        for seq in range(rng.randint(1, 25)):
            amount = float(rng.choice([-9.99, -3, -1, 0.01, 2, 5, 50.25]))
            balance = round(balance + amount, 2)
            row = [amount, balance, rng.choice(["credit", "debit", None]), None, False]
            kind = rng.choice([0, 0, 1, 2, 3, 4, 4, 4, 5]) if doc % 3 else 4
            if kind == 1:
                row[:2], row[4] = [None, None], rng.random() < 0.9
            elif kind == 2:
                row[1] = None
            elif kind == 3:
                row[:2] = [balance, None]
            elif kind == 4:
                wrong = float(rng.choice([7.77, amount, 50.25]))
                row[0], row[1], row[3] = wrong, round(balance + rng.choice([0, 0.01, 12]), 2), rng.choice([[wrong, abs(amount)], [None, amount], [], [1.0, 2.0]])
            elif kind == 5:
                row[rng.randrange(2)] = rng.choice([None, 1.005])
            rows.append((doc, seq, *row))
    frame = spark.createDataFrame(rows, "doc long, seq long, amount double, balance double, type string, alt_amounts array<double>, desc_only boolean")
    got = sorted(map(tuple, repair.repair(frame.repartition(5)).collect()), key=str)
    want = fold_row_by_row(rows)
    assert got == want
    assert {r[5] for r in want} >= {"balance-filled", "multi-amount-disambiguated", None} and any(r[6] for r in want)


def test_a_long_document_is_voted_on_in_many_tasks(spark):
    """Ten thousand rows of one document by three readers; no task of the vote holds more than its share."""
    rows = spark.range(30_000).select(
        F.lit(1).alias("doc"), F.concat(F.lit("r"), F.col("id") % 3).alias("reader"), (F.col("id") % 3).cast("int").alias("reader_ord"), (F.col("id") / 3).cast("long").alias("idx"),
        F.lit(1).alias("page"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 3).cast("int") % 900), "yyyy-MM-dd").alias("date_iso"), F.lit(None).cast("string").alias("date_raw"),
        F.concat(F.lit("payment "), (F.col("id") / 3).cast("int")).alias("description"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("long").alias("credit"),
        F.lit(None).cast("long").alias("debit"), ((F.col("id") / 3).cast("long") * 7 + F.when((F.col("id") % 3 == 2) & (F.col("id") % 5 == 0), 1).otherwise(0)).alias("amount"), F.lit(None).cast("long").alias("balance"),
    )
    readers = rows.select("doc", "reader", "reader_ord").distinct()
    accepted, disputes = vote.vote_rows(rows, readers)
    assert accepted.count() == 10_000 and disputes.filter("kind = 'unmatched_row'").count() == 2_000
    dealt = vote.spread(vote.keyed(rows), "doc", "key").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 12_000
