"""Rendered statements print their totals, and still parse back to the ledger."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tallyspark.functions.scalars import cents_of
from tallyspark.operators import hints
from tallyspark.plans import catalogue
from tallyspark.plans import ledger as L


def test_every_page_states_its_totals_on_its_foot(spark, sf_dir):
    rows = L.ledger(L.table(spark, sf_dir, "orders"))
    found = L.statement_pages(rows).withColumn("s", hints.stated_totals(F.col("text")))
    got = found.select("doc", "page", "s.credit_count", cents_of(F.col("s.total_credits")), "s.debit_count", cents_of(F.col("s.total_debits"))).collect()
    want = {}
    for r in rows.collect():
        sums = want.setdefault((r.doc, (r.seq - 1) // L.ROWS_PER_PAGE + 1), [0, 0, 0, 0])
        at = 0 if r.cents >= 0 else 2
        sums[at], sums[at + 1] = sums[at] + 1, sums[at + 1] + abs(r.cents)
    assert {(r[0], r[1]): list(r[2:]) for r in got} == want
    assert all(r.text.splitlines()[-2].startswith("Total credits (") and r.text.splitlines()[-1].startswith("Total debits (") for r in found.collect())


def test_totals_on_the_foot_are_no_rows(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{sf_dir}/orders.parquet'")
    want = Counter(con.sql(catalogue.ORACLES["statement_roundtrip"]).fetchall())
    assert Counter(map(tuple, catalogue.QUERIES["statement_roundtrip"](spark, sf_dir).collect())) == want
