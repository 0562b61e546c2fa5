"""Every query of the catalogue against its oracle in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tallyspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = con.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(want.columns, r, strict=True))) for r in want.fetchall()), key=str)
    assert mine == theirs


def test_flagship(spark):
    rows = catalogue.flagship(spark, "/root/testdata/sf0.001")
    assert rows.count() == 150


def test_sentence(spark, sf_dir):
    notes = [r.note for r in catalogue.QUERIES["result_sentence"](spark, sf_dir).collect()]
    assert len(notes) == 150 and all(" received, " in n and n.endswith(".") for n in notes)
    assert any("Every read agrees" in n for n in notes) and any("To be checked" in n for n in notes)
