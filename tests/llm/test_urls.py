import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import queries, urls

KIND = "page_id long, url string, host int, gram string"


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].lower(), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


CASES = [
    None, "", "no scheme", "://", "http://A.B/c", "x\ny://H?q#f", "http://h#f/x?y", "http://h/p?x://y/z",
    "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/19", "http://notexample.org/es/1", "http://org/x",
    "http://a.com/fr/1", "http://a.com/de/1?x", "http://a.com", "http://example.org", "http://a.net/" + "é" * 3000,
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(CASES)], KIND)
    got = {r.page_id: r for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(CASES))] == [by_hand(u) for u in CASES]
    assert {CASES[i]: r.rule for i, r in got.items() if r.rule} == {
        "HTTP://WWW.Example.ORG/es/1": "example.org/es/", "http://example.org/en/19": "example.org/en/1",
        "http://notexample.org/es/1": "org/", "http://org/x": "org/", "http://a.com/fr/1": "com/fr/", "http://a.com/de/1?x": "com/de/",
    }
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert got[8].verdict == "block" and got[12].verdict == "allow"


def test_probabilities_sum_to_one(spark):
    table = spark.createDataFrame([("abc",), ("abd",), ("b0",)], "url string")
    some = urls.with_grams(table).groupBy("gram").agg(F.count("*").alias("accepted"))
    a, size = urls.SYMBOLS.index("a") + 1, urls.ALPHABET
    every = spark.range(size).select((F.col("id") + a * size).alias("gram")).join(some, "gram", "full")
    every = every.select("gram", F.coalesce("accepted", F.lit(0)).alias("accepted"))
    p = urls.log_probability(every, "accepted").filter((F.col("gram") >= a * size) & (F.col("gram") < (a + 1) * size))
    assert sum(2.718281828459045**r.logp for r in p.collect()) == pytest.approx(1)


def test_model_separates_what_it_was_shown(spark):
    rows = [(i, f"http://news{i}.org/story/{i}") for i in range(60)] + [(100 + i, f"http://b.com/de/casino-{i}") for i in range(60)]
    rows += [(300, "http://x.net/story/7"), (301, "http://x.net/casino-3"), (301, "http://x.net/casino-3")]
    got = urls.judge(spark.createDataFrame([(*r, 1, "x") for r in rows], KIND), queries.URL_RULES).filter("page_id >= 300")
    assert sorted((r.page_id, r.verdict) for r in got.collect()) == [(300, "allow"), (301, "block"), (301, "block")]


def test_edges(spark):
    assert urls.judge(spark.createDataFrame([], KIND), queries.URL_RULES).count() == 0
    one = urls.judge(spark.createDataFrame([(None, "http://a.net/x", 1, "x")], KIND), queries.URL_RULES).collect()
    assert [tuple(r) for r in one] == [(None, "a.net", "/x", None, "allow")]


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(con.sql(queries.OP6_SQL).fetchall())
    assert sorted(map(tuple, queries.op6_urls(spark, sf_dir).collect())) == want
