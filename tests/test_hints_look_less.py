"""Hints try a pattern only where all its words stand, and pages are made once."""

import itertools
import re

import pytest
from pyspark.sql import functions as F
from test_larger_tables import SAID

from tallyspark.operators import hints, jobs

LABELS = (hints.OPENING_LABEL, hints.CLOSING_LABEL)


def test_every_way_to_spell_a_signal_has_its_words():
    signals = [p for patterns in hints.CLASS_SIGNALS.values() for p in patterns]
    for pattern in (*signals, *LABELS):
        assert not re.search(r"\[|\{|\\[^bs.]", pattern)  # what spellings does not take apart
        words = sorted({w for way in hints.spellings(pattern) for w in way})
        for some in itertools.chain(*(itertools.permutations(words, k) for k in (1, 2, 3))):
            for glue in ("", " ", "/"):
                if re.search(pattern, glue.join(some), re.I):
                    assert any(set(way) <= set(w for w in words if w in glue.join(some)) for way in hints.spellings(pattern))
    for name, phrases in SAID.items():
        for pattern, phrase in zip(hints.CLASS_SIGNALS[name], phrases, strict=True):
            assert any(all(w in phrase for w in way) for way in hints.spellings(pattern))
    assert set(hints.spellings(r"(?i)pay(?:ed)?\s+(?:in|out)s?|\bdue\b")) == {("due",), ("pay", "in"), ("pay", "out")}


def test_a_signal_with_one_of_its_words_is_not_tried(spark):
    """`payment` alone does not start the search for a payment's due date."""
    guard = lambda p, text: spark.range(1).select(F.expr(f"transform(array(lower('{text}')), l -> {hints.likely_sql(p)})[0]").alias("g")).first().g
    due = r"payment\s+due\s+date"
    assert (guard(due, "PAYMENT 17 Balance"), guard(due, "PAYMENT DUE DATE"), guard(r"(?:closing|ending)\s+balance", "Opening balance")) == (False, True, False)


ODD = (
    None, "", "\n", "#", "## Acme Bank\nx", "| *Acme* | `Bank` |\r\nOther", " # No heading\n#|Name", "#| # x y z", "#  Ltd co", "a  b  Inc.\t\x0bc\r\nd",
    "\n".join(f"line {n}" for n in range(20)) + "\nLate Bank", "Statement of Bank\nprinciple\nWise men", "Ünï  BANK\x85x", "date\nab\nPage 7\nabc", "x" * 71 + "\nshort one\nNAGAD", "\r\r\n#\r#a bc\n",
    "BKASH\nBANK", "İnc. İNC", "STRIPE  x|y",
)


def test_company_names_of_odd_pages(spark):
    """As when every line was tidied by itself and searched for all words."""

    def plain(first_page):
        tidy = F.transform(
            F.split(first_page, r"\r?\n"),
            lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^#+\s*", ""), r"[|*_`]", " "), r"(?U)\s+", " ")),
        )
        top = F.slice(F.filter(tidy, lambda x: F.length(x) >= 3), 1, 12)
        short = lambda x: F.length(x) <= 70
        named = F.filter(top, lambda x: x.rlike(f"{hints.ORGANISATION}|{hints.BRAND}") & short(x) & ~x.rlike(hints.NO_COMPANY))
        other = F.filter(top, lambda x: short(x) & ~x.rlike(f"{hints.NO_COMPANY}|date"))
        return F.coalesce(F.get(named, F.lit(0)), F.get(other, F.lit(0)))

    rows = spark.createDataFrame([(n, x) for n, x in enumerate(ODD)], "n int, t string")
    got = rows.select("n", plain(F.col("t")).alias("want"), hints.company_name(F.col("t")).alias("got")).orderBy("n").collect()
    assert [r.got for r in got] == [r.want for r in got] and sum(r.got is not None for r in got) > 10


@pytest.mark.parametrize("label", LABELS)
def test_labelled_amounts_of_odd_texts(spark, label):
    word = "Opening" if label == hints.OPENING_LABEL else "ENDING"
    texts = [None, "", "balance", f"{word} balance 5.00", f"{word}\nbalance 5.00", f"{word}  Balance\n\n7.25", "balance b/f 1,000.50 2.00", "Balance C/F\n3.10", "BALANCE brought forward 9.00", "carried balance"]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "n int, t string")
    got = [r.v for r in rows.select("n", hints.labelled_amount(F.col("t"), label).alias("v")).orderBy("n").collect()]
    assert got == [None, None, None, 5.0, None, 7.25, *((2.0, None, 9.0) if word == "Opening" else (None, 3.1, None)), None]


def test_pages_are_made_once_and_blank_documents_go(spark, monkeypatch):
    pages = [("a", 1, "Account No: 12345678\n01/02/2024 DEPOSIT 5.00 5.00"), ("a", 2, None), ("b", 1, "   \n"), ("b", 2, None), ("c", 1, " x "), (None, 1, "y")]
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    rows = spark.createDataFrame(pages, "doc string, page int, text string").withColumn("text", count("text"))
    done = jobs.analyze(rows)
    assert sorted((r.doc or "", r.transactions) for r in done.summary.collect()) == [("", 0), ("a", 1), ("c", 0)]
    assert made.value == len(pages)
    blank = jobs.blank_pages(spark.createDataFrame(pages, "doc string, page int, text string")).orderBy("doc")
    assert [tuple(r) for r in blank.collect()] == [(None, 1, 0, False), ("a", 2, 1, False), ("b", 2, 2, True), ("c", 1, 0, False)]
