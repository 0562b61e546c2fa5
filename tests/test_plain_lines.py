"""Lines in the plain spelling are read without lambdas, to the same rows; a document's pages are parsed once."""

from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.functions.scalars import markdown_cells, stripped, trimmed
from tallyspark.operators import hints, jobs, parsers

PAGE = "doc bigint, page int, text string, year_hint int, date_order string"


def test_plain_and_other_spellings_give_the_same_rows(spark):
    plain = ["1995-02-03 Order 5 1,234.50 95.00", "02/13/1995 Fee -5.00 90.00", "| 1995-02-04 | Order 6 | 5.00 | | 85.00 |"]
    pages = [(d, k, w.join(["", line.replace(" ", w, 1) if w != " " else line, ""]), None, "DMY") for d, w in enumerate((" ", "\t")) for k, line in enumerate(plain)]
    rows = parsers.from_lines(spark.createDataFrame(pages, PAGE)).orderBy("doc", "page").collect()
    shown = [[(r.date, r.date_iso, r.description, r.amount, r.balance) for r in rows if r.doc == d] for d in (0, 1)]
    assert len(shown[0]) == 3 and shown[0] == shown[1]
    assert shown[0][2] == ("1995-02-04", "1995-02-04", "| Order 6 |", 5.0, 85.0)


def test_no_generator_holds_a_lambda_and_layouts_share_an_exchange(spark):
    pages = spark.createDataFrame([(1, 1, "1995-02-03 Order 5 4.50 95.00", None, "DMY")], PAGE)
    plan = parsers.from_lines(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate explode" in line and "lambdafunction" in line]
    layouts = parsers.best_layout(pages)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(layouts) if "RepartitionByExpression" in line]
    assert dealt and not [k for k in dealt if "Filter" in layouts[k + 1] or "RLIKE" in layouts[k + 1]]


def test_cells_and_ends_with_any_white_space(spark):
    lines = ["| a | | b |", "|  a |\t|b|", "|a<br/> |  | b |", "||||", " x ", ""]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(markdown_cells(F.col("x")), stripped(F.col("x")) == trimmed(F.col("x"))).collect()
    assert [r[0] for r in got] == [["a", "", "b"]] * 3 + [["", "", ""], ["x"], [""]] and all(r[1] for r in got)


def test_pages_are_parsed_once(spark, monkeypatch):
    names, kept = [], jobs.staged
    monkeypatch.setattr(jobs, "staged", lambda rows, name: names.append(name) or kept(rows, name))
    pages = spark.createDataFrame([(1, 1, "1995-02-03 Order 5 4.50 4.50\n1995-02-04 Order 6 5.00 9.50")], "doc bigint, page int, text string")
    done = jobs.analyze(pages)
    assert names.count("parsed") == 1 and "year_hint" not in done.metadata.columns
    assert [(r.seq, r.date_iso) for r in done.rows.orderBy("seq").collect()] == [(1, "1995-02-03"), (2, "1995-02-04")]


def test_plain_lines_are_taken_apart_in_one_search_of_the_page(spark):
    """Ends of lines, words that count and a page that holds the mark itself make no difference to the rows."""
    lines = ["| 1995-02-03 | Order 5 | 1,234.50 | | 95.00 |", "02/13/1995 Salary 7 -5.00 90.00", "1995-02-04 Page 5.00 6.00", "1995-02-05 a 1,5.00 6.00", "1995-02-06 " + "w " * 20_000 + "5.00 6.00"]
    shown = spark.createDataFrame([("\r\n".join(lines[:4]),)], "x string").select(scalars.mark_plain_lines(F.col("x"))).first()[0].split("\r\n")
    assert [x.split("\x01")[1:] for x in shown[:3]] == [["1995-02-03", " | Order 5 |", "1,234.50", "95.00", ""], ["02/13/1995", " Salary 7", "-5.00", "90.00", "Salary"], ["1995-02-04", " Page", "5.00", "6.00", "Page"]]
    assert shown[3] == lines[3]
    pages = spark.createDataFrame([(1, 1, "\n".join(lines[:4]), None, "DMY"), (2, 1, "\n".join([*lines[:4], "\x01"]), None, "DMY"), (3, 1, "\r\n".join(lines[4:]), None, "DMY")], PAGE)
    rows = parsers.from_lines(pages).orderBy("doc", "line_no").collect()
    own = [[tuple(r)[2:] for r in rows if r.doc == d] for d in (1, 2, 3)]
    assert own[0] == own[1] and [r[2] for r in own[0]] == ["1995-02-03", "1995-02-13", "1995-02-05"] and own[0][1][6] == "credit"
    assert len(own[2]) == 1 and own[2][0][5:8] == (5.0, None, 6.0)


def test_layouts_are_chosen_in_one_window(spark):
    """A page with words only under its dates is one of lines; ties go to tables, then lines."""
    head = "| Date | Details | Amount | Balance |\n|---|---|---|---|\n| 1995-02-03 | a | 5.00 | 6.00 |"
    texts = ["1995-02-03 words alone", head, head + "\n1995-02-03 b 5.00 6.00", "1995-02-03\nc\n5.00\n6.00", "1995-02-03\nc\n5.00\n6.00\n1995-02-03 d 5.00 6.00"]
    best = parsers.best_layout(spark.createDataFrame([(1, k, x, None, "DMY") for k, x in enumerate(texts)], PAGE))
    assert sorted({(r.page, r.mode) for r in best.collect()}) == [(0, "lines"), (1, "tables"), (2, "lines"), (3, "cells"), (4, "lines")]
    above = best._jdf.queryExecution().optimizedPlan().toString().split("Union")[0].splitlines()
    assert len([line for line in above if "+- Window" in line]) == 1


def test_hints_take_the_pages_once(spark):
    """A document's pages come back with its hints from where they were gathered: no join, so that what gives them runs once."""
    rows = [(1, 1, "03/14/1995 a 5.00 6.00", "x"), (1, 2, "in 1996, 1996 and 1995", "y"), (1, 2, None, None), (None, 1, "1997", "z"), (2, 1, "13.02.1998, 14.2. 5/13, 100/13/5 1/134", "w")]
    got = hints.with_hints(spark.createDataFrame(rows, "doc bigint, page int, text string, more string"))
    assert got.columns == ["doc", "page", "text", "more", "year_hint", "date_order"]
    assert {tuple(r) for r in got.collect()} == {(*r, *((1995, "MDY") if r[0] == 1 else (1998, "DMY"))) for r in rows if r[0]}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
