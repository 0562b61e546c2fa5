"""Statement data derived from the driver's tables by fixed rules on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cents_of, json_text
from ..operators.parsers import once

READERS = ("r1", "r2", "r3")
ROWS_PER_PAGE = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(orders: DataFrame) -> DataFrame:
    """``(doc, seq, id, day, cents, type, balance)``: an account per customer; finished orders are credits, others debits."""
    size = cents_of(F.col("o_totalprice"))
    credit = F.col("o_orderstatus") == "F"
    rows = orders.select(
        F.col("o_custkey").alias("doc"),
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(credit, size).otherwise(-size).alias("cents"),
        F.when(credit, "credit").otherwise("debit").alias("type"),
        "o_orderdate",
    )
    in_order = Window.partitionBy("doc").orderBy("o_orderdate", "id")
    return rows.select(
        "doc",
        F.row_number().over(in_order).cast("bigint").alias("seq"),
        "id",
        "day",
        "cents",
        "type",
        F.sum("cents").over(in_order).alias("balance"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``(doc, seq, id, day, cents, printed)``: some balances unprinted, some wrong, some amounts unreadable."""
    balance = F.col("balance") + F.when(F.col("id") % 31 == 0, 100).otherwise(0)
    return rows.select(
        "doc",
        "seq",
        "id",
        "day",
        F.when(F.col("id") % 23 != 0, F.col("cents")).alias("cents"),
        F.when(F.col("id") % 7 != 0, balance).alias("printed"),
    )


def money_text(cents: Column) -> Column:
    return F.format_number(cents / 100, 2)


def statement_lines(rows: DataFrame) -> DataFrame:
    """``(doc, page, line_no, seq, cents, text)``: one date-led line for each row, 25 to a page."""
    line = F.concat_ws(
        " ",
        F.date_format(F.to_date("day"), "MM/dd/yyyy"),
        F.lit("ORDER REF"),
        F.col("id").cast("string"),
        money_text(F.abs("cents")),
        money_text(F.col("balance")),
    )
    return rows.select(
        "doc",
        (F.floor((F.col("seq") - 1) / ROWS_PER_PAGE) + 1).cast("int").alias("page"),
        ((F.col("seq") - 1) % ROWS_PER_PAGE + 1).alias("line_no"),
        "seq",
        "cents",
        line.alias("text"),
    )


def statement_pages(rows: DataFrame) -> DataFrame:
    """``(doc, page, text)``: the lines of a page under its heading, and on every page's foot the stated totals of its own lines."""
    credit, debit = F.col("cents") >= 0, F.col("cents") < 0
    lines = statement_lines(rows).groupBy("doc", "page").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("lines"),
        F.count_if(credit).alias("credits_n"),
        F.sum(F.when(credit, F.col("cents")).otherwise(0)).alias("credits"),
        F.count_if(debit).alias("debits_n"),
        F.sum(F.when(debit, -F.col("cents")).otherwise(0)).alias("debits"),
    )
    head = F.concat(F.lit("ACME BANK PLC\nACCOUNT STATEMENT\nAccount Name: Customer "), F.col("doc").cast("string"), F.lit("\nAccount No: 00"), F.lpad(F.col("doc").cast("string"), 8, "0"))
    body = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    foot = F.concat(
        F.lit("Total credits ("), F.col("credits_n").cast("string"), F.lit(") $"), money_text(F.col("credits")),
        F.lit("\nTotal debits ("), F.col("debits_n").cast("string"), F.lit(") -$"), money_text(F.col("debits")),
    )
    return lines.select("doc", "page", F.concat_ws("\n", head, F.lit("Date Particulars Amount Balance USD"), body, foot).alias("text"))


def missed() -> Column:
    """Whether a reader overlooks a row."""
    return (F.col("reader_ord") == 2) & (F.col("id") % 11 == 0)


def reads(rows: DataFrame) -> DataFrame:
    """Three readers' rows of the ledger; the second misses some, the third misreads or repeats some.

    ``(doc, reader, reader_ord, idx, page, date_raw, date_iso, description, reference, credit, debit, amount, balance)``;
    money in cents, ``idx`` a reader's row order in a document.
    """
    per_reader = rows.withColumn("reader_ord", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return as_read(per_reader.filter(~missed()))


def as_read(per_reader: DataFrame, *more: str) -> DataFrame:
    """Ledger rows for each ``reader_ord`` as that reader gives them, in the columns of :func:`reads` and ``more``."""
    id_, r3 = F.col("id"), F.col("reader_ord") == 3
    amount = F.col("cents") + F.when(r3 & (id_ % 13 == 0), 1000).otherwise(0)
    text = F.when(r3 & (id_ % 5 == 0), F.concat(F.lit("0RDER ref. "), id_.cast("string"))).otherwise(
        F.concat(F.lit("ORDER REF "), id_.cast("string"))
    )
    copies = F.when(r3 & (id_ % 17 == 0), 2).otherwise(1)
    out = per_reader.select(
        "doc",
        F.concat(F.lit("r"), F.col("reader_ord").cast("string")).alias("reader"),
        "reader_ord",
        (F.col("seq") * 2).alias("at"),
        (F.floor((F.col("seq") - 1) / ROWS_PER_PAGE) + 1).cast("int").alias("page"),
        F.date_format(F.to_date("day"), "MM/dd/yyyy").alias("date_raw"),
        F.col("day").alias("date_iso"),
        text.alias("description"),
        F.lit(None).cast("string").alias("reference"),
        F.when(amount >= 0, amount).alias("credit"),
        F.when(amount < 0, -amount).alias("debit"),
        amount.alias("amount"),
        "balance",
        *more,
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    )
    return out.withColumn("idx", F.col("at") + F.col("copy") - 1).drop("at", "copy")


def readers(rows: DataFrame) -> DataFrame:
    """``(doc, reader, reader_ord)``: who read each document, with or without finding rows."""
    return rows.select("doc").distinct().select("doc", F.posexplode(F.array(*map(F.lit, READERS))).alias("p", "reader")).select(
        "doc", "reader", (F.col("p") + 1).alias("reader_ord")
    )


def scalar_reads(customers: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per (document, reader) with the fields that a statement has once.

    ``totals(doc, n, credits, debits, opening, closing)`` come from the ledger. Readers
    mask the account number and spell the name in their own ways; the third loses
    every seventh account number and the second misreads every ninth closing balance.
    """
    doc, k = F.col("c_custkey"), F.col("reader_ord")
    number = F.lpad(doc.cast("string"), 8, "0")
    base = customers.join(totals, F.col("doc") == doc).withColumn("reader_ord", F.explode(F.sequence(F.lit(1), F.lit(3))))
    account = (
        F.when(k == 1, F.concat(F.lit("00"), number))
        .when(k == 2, F.concat(F.lit("00-"), F.substring(number, 1, 4), F.lit(" "), F.substring(number, 5, 4)))
        .when(doc % 7 != 0, F.concat(F.lit("00."), number))
    )
    name = F.when(k == 1, F.col("c_name")).when(k == 2, F.upper("c_name")).otherwise(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")))
    return base.select(
        "doc",
        F.concat(F.lit("r"), k.cast("string")).alias("reader"),
        "reader_ord",
        F.lit("bank_statement").alias("document_type"),
        F.concat(F.lit("Acme Bank"), F.when(k == 2, " PLC.").otherwise(" Plc")).alias("company_name"),
        name.alias("account_name"),
        account.alias("account_number"),
        F.lower("c_mktsegment").alias("account_type"),
        F.when(k != 3, F.concat(F.lit("Branch "), F.col("c_nationkey").cast("string"))).alias("branch"),
        F.when(k == 2, "usd").otherwise("USD").alias("currency"),
        F.lit("1992-01-01").alias("period_from"),
        F.lit("1998-12-31").alias("period_to"),
        F.lit(None).cast("string").alias("statement_date"),
        F.col("opening").alias("opening_cents"),
        (F.col("closing") + F.when((k == 2) & (doc % 9 == 0), 900).otherwise(0)).alias("closing_cents"),
        F.when(doc % 3 != 0, F.col("credits")).alias("stated_credits"),
        F.when(doc % 3 != 0, F.col("debits")).alias("stated_debits"),
        F.when(doc % 3 == 1, F.col("n") + F.when(doc % 10 == 0, 1).otherwise(0)).alias("stated_count"),
    )


def ledger_totals(rows: DataFrame) -> DataFrame:
    """``(doc, n, credits, debits, opening, closing)`` per document, in cents."""
    return rows.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("cents") > 0, F.col("cents")).otherwise(0)).alias("credits"),
        F.sum(F.when(F.col("cents") < 0, -F.col("cents")).otherwise(0)).alias("debits"),
        F.min_by(F.col("balance") - F.col("cents"), "seq").alias("opening"),
        F.max_by("balance", "seq").alias("closing"),
    )


def event_log(events: DataFrame) -> DataFrame:
    """``(job, seq, type, at, value)`` in each user's order of time; every tenth event was sent twice."""
    in_order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    once = events.select(
        F.col("user_id").alias("job"),
        F.row_number().over(in_order).cast("bigint").alias("seq"),
        F.col("event_type").alias("type"),
        F.col("ts").cast("timestamp").alias("at"),
        "value",
        F.when(F.col("event_id") % 10 == 0, 2).otherwise(1).alias("sent"),
    )
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("sent")))).drop("sent", "copy")


def analysis_pages(rows: DataFrame) -> DataFrame:
    """``(doc, page, text)``: statements with heading, period, opening balance, typed lines and totals; some balances, totals and counts are off.

    A closing balance is printed for every third document. Every 31st row prints a
    balance a unit too high, every fourth document's credits are a unit too high, every fifth's count is.
    """
    credit = F.col("cents") >= 0
    line = F.concat_ws(
        " ", F.date_format(F.to_date("day"), "MM/dd/yyyy"), F.when(credit, "DEPOSIT").otherwise("PAYMENT"), F.col("id").cast("string"),
        money_text(F.abs("cents")), money_text(F.col("balance") + F.when(F.col("id") % 31 == 0, 100).otherwise(0)),
    )
    pages = rows.groupBy("doc", (F.floor((F.col("seq") - 1) / ROWS_PER_PAGE) + 1).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))).alias("r")
    )
    totals = ledger_totals(rows).join(
        rows.groupBy("doc").agg(F.min("day").alias("from"), F.max("day").alias("to"), F.count_if(credit).alias("credits_n")), "doc"
    )
    both = pages.join(totals, "doc")
    number = F.lpad(F.col("doc").cast("string"), 8, "0")
    head = F.concat(
        F.lit("ACME BANK PLC\nACCOUNT STATEMENT\nAccount Name: Customer "), F.col("doc").cast("string"), F.lit("\nAccount No: 00"), number,
        F.lit("\nStatement period: "), F.col("from"), F.lit(" to "), F.col("to"), F.lit("\nOpening balance\n\n"), money_text(F.col("opening")),
    )
    foot = F.concat(
        F.lit("Deposits and credits ("), (F.col("credits_n") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0)).cast("string"), F.lit(") USD\nTotal credits ("),
        (F.col("credits_n") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0)).cast("string"), F.lit(") $"),
        money_text(F.col("credits") + F.when(F.col("doc") % 4 == 0, 100).otherwise(0)),
        F.lit("\nWithdrawals and debits ("), (F.col("n") - F.col("credits_n")).cast("string"), F.lit(") -$"), money_text(F.col("debits")),
        F.when(F.col("doc") % 3 == 0, F.concat(F.lit("\nClosing balance: "), money_text(F.col("closing")))).otherwise(""),
    )
    last = F.col("page") * ROWS_PER_PAGE >= F.col("n")
    text = F.concat_ws("\n", F.when(F.col("page") == 1, head), F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.when(last, foot))
    return both.select("doc", "page", text.alias("text"))


#: Rows of a page and pages of a chunk where readers' replies are made.
REPLY_ROWS, CHUNK_PAGES = 3, 4


def replies(rows: DataFrame) -> DataFrame:
    """Attempts of three readers at every chunk of every document, as JSON text of what :func:`reads` has.

    A first attempt breaks off for every fourth (document, chunk, reader). Of every fifth
    document the third reader is not signed in, of every tenth the second times out.
    """
    own = Window.partitionBy("doc")
    page = (F.floor((F.col("seq") - 1) / REPLY_ROWS) + 1).cast("int")
    paged = rows.select(
        "*", page.alias("page_no"), F.floor((page - 1) / CHUNK_PAGES).cast("bigint").alias("chunk"),
        F.min_by(F.col("balance") - F.col("cents"), "seq").over(own).alias("opening"), F.max_by("balance", "seq").over(own).alias("closing"),
    )
    each = paged.withColumn("reader_ord", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("missed", missed())
    said = as_read(each, "page_no", "chunk", "opening", "closing", "missed")
    text = lambda c: F.when(F.col(c).isNotNull(), money_text(F.col(c)))
    row = F.struct(
        "idx", F.col("page_no").cast("string").alias("page"), F.col("date_raw").alias("dateRaw"), F.col("date_iso").alias("dateIso"), "description",
        "reference", text("credit").alias("credit"), text("debit").alias("debit"), text("balance").alias("balance"),
    )
    # all of it by document: one exchange, that of the ledger; a chunk of which a reader missed every row stays, empty
    every = once(said, "row", F.when(~F.col("missed"), row)).groupBy("doc", "reader_ord", "chunk").agg(
        F.sort_array(F.collect_list("row")).alias("r"),
        F.min("page_no").cast("bigint").alias("page_floor"), F.max("page_no").cast("bigint").alias("page_ceil"),
        F.first("opening").alias("opening"), F.first("closing").alias("closing"),
    )
    none = F.lit(None).cast("string")
    number = F.concat(F.lit("00"), F.lpad(F.col("doc").cast("string"), 8, "0"))
    body = json_text(
        F.struct(
            F.when(F.col("doc") % 7 == 0, "ledger").otherwise("bank_statement").alias("documentType"),
            F.struct(F.lit("Acme Bank").alias("companyName"), none.alias("branch"), number.alias("accountNumber"), F.lit("usd").alias("currency"), F.lit("1992-01-01").alias("statementPeriodFrom"), F.lit("1998-12-31").alias("statementPeriodTo")).alias("metadata"),
            F.struct(F.when(F.col("chunk") == 0, money_text(F.col("opening"))).alias("opening"), money_text(F.col("closing")).alias("closing")).alias("balances"),
            F.transform("r", lambda t: t.dropFields("idx")).alias("transactions"),
        )
    )
    k = F.col("reader_ord")
    tries = every.withColumn("body", body).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(2))))
    first = F.col("attempt") == 1
    error = F.when((k == 3) & (F.col("doc") % 5 == 0) & first, "not signed in").when((k == 2) & (F.col("doc") % 10 == 0), "timed out")
    cut = first & ((F.col("doc") + F.col("chunk") + k) % 4 == 0)
    return tries.select(
        "doc", F.concat(F.lit("r"), k.cast("string")).alias("reader"), "reader_ord", "chunk", "attempt", error.alias("error"),
        F.when(error.isNull(), F.when(cut, F.substring("body", F.lit(1), F.length("body") - 1)).otherwise(F.col("body"))).alias("text"),
        "page_floor", "page_ceil", (F.col("attempt") * 100 + k).cast("bigint").alias("duration_ms"), (k * 10).cast("bigint").alias("input_tokens"),
        F.col("attempt").cast("bigint").alias("output_tokens"), F.lit(7).cast("bigint").alias("cost_micros"),
    )
