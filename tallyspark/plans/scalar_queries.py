"""Queries on the scalar functions and document hints; inputs are rendered from the tables, oracles start from what was rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import hints, parsers, reads, selection
from ..operators.spread import spread
from . import ledger as L
from .sql import LEDGER, READS, TOTALS


def pick(k: Column, options: list[Column]) -> Column:
    out = F.lit(None)
    for n, option in enumerate(options):
        out = F.when(k == n, option).otherwise(out)
    return out


def orders(spark, sf_dir) -> DataFrame:
    return L.table(spark, sf_dir, "orders").withColumn("c", S.cents_of(F.col("o_totalprice"))).withColumn("id", F.col("o_orderkey"))


def amount_parse(spark, sf_dir):
    t = F.format_number(F.col("c") / 100, 2)
    text = pick(
        F.col("id") % 9,
        [
            t, F.translate(t, ",.", ".,"), F.concat(F.lit("("), t, F.lit(")")), F.concat(F.lit("$ "), t, F.lit(" Dr")), F.concat(F.lit("-"), t),
            F.concat(t, F.lit("−")), F.lit("1.234.567"), F.lit("n/a"), F.concat(t, F.lit("Dr")),
        ],
    )
    return orders(spark, sf_dir).select("id", S.to_cents(text).alias("cents"), S.is_money_like(text).alias("money_like"))


def text_keys(spark, sf_dir):
    text = F.concat(F.lit(" -"), F.col("c_name"), F.lit(".. ltd/"), F.col("c_mktsegment"), F.lit(" "))
    number = F.when(F.col("c_custkey") % 3 == 0, F.lit("X-12")).otherwise(F.concat(F.lit("00-1 "), F.col("c_custkey").cast("string"), F.lit("/7")))
    return L.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), S.text_key(text).alias("text_key"), S.account_key(number).alias("account_key"), S.text_key(F.lit("日本 ")).alias("none")
    )


def row_keys(spark, sf_dir):
    rows = L.reads(L.ledger(L.table(spark, sf_dir, "orders")))
    money = [F.col(c) for c in ("date_iso", "date_raw", "amount", "credit", "debit")]
    return rows.select("doc", "reader", "idx", S.row_key(*money, F.col("description")).alias("key"), S.row_key_loose(*money).alias("loose"))


def dates_of(spark, sf_dir) -> DataFrame:
    d = F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yy", "dd MMM yyyy", "MMM dd, yyyy", "MMM dd", "dd MMM", "d/M"]
    text = pick(F.col("id") % 9, [*[F.date_format(d, f) for f in forms], F.lit("99/99/2020")])
    return orders(spark, sf_dir).select("id", text.alias("text"))


def date_parts(spark, sf_dir):
    rows = dates_of(spark, sf_dir).withColumn("p", S.date_parts(F.col("text")))
    return rows.select("id", "p.year", "p.month", "p.day", S.is_date_like(F.col("text")).alias("date_like"))


def normalize_date(spark, sf_dir):
    return dates_of(spark, sf_dir).select("id", S.normalize_date(F.col("text"), F.lit(1999)).alias("day"))


def iso_days(spark, sf_dir):
    """Real days only: the order's month and a day of 28 to 31."""
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), (F.lit(28) + F.col("id") % 4).cast("string"), F.when(F.col("id") % 2 == 0, "T00:00").otherwise(""))
    return orders(spark, sf_dir).select("id", S.iso_day(day).alias("day"))


def int_or_null(spark, sf_dir):
    text = pick(F.col("id") % 6, [F.col("id").cast("string"), F.concat(F.lit("-"), F.col("id").cast("string"), F.lit(".7")), F.lit(""), F.lit("1d"), F.lit("NaN"), F.lit(" 42 ")])
    return orders(spark, sf_dir).select("id", S.int_or_null(text).alias("n"))


def by_customer(spark, sf_dir, each: Column, joint: str = "\n") -> DataFrame:
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc"), F.struct("o_orderdate", "id", each.alias("t")).alias("r"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return docs.select("doc", F.array_join(F.transform("rs", lambda r: r["t"]), joint).alias("text"))


def date_order(spark, sf_dir):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_custkey") % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return by_customer(spark, sf_dir, text).select("doc", hints.date_order(F.col("text")).alias("date_order"))


def year_hint(spark, sf_dir):
    docs = by_customer(spark, sf_dir, F.date_format("o_orderdate", "'on' d MMM yyyy 'ref' 12345"))
    return docs.select("doc", hints.year_hint(F.col("text")).alias("year"))


def currency(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat_ws(" ", F.repeat(F.lit("USD 1 "), (k % 3).cast("int")), F.repeat(F.lit("EUR,"), (k % 4).cast("int")), F.repeat(F.lit("৳5 "), (k % 2).cast("int")), F.lit("AUSDX"))
    return L.table(spark, sf_dir, "customer").select(k.alias("id"), hints.currency(text).alias("currency"))


def classify(spark, sf_dir):
    k = F.col("c_custkey")
    said = ["Account  Statement", "OPENING balance", "ending balance", "deposits", "Invoice\nbill to you", "wallet: cash in, send money"]
    text = F.concat_ws("\n", *[F.when(F.shiftright(k, n) % 2 == 1, t) for n, t in enumerate(said)])
    found = hints.classify(F.col("s"))
    rows = L.table(spark, sf_dir, "customer").select(k.alias("id"), hints.class_scores(text).alias("s")).withColumn("c", found)
    return rows.select("id", "c.document_type", F.round("c.confidence", 6).alias("confidence"), F.round("s.bank_statement", 6).alias("bank"))


def money_coverage(spark, sf_dir):
    line = F.concat_ws(" ", F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("REF"), F.col("id").cast("string"), F.when(F.col("id") % 5 != 0, F.format_number(F.col("c") / 100, 2)))
    docs = by_customer(spark, sf_dir, line).withColumn("m", hints.money_coverage(F.col("text")))
    return docs.select("doc", "m.rows", "m.money_rows", F.round("m.coverage", 9).alias("coverage"))


def stated_totals(spark, sf_dir):
    totals = L.ledger_totals(L.ledger(L.table(spark, sf_dir, "orders")))
    text = F.concat(F.lit("Deposits and Credits ("), F.col("n").cast("string"), F.lit(") $"), L.money_text(F.col("credits")), F.lit("\nTotal debits (3)\n-$"), L.money_text(F.col("debits")))
    found = totals.select("doc", hints.stated_totals(F.when(F.col("doc") % 4 != 0, text).otherwise("none here")).alias("s"))
    return found.select("doc", "s.credit_count", S.cents_of(F.col("s.total_credits")).alias("credits"), "s.debit_count", S.cents_of(F.col("s.total_debits")).alias("debits"))


def html_strip(spark, sf_dir):
    return L.table(spark, sf_dir, "pages").select("page_id", S.strip_html(F.col("html")).alias("text"))


def page_source(spark, sf_dir):
    embedded = orders(spark, sf_dir).filter("id % 5 <> 0").select(F.col("o_custkey").alias("doc"), F.col("id").alias("page"), F.repeat(F.lit("é"), (F.col("id") % 400).cast("int")).alias("text"))
    ocr = orders(spark, sf_dir).filter("id % 3 <> 0").select(F.col("o_custkey").alias("doc"), F.col("id").alias("page"), F.when(F.col("id") % 2 == 0, "ocr").otherwise("").alias("markdown"))
    pages = selection.read_pages(embedded, ocr)
    return pages.select("doc", "page", "source", F.length("text").cast("bigint").alias("characters"))


def best_attempt(spark, sf_dir):
    """Half of the documents lost their money at the first attempt."""
    line = F.concat_ws(" ", F.date_format("o_orderdate", "MM/dd"), F.lit("REF"), F.col("id").cast("string"), F.format_number(F.col("c") / 100, 2))
    full = by_customer(spark, sf_dir, line).select("doc", F.lit(1).alias("page"), F.lit(2).alias("attempt"), F.col("text").alias("markdown"))
    bare = F.regexp_replace("markdown", r" [\d,]+\.\d\d", "")
    first = full.withColumns({"attempt": F.lit(1), "markdown": F.when(F.col("doc") % 2 == 0, bare).otherwise(F.col("markdown"))})
    return selection.best_attempt(first.unionByName(full)).select("doc", "page", "attempt", "retried")


def metadata_merge(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    customers = L.table(spark, sf_dir, "customer")
    heuristic = customers.select(
        k.alias("doc"), F.lit("Guess").alias("company_name"), F.col("c_name").alias("account_name"), F.when(k % 2 == 0, "123456").alias("account_number"),
        F.lit("EUR").alias("currency"), F.lit("1992-01-01").alias("period_from"), none.alias("period_to"), F.when(k % 3 == 0, 5.0).alias("opening"), F.lit(None).cast("double").alias("closing"),
    )
    structured = customers.filter(k % 5 != 0).select(
        k.alias("doc"), F.when(k % 4 == 0, " null ").otherwise(" Acme ").alias("company_name"), F.lit("").alias("account_name"), F.lit("99").alias("account_number"),
        F.when(k % 2 == 0, "usd").alias("currency"), F.lit("01/02/1993").alias("period_from"), F.lit("later").alias("period_to"), F.lit("1,000.50").alias("opening"), F.lit("(20)").alias("closing"),
    )
    return selection.merge_metadata(heuristic, structured)


def canonical_rows(spark, sf_dir):
    id_ = F.col("id")
    money = F.format_number(F.col("c") / 100, 2)
    rows = orders(spark, sf_dir).select(
        "id",
        F.lit(5).cast("bigint").alias("page_floor"),
        F.lit(8).cast("bigint").alias("page_ceil"),
        F.when(id_ % 6 == 0, None).otherwise((id_ % 12).cast("string")).alias("page"),
        F.lit(" null ").alias("date_raw"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_iso"),
        pick(id_ % 7, [F.lit("BALANCE B/F"), F.lit("Sub-total"), F.lit("n/a"), F.lit("Total due"), F.lit("subtotally fine"), F.lit(" x "), F.lit("")]).alias("description"),
        F.lit("").alias("reference"),
        F.when(id_ % 3 == 0, money).alias("credit"),
        F.when(id_ % 5 == 0, money).alias("debit"),
        F.lit("$1").alias("balance"),
    )
    return reads.canonical_rows(rows).select("id", "page", "date_raw", "date_iso", "description", "credit", "debit", "amount", "balance", "ambiguous")


def turns(spark, sf_dir) -> DataFrame:
    return L.table(spark, sf_dir, "conversations")


def page_chunks(spark, sf_dir):
    pages = turns(spark, sf_dir).select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"))
    return reads.page_chunks(pages, 4)


def merge_chunks(spark, sf_dir):
    size, turn = F.length("text").cast("bigint"), F.col("turn")
    chunks = turns(spark, sf_dir).select(
        F.col("conv_id").alias("doc"), F.col("role").alias("reader"), F.lit(1).alias("reader_ord"), turn.alias("chunk"), (size % 7 != 0).alias("ok"),
        *[F.when(size % 3 != 0, F.sha2("text", 256)).alias(c) for c in reads.FIRST],
        *[F.when(size % 4 != 0, size).alias(c) for c in reads.LAST],
        F.when(size % 2 == 0, turn).alias("opening_cents"),
    )
    return reads.merge_chunks(chunks).select("doc", "reader", "company_name", "closing_cents", "opening_cents")


def merged_fields(spark, sf_dir):
    """All fields of merged chunks, each missing from other chunks than the rest."""
    size, turn = F.length("text").cast("bigint"), F.col("turn")
    chunks = turns(spark, sf_dir).select(
        F.col("conv_id").alias("doc"), F.col("role").alias("reader"), F.lit(1).alias("reader_ord"), turn.alias("chunk"), (size % 7 != 0).alias("ok"),
        *[F.when((size + turn) % (k + 2) != 0, F.concat_ws("-", F.lit(k), turn, size)).alias(c) for k, c in enumerate(reads.FIRST)],
        *[F.when((size + turn) % (k + 2) != 1, size * 100 + k).alias(c) for k, c in enumerate(reads.LAST)],
        F.when(size % 2 == 0, turn).alias("opening_cents"),
    )
    return reads.merge_chunks(chunks).select("doc", "reader", *reads.FIRST, *reads.LAST, "opening_cents")


def json_replies(spark, sf_dir):
    """Plain, fenced, surrounded, broken off and blank replies."""
    t = turns(spark, sf_dir)
    body = F.concat(F.lit('{"documentType":"bank_statement","balances":{"opening":"'), F.col("turn").cast("string"), F.lit('.50"},"metadata":{"branch":"a } \\" {"}}'))
    text = pick(
        (F.col("conv_id") + F.col("turn")) % 5,
        [body, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")), F.concat(F.lit("So "), body, F.lit(" it is {}.")), F.substring(body, F.lit(1), F.length(body) - 1), F.lit(" ")],
    )
    replies = t.select(F.col("conv_id").alias("doc"), F.col("role").alias("reader"), F.lit(1).alias("reader_ord"), F.col("turn").alias("chunk"), text.alias("text"))
    parsed = reads.chunk_scalars(reads.parse_replies(replies))
    return parsed.select("doc", "chunk", "ok", "document_type", "opening_cents", "branch")


def usage_totals(spark, sf_dir):
    size = F.length("text").cast("bigint")
    used = turns(spark, sf_dir).select(F.col("role").alias("reader"), (size % 7 != 0).alias("ok"), size.alias("input_tokens"), F.col("turn").alias("output_tokens"), (size * 3).alias("cost_micros"))
    return reads.usage_totals(used)


def layout_pages(spark, sf_dir) -> DataFrame:
    """A document in one of three layouts: a table, flattened lines, one cell per line."""
    rows = L.ledger(L.table(spark, sf_dir, "orders"))
    amount, balance = L.money_text(F.abs("cents")), L.money_text(F.col("balance"))
    day = F.date_format(F.to_date("day"), "yyyy-MM-dd")
    credit = F.col("cents") >= 0
    ref = F.concat(F.lit("Order "), F.col("id").cast("string"))
    cells = F.concat_ws("\n", day, ref, L.money_text(F.col("cents")), balance)
    bars = F.concat(F.lit("| "), F.concat_ws(" | ", day, ref, F.when(credit, "").otherwise(amount), F.when(credit, amount).otherwise(""), balance), F.lit(" |"))
    line = F.concat_ws(" ", day, ref, amount, balance)
    docs = rows.select("doc", "seq", pick(F.col("doc") % 3, [bars, line, cells]).alias("t"))
    docs = docs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("r"))
    head = F.when(F.col("doc") % 3 == 0, "| Txn Date | Particulars | Withdrawals | Deposits | Balance |\n|---|:--|---|---|---|\n").otherwise("")
    text = F.concat(head, F.array_join(F.transform("r", lambda x: x["t"]), "\n"))
    return docs.select("doc", F.lit(1).alias("page"), text.alias("text"), F.lit(None).cast("int").alias("year_hint"), F.lit("DMY").alias("date_order"))


def best_layout(spark, sf_dir):
    rows = parsers.best_layout(layout_pages(spark, sf_dir))
    return rows.groupBy("doc", "page", "mode").agg(F.count(F.lit(1)).alias("n"))


def parsed_rows(spark, sf_dir):
    rows = parsers.parse_documents(layout_pages(spark, sf_dir))
    return rows.select("doc", "seq", "date_iso", "description", S.cents_of(F.abs("amount")).alias("size"), S.cents_of(F.col("balance")).alias("balance"))


def statement_roundtrip(spark, sf_dir):
    """Rendered statements parse back to the ledger; a document's first sign has no balance to show it."""
    from ..operators import chain

    pages = L.statement_pages(L.ledger(L.table(spark, sf_dir, "orders")))
    rows = chain.resolve_signs(parsers.parse_documents(hints.with_hints(pages)))
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return rows.select("doc", "seq", cents("amount").alias("cents"), cents("balance").alias("balance"), "type")


def html_tables(spark, sf_dir):
    """Nations of a region as an HTML table, read back."""
    n = L.table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<TR><td class='a'>"), F.col("n_nationkey").cast("string"), F.lit("</td>\n<td> "), F.col("n_name"), F.lit(" &amp; <b>co</b></td></TR>"))
    docs = n.groupBy(F.col("n_regionkey").cast("bigint").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("t")))).alias("r"))
    text = F.concat(F.lit("<p>x</p><table border=1><tr><th>Key</th><th>Name</th></tr>"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.lit("</table>"))
    pages = docs.select("doc", F.lit(1).alias("page"), text.alias("text"), F.lit(None).cast("int").alias("year_hint"), F.lit("DMY").alias("date_order"))
    return parsers.html_tables(pages).select("doc", F.col("row_no").cast("bigint").alias("row_no"), F.array_join("cells", "|").alias("cells"))


def header_mapping(spark, sf_dir):
    heads = [
        ["Date", "Particulars", "Debit", "Credit", "Balance"], ["Posting Date", "Value Date", "Details", "Amount", "Type", "Running Balance"],
        ["", "Txn ID", "Narration", "DR", "CR."], ["Transaction", "Transaction Date", "Cheque No", "Withdrawals", "Paid In", "Balance", "Balance"],
    ]
    cells = pick(F.col("c_custkey") % 4, [F.array(*map(F.lit, h)) for h in heads])
    customers = spread(L.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    roles = customers.select(F.col("c_custkey").alias("id"), parsers.header_roles(cells).alias("r"))
    return roles.select("id", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("roles"), parsers.is_transaction_header(F.col("r")).alias("transactions"))


def tentative_types(spark, sf_dir):
    said = ["POS PURCHASE 12", "salary", "TRANSFER TO x credit", "credit card payment", "cheque", "ATM", "Atmosphere", "total number of checks paid 3", "Closing Balance"]
    text = pick(F.col("c_custkey") % 9, [F.lit(x) for x in said])
    return L.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), S.tentative_type(text).alias("type"), S.is_non_transaction(text).alias("non_transaction"), S.is_balance_line(text).alias("balance_line")
    )


QUERIES = {
    f.__name__: f
    for f in (
        amount_parse, text_keys, row_keys, date_parts, normalize_date, iso_days, int_or_null, date_order, year_hint, currency, classify,
        money_coverage, stated_totals, html_strip, page_source, best_attempt, metadata_merge, canonical_rows, page_chunks,
        merge_chunks, merged_fields, json_replies, usage_totals, best_layout, parsed_rows, statement_roundtrip, html_tables, header_mapping, tentative_types,
    )
}

C = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)"
ORACLES = {
    "amount_parse": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 IN (0, 1, 8) THEN {C} WHEN o_orderkey % 9 IN (2, 3, 4, 5) THEN -{C} END AS cents,
      CASE o_orderkey % 9 WHEN 7 THEN false WHEN 6 THEN false WHEN 1 THEN regexp_matches(replace(replace(replace(format('{{:,.2f}}', {C} / 100.0), ',', '#'), '.', ','), '#', '.'), '\\d\\.\\d{{2}}\\b|\\d,\\d{{3}}')
        WHEN 8 THEN {C} >= 100000 ELSE true END AS money_like FROM orders""",
    "text_keys": """SELECT c_custkey AS id, trim(regexp_replace(upper(' -' || c_name || '.. ltd/' || c_mktsegment || ' '), '[^A-Z0-9]+', ' ', 'g')) AS text_key,
      CASE WHEN c_custkey % 3 = 0 THEN 'X 12' ELSE '001' || c_custkey || '7' END AS account_key, CAST(NULL AS VARCHAR) AS none FROM customer""",
    "row_keys": f"WITH {READS} SELECT doc, reader, idx, key, loose FROM keyed",
    "date_parts": """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 9 IN (0, 1, 3, 4) THEN year(o_orderdate) WHEN o_orderkey % 9 = 2 THEN 2000 + year(o_orderdate) % 100 END AS INTEGER) AS year,
      CAST(CASE WHEN o_orderkey % 9 < 8 THEN month(o_orderdate) END AS INTEGER) AS month, CAST(CASE WHEN o_orderkey % 9 < 8 THEN day(o_orderdate) END AS INTEGER) AS day,
      o_orderkey % 9 < 8 AS date_like FROM orders""",
    "normalize_date": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 IN (0, 1, 3, 4) THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN o_orderkey % 9 = 2 THEN '20' || strftime(o_orderdate, '%y-%m-%d') WHEN o_orderkey % 9 < 8 THEN '1999-' || strftime(o_orderdate, '%m-%d') END AS day FROM orders""",
    "iso_days": """SELECT o_orderkey AS id, strftime(try_cast(strftime(o_orderdate, '%Y-%m-') || (28 + o_orderkey % 4) AS DATE), '%Y-%m-%d') AS day FROM orders""",
    "int_or_null": "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey WHEN 5 THEN 42 END AS n FROM orders",
    "date_order": """SELECT o_custkey AS doc, CASE WHEN o_custkey % 2 = 1 AND max(day(o_orderdate)) > 12 THEN 'MDY' ELSE 'DMY' END AS date_order FROM orders GROUP BY o_custkey""",
    "year_hint": """WITH y AS (SELECT o_custkey AS doc, year(o_orderdate) AS y, count(*) AS n, min(strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS f FROM orders GROUP BY ALL)
      SELECT doc, CAST(y AS INTEGER) AS year FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) AS r FROM y) WHERE r = 1""",
    "currency": """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 > 0 AND c_custkey % 2 >= c_custkey % 3 AND c_custkey % 2 >= c_custkey % 4 THEN 'BDT'
      WHEN c_custkey % 3 > 0 AND c_custkey % 3 >= c_custkey % 4 THEN 'USD' WHEN c_custkey % 4 > 0 THEN 'EUR' END AS currency FROM customer""",
    "classify": """WITH b AS (SELECT c_custkey AS id, (c_custkey % 2 + (c_custkey >> 1) % 2 + (c_custkey >> 2) % 2 + (c_custkey >> 3) % 2) / 8 AS bank,
        (c_custkey >> 4) % 2 * 0.4 AS invoice, (c_custkey >> 5) % 2 * 0.75 AS wallet FROM customer)
      SELECT id, CASE WHEN wallet > 0 THEN 'mobile_wallet_statement' WHEN bank >= invoice AND bank >= 0.3 THEN 'bank_statement' WHEN invoice >= 0.3 THEN 'invoice' ELSE 'document' END AS document_type,
        CAST(round(CASE WHEN wallet > 0 THEN 0.95 WHEN bank >= invoice AND bank >= 0.3 THEN bank + 0.2 WHEN invoice >= 0.3 THEN 0.6 ELSE 0.3 END, 6) AS DOUBLE) AS confidence, round(bank, 6) AS bank FROM b""",
    "money_coverage": """SELECT o_custkey AS doc, count(*) AS rows, count(*) FILTER (o_orderkey % 5 <> 0) AS money_rows, round(count(*) FILTER (o_orderkey % 5 <> 0) / count(*), 9) AS coverage FROM orders GROUP BY o_custkey""",
    "stated_totals": f"""WITH {LEDGER}, {TOTALS} SELECT doc, CASE WHEN doc % 4 <> 0 THEN n END AS credit_count, CASE WHEN doc % 4 <> 0 THEN credits END AS credits,
      CAST(CASE WHEN doc % 4 <> 0 THEN 3 END AS BIGINT) AS debit_count, CASE WHEN doc % 4 <> 0 THEN debits END AS debits FROM totals""",
    "html_strip": """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS text FROM pages""",
    "page_source": """WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 400 END AS e,
        CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END END AS o FROM orders)
      SELECT doc, page, CASE WHEN e >= 200 OR coalesce(o, 0) = 0 THEN 'embedded-text' ELSE 'glm-ocr' END AS source,
        CASE WHEN e >= 200 THEN e WHEN o > 0 THEN o ELSE coalesce(e, 0) END AS characters FROM p WHERE e IS NOT NULL OR o IS NOT NULL""",
    "best_attempt": """SELECT o_custkey AS doc, 1 AS page, CASE WHEN o_custkey % 2 = 0 AND count(*) >= 3 THEN 2 ELSE 1 END AS attempt, o_custkey % 2 = 0 AND count(*) >= 3 AS retried FROM orders GROUP BY o_custkey""",
    "metadata_merge": """WITH c AS (SELECT *, c_custkey AS k, c_custkey % 5 <> 0 AS s FROM customer)
      SELECT k AS doc, CASE WHEN s AND k % 4 <> 0 THEN 'Acme' ELSE 'Guess' END AS company_name, c_name AS account_name,
        CASE WHEN s THEN '99' WHEN k % 2 = 0 THEN '123456' END AS account_number, CASE WHEN s AND k % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
        CASE WHEN s THEN '1993-02-01' ELSE '1992-01-01' END AS period_from, CASE WHEN s THEN 'later' END AS period_to,
        CASE WHEN k % 3 = 0 THEN 5.0::DOUBLE WHEN s THEN 1000.5::DOUBLE END AS opening, CASE WHEN s THEN -20.0::DOUBLE END AS closing FROM c""",
    "canonical_rows": f"""WITH o AS (SELECT o_orderkey AS id, {C} AS c, o_orderkey % 3 = 0 AS cr, o_orderkey % 5 = 0 AS dr, o_orderkey % 7 AS k, o_orderdate FROM orders)
      SELECT id, CASE WHEN id % 6 = 0 THEN 5 ELSE least(8, greatest(5, id % 12)) END AS page, CAST(NULL AS VARCHAR) AS date_raw, strftime(o_orderdate, '%Y-%m-%d') AS date_iso,
        CASE k WHEN 0 THEN 'BALANCE B/F' WHEN 1 THEN 'Sub-total' WHEN 3 THEN 'Total due' WHEN 4 THEN 'subtotally fine' WHEN 5 THEN 'x' END AS description,
        CASE WHEN cr THEN c END AS credit, CASE WHEN dr THEN c END AS debit, CASE WHEN cr AND NOT dr THEN c WHEN dr AND NOT cr THEN -c END AS amount, 100::BIGINT AS balance, cr AND dr AS ambiguous
      FROM o WHERE cr OR dr OR k IN (4, 5)""",
    "page_chunks": """SELECT doc, page, chunk, chunk = 0 AS is_first, chunk = max(chunk) OVER (PARTITION BY doc) AS is_last
      FROM (SELECT conv_id AS doc, turn + 1 AS page, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS chunk FROM conversations)""",
    "merge_chunks": """WITH t AS (SELECT conv_id AS doc, role AS reader, turn, text, length(text) AS n FROM conversations WHERE length(text) % 7 <> 0)
      SELECT doc, reader, min_by(sha256(text), turn) FILTER (n % 3 <> 0) AS company_name, max_by(n, turn) FILTER (n % 4 <> 0) AS closing_cents,
        (SELECT CASE WHEN u.n % 2 = 0 THEN u.turn END FROM t u WHERE u.doc = t.doc AND u.reader = t.reader ORDER BY u.turn LIMIT 1) AS opening_cents
      FROM t GROUP BY doc, reader""",
    "merged_fields": "WITH t AS (SELECT conv_id AS doc, role AS reader, turn, length(text) AS n FROM conversations WHERE length(text) % 7 <> 0) SELECT doc, reader, "
    + ", ".join(f"min_by('{k}-' || turn || '-' || n, turn) FILTER ((n + turn) % {k + 2} <> 0) AS {c}" for k, c in enumerate(reads.FIRST))
    + ", " + ", ".join(f"max_by(n * 100 + {k}, turn) FILTER ((n + turn) % {k + 2} <> 1) AS {c}" for k, c in enumerate(reads.LAST))
    + """, (SELECT CASE WHEN u.n % 2 = 0 THEN u.turn END FROM t u WHERE u.doc = t.doc AND u.reader = t.reader ORDER BY u.turn LIMIT 1) AS opening_cents
      FROM t GROUP BY doc, reader""",
    "json_replies": """SELECT conv_id AS doc, turn AS chunk, (conv_id + turn) % 5 < 3 AS ok, CASE WHEN (conv_id + turn) % 5 < 3 THEN 'bank_statement' END AS document_type,
      CASE WHEN (conv_id + turn) % 5 < 3 THEN turn * 100 + 50 END AS opening_cents, CASE WHEN (conv_id + turn) % 5 < 3 THEN 'a } " {' END AS branch FROM conversations""",
    "usage_totals": """SELECT role AS reader, count(*) AS chunks, count(*) FILTER (length(text) % 7 = 0) AS failed, CAST(sum(length(text)) AS BIGINT) AS input_tokens,
      CAST(sum(turn) AS BIGINT) AS output_tokens, CAST(sum(length(text) * 3) AS BIGINT) AS cost_micros FROM conversations GROUP BY ROLLUP (role)""",
    "best_layout": """SELECT o_custkey AS doc, 1 AS page, CASE o_custkey % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'lines' ELSE 'cells' END AS mode, count(*) AS n FROM orders GROUP BY o_custkey""",
    "parsed_rows": f"WITH {LEDGER} SELECT doc, seq, day AS date_iso, 'Order ' || id AS description, abs(cents) AS size, balance FROM ledger",
    "statement_roundtrip": f"""WITH {LEDGER} SELECT doc, seq, CASE WHEN seq = 1 THEN -abs(cents) ELSE cents END AS cents, balance,
      CASE WHEN seq = 1 THEN 'debit' ELSE type END AS type FROM ledger""",
    "html_tables": """SELECT n_regionkey::BIGINT AS doc, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, n_nationkey || '|' || n_name || ' & co' AS cells FROM nation
      UNION ALL SELECT DISTINCT n_regionkey::BIGINT, 1::BIGINT, 'Key|Name' FROM nation""",
    "header_mapping": """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '0,1,-1,2,3,4,-1,-1' WHEN 1 THEN '0,2,-1,-1,-1,5,4,3' WHEN 2 THEN '-1,2,1,3,4,-1,-1,-1' ELSE '1,0,2,3,4,5,-1,-1' END AS roles,
      c_custkey % 4 <> 2 AS transactions FROM customer""",
    "tentative_types": """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' WHEN 2 THEN 'credit' WHEN 5 THEN 'debit' WHEN 7 THEN NULL END AS type,
      c_custkey % 9 = 8 AS non_transaction, c_custkey % 9 IN (7, 8) AS balance_line FROM customer""",
}
