"""Queries that run whole jobs, and on what surrounds them: attempts, refusals, reports, projections; with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import hints, jobs, parsers, reads, result, selection
from ..sources import records
from ..sources.folders import staged
from . import ledger as L
from .chain_queries import ORACLES as CHAIN_ORACLES
from .chain_queries import SCALAR_SQL, outcome
from .sql import LEDGER, READS, TOTALS, VOTE


def ledger_of(spark, sf_dir) -> DataFrame:
    return L.ledger(L.table(spark, sf_dir, "orders"))


def analysis(spark, sf_dir):
    """Pages to a summary and its self-check, in one call."""
    done = jobs.analyze(L.analysis_pages(ledger_of(spark, sf_dir)))
    cents = lambda c: S.cents_of(F.col(c)).alias(c)
    return done.summary.select(
        "doc", "transactions", "credits_n", "debits_n", *[cents(c) for c in ("total_credits", "total_debits", "net", "opening", "closing")], "chain_breaks",
        "consistent", "closes", "count_ok", "credits_ok", "debits_ok",
    )


def metadata(spark, sf_dir):
    """What a document's text says of itself, printed totals, balances and period included."""
    pages = staged(L.analysis_pages(ledger_of(spark, sf_dir)), "pages")
    found = hints.document_metadata(hints.document_hints(pages))
    return found.select(
        "doc", "company_name", "account_name", "account_number", "currency", F.col("class.document_type").alias("document_type"),
        F.round("class.confidence", 6).alias("confidence"), F.col("period.from").alias("period_from"), F.col("period.to").alias("period_to"),
        S.cents_of(F.col("opening")).alias("opening"), S.cents_of(F.col("closing")).alias("closing"), "stated.credit_count",
        S.cents_of(F.col("stated.total_credits")).alias("total_credits"), "stated.debit_count", S.cents_of(F.col("stated.total_debits")).alias("total_debits"),
    )


def consensus_of(spark, sf_dir) -> jobs.Consensus:
    return jobs.consensus(L.replies(ledger_of(spark, sf_dir)))


def consensus_rows(spark, sf_dir):
    """Replies to accepted rows, in one call."""
    return consensus_of(spark, sf_dir).accepted.select(
        "doc", "key", F.col("occurrence").cast("bigint").alias("occurrence"), "matched_by", F.size("readers").alias("readers"), "date_iso", "amount", "balance", "description"
    )


def consensus_verdict(spark, sf_dir):
    """Replies to verdicts, in one call; no row for documents that are refused."""
    found = consensus_of(spark, sf_dir)
    kinds = found.scalars.select("doc", F.col("document_type.value").alias("document_type"), F.col("account_number.votes").cast("bigint").alias("votes"))
    return found.results.join(kinds, "doc").select(
        "doc", "document_type", "votes", "verdict", "transactions", "total_credits", "total_debits", "net", "opening", "closing", "closes"
    )


def refused_documents(spark, sf_dir):
    """What the consensus job refuses, which only the attempts decide."""
    return reads.refused(final_of(spark, sf_dir))


def final_of(spark, sf_dir, *more: str) -> DataFrame:
    """The attempt that counts of each chunk, with ``more`` of its columns."""
    parsed = reads.parse_replies(L.replies(ledger_of(spark, sf_dir)))
    return reads.final_attempts(parsed.select("doc", "reader", "chunk", "attempt", "ok", "reason", *more))


def reader_report(spark, sf_dir):
    """Two failures are shown of each reader."""
    more = ("reader_ord", "page_floor", "page_ceil", "reply", "duration_ms", "input_tokens", "output_tokens", "cost_micros")
    final = staged(final_of(spark, sf_dir, *more), "final-attempts")
    report = reads.reader_report(final, reads.chunk_rows(final), 2)
    said = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["chunk"], e["reason"])), "; ")
    return report.withColumn("errors", said)


def chunk_attempts(spark, sf_dir):
    final = final_of(spark, sf_dir)
    return final.select("doc", "reader", "chunk", F.col("attempt").cast("bigint").alias("attempt"), "ok", "reason", reads.is_retryable(F.col("reason")).alias("retryable"))


def blank_pages(spark, sf_dir):
    """Pages of nothing, of white space and of text."""
    id_ = F.col("o_orderkey")
    blank = F.when(id_ % 5 == 0, F.lit(None).cast("string")).when((id_ % 5 == 1) | (F.col("o_custkey") % 6 == 0), "\u00a0 \t\n").otherwise("x")
    pages = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), id_.alias("page"), blank.alias("text"))
    kept = jobs.readable(pages).groupBy("doc").agg(F.count(F.lit(1)).alias("kept"))
    return jobs.blank_pages(pages).join(kept, "doc", "left").na.fill(0, ["kept"])


def records_of(spark, sf_dir) -> DataFrame:
    """Customers as stored records, with a read page and a result where they got so far."""
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed"))), (k % 4 + 1).cast("int"))
    page = F.struct(F.lit(1).alias("page"), F.col("c_name").alias("text"))
    done = F.struct(F.lit("bank_statement").alias("document_type"), F.struct(k.alias("transactions")).alias("summary"))
    return L.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), status.alias("status"),
        F.struct(F.col("c_name").alias("original_name"), k.alias("size_bytes"), F.lit("1998-01-01").alias("uploaded_at"), F.lit("/x").alias("stored_path")).alias("file"),
        (k % 101).alias("progress"), F.when(k % 4 >= 2, F.struct(F.array(page).alias("pages"))).alias("raw"), F.when(k % 4 == 2, done).alias("processed"),
        F.when(k % 4 == 3, "no pages").alias("error"),
    )


def record_summaries(spark, sf_dir):
    return records.summaries(records_of(spark, sf_dir)).select("id", "status", "file.original_name", "file.size_bytes", "progress", "document_type", "transactions", "error")


def record_parts(spark, sf_dir):
    """Stored pages and results of the records that are ready."""
    rows = records_of(spark, sf_dir)
    raw = records.part(rows, "raw").select("id", F.size("raw.pages").alias("pages"))
    return raw.join(records.part(rows, "processed").select("id", "processed.summary.transactions"), "id")


def analysed_again(spark, sf_dir):
    """Stored pages go through analysis once more; records without any are named."""
    pages, none = records.to_analyse_again(records_of(spark, sf_dir))
    return pages.select(F.col("doc").alias("id"), "text").unionByName(none.select("id", F.lit(None).cast("string").alias("text")))


def clipped(spark, sf_dir):
    """Texts clipped to 40 characters, and their first line of 20."""
    t = F.col("text")
    return L.table(spark, sf_dir, "conversations").select("conv_id", "turn", S.clip(t, 40).alias("text"), S.clip_line(t, 20).alias("line"))


def json_rows(spark, sf_dir):
    """Every property is sent, null or not."""
    row = F.struct("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"), F.struct(F.lit(None).cast("string").alias("a")).alias("inner"))
    return L.table(spark, sf_dir, "nation").select("n_nationkey", S.json_text(row).alias("body"))


def duplicate_urls(spark, sf_dir):
    backends = L.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".example.org"), F.when(F.col("s_suppkey") % 2 == 0, "/").otherwise("")).alias("url")
    )
    return records.duplicate_urls(backends).select("url", F.array_join("ids", ",").alias("ids"))


def first_disputes(spark, sf_dir):
    """Three of each document, fields first."""
    _, disputes, scalars = outcome(spark, sf_dir)
    none = F.lit(None).cast("string")
    both = disputes.select("doc", "kind", none.alias("field"), "key", "reader").unionByName(
        result.field_disputes(scalars).select("doc", "kind", "field", none.alias("key"), none.alias("reader"))
    )
    return result.first_disputes(both, 3).select("doc", F.col("place").cast("bigint").alias("place"), "kind", "field")


def display_rows(spark, sf_dir):
    from .chain_queries import reads_of

    from ..operators import vote

    shown = result.display_rows(vote.vote_rows(*reads_of(spark, sf_dir))[0])
    return shown.select("doc", "key", F.col("occurrence").cast("bigint").alias("occurrence"), "day", "type", *[F.round(c, 2).alias(c) for c in ("credit", "debit", "amount", "balance")])


def upload_filter(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".pdf.txt"))
    mime = F.when(k % 5 == 0, "application/pdf").when(k % 5 == 1, "text/plain")
    return L.table(spark, sf_dir, "part").select(k.alias("id"), S.is_pdf(mime, name).alias("pdf"))


def structured_metadata(spark, sf_dir):
    """A model's replies on first pages fill and overrule what the text says."""
    k = F.col("c_custkey")
    body = S.json_text(F.struct(F.col("c_name").alias("companyName"), F.when(k % 2 == 0, "null").otherwise("77").alias("accountNumber"), F.lit("01/02/1993").alias("periodFrom"), F.lit("1,000.50").alias("openingBalance")))
    text = F.when(k % 5 == 0, "no idea").when(k % 5 == 1, F.concat(F.lit("Sure: "), body, F.lit(" - done"))).otherwise(body)
    customers = L.table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    guess = customers.select(
        k.alias("doc"), F.lit("Guess").alias("company_name"), none.alias("account_name"), F.lit("55").alias("account_number"), F.lit("EUR").alias("currency"),
        none.alias("period_from"), none.alias("period_to"), F.when(k % 3 == 0, 5.0).alias("opening"), F.lit(None).cast("double").alias("closing"),
    )
    return selection.merge_metadata(guess, reads.structured_metadata(customers.select(k.alias("doc"), text.alias("text"))))


def classify_others(spark, sf_dir):
    """The classes that :func:`classify` of the scalar queries does not meet."""
    said = [
        "Credit card\nMinimum payment due\nPayment due date\nCredit limit", "RECEIPT\nCash tendered\nCashier: Jo\nThank you for coming",
        "Pay slip\nGross pay\nNet pay\nDeductions", "Payslip\nNet pay",
    ]
    k = F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, said)), (k % 4 + 1).cast("int"))
    rows = L.table(spark, sf_dir, "customer").select(k.alias("id"), hints.classify(hints.class_scores(text)).alias("c"))
    return rows.select("id", "c.document_type", F.round("c.confidence", 6).alias("confidence"))


#: A phrase for each signal of a class, in the classes' order.
SAID = {
    "bank_statement": ("bank statement", "opening balance", "closing balance", "deposit", "iban", "available balance", "transaction detail", "statement date"),
    "mobile_wallet_statement": ("wallet", "cash in", "send money", "merchant payment"),
    "credit_card_statement": ("credit card", "minimum payment", "payment due date", "credit limit", "card no"),
    "invoice": ("invoice", "bill to", "subtotal", "amount due", "po number"),
    "receipt": ("receipt", "cash tendered", "cashier", "thank you for"),
    "payslip": ("pay slip", "gross pay", "net pay", "deductions", "employee id"),
}


def classes_by_signal(spark, sf_dir):
    """Texts of any mix of the classes' signals: of class j signal i is said if k // (i + 1) + j is a multiple of 2 + j % 3."""
    k = F.col("c_custkey")
    said = [F.when((F.floor(k / (i + 1)) + j) % (2 + j % 3) == 0, F.lit(x)) for j, own in enumerate(SAID.values()) for i, x in enumerate(own)]
    rows = L.table(spark, sf_dir, "customer").select(k.alias("id"), hints.classify(hints.class_scores(F.concat_ws("; ", *said))).alias("c"))
    return rows.select("id", "c.document_type", F.round("c.confidence", 6).alias("confidence"))


def classes_sql() -> str:
    """The same by arithmetic on the key alone."""
    found = [" + ".join(f"CAST((c_custkey // {i + 1} + {j}) % {2 + j % 3} = 0 AS INTEGER)" for i in range(len(own))) for j, own in enumerate(SAID.values())]
    shares = ", ".join(f"({n}) / {len(own)}::DOUBLE" for n, own in zip(found, SAID.values(), strict=True))
    names = ", ".join(f"'{n}'" for n in SAID)
    return f"""WITH s AS (SELECT c_custkey AS id, [{shares}] AS s FROM customer), b AS (SELECT id, s, list_max(s) AS best, [{names}][list_position(s, list_max(s))] AS name FROM s),
      w AS (SELECT *, name = 'bank_statement' AND s[2] >= 0.5 AS wallet FROM b)
      SELECT id, CASE WHEN wallet THEN 'mobile_wallet_statement' WHEN best >= 0.3 THEN name ELSE 'document' END AS document_type,
        round(CASE WHEN wallet THEN s[2] WHEN best >= 0.3 THEN least(1.0, best + 0.2) ELSE 0.3 END, 6)::DOUBLE AS confidence FROM w"""


def mixed_tables(spark, sf_dir):
    """Pipe and HTML tables on one page, and lines that go on under the last date."""
    k = F.col("c_custkey").cast("string")
    pipe = F.concat(F.lit("| Date | Details | Debit | Credit | Balance |\n|---|---|---|---|---|\n| 1995-02-03 | Fee "), k, F.lit(" | 5.00 | | 95.00 |\n"))
    html = F.concat(F.lit("<table><tr><th>Date</th><th>Narration</th><th>Amount</th><th>Type</th></tr><tr><td>1995-02-04</td><td>Pay "), k, F.lit("</td><td>6.00</td><td>CR</td></tr></table>"))
    lines = F.concat(F.lit("1995-02-05 Bread "), k, F.lit(" 7.00 88.00\nand a Cake 8.00 80.00\n1995-02-06 only words here"))
    pages = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(F.array(F.concat(html, F.lit("\n"), pipe), lines)).alias("p", "text"))
    pages = pages.select("doc", (F.col("p") + 1).alias("page"), "text", F.lit(None).cast("int").alias("year_hint"), F.lit("DMY").alias("date_order"))
    rows = parsers.parse_documents(pages)
    return rows.select("doc", "seq", "mode", "date_iso", "description", F.round("amount", 2).alias("amount"), "type", "desc_only", "continuation")


def layout_contest(spark, sf_dir):
    """Pages that two layouts can read: the fuller reading wins, on a tie the table."""
    k = F.col("c_custkey").cast("string")
    head = "| Date | Details | Amount | Balance |\n|---|---|---|---|\n"
    row = F.concat(F.lit("| 1995-02-03 | Row "), k, F.lit(" | 5.00 | 95.00 |"))
    line = F.concat(F.lit("1995-02-04 Line "), k, F.lit(" 6.00 101.00"))
    cells = F.concat(F.lit("1995-02-05\nCell "), k, F.lit("\n7.00\n108.00"))
    tie = F.concat_ws("\n", F.concat(F.lit(head), row), row)
    lines = F.concat_ws("\n", F.concat(F.lit(head), row), line, line)
    cell = F.concat_ws("\n", cells, line, cells, cells)
    pages = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(F.array(tie, lines, cell)).alias("p", "text"))
    pages = pages.select("doc", (F.col("p") + 1).alias("page"), "text", F.lit(None).cast("int").alias("year_hint"), F.lit("DMY").alias("date_order"))
    return parsers.best_layout(pages).groupBy("doc", "page", "mode").agg(F.count(F.lit(1)).alias("n"))


def layouts_of_ledgers(spark, sf_dir):
    """Ledgers printed 25 rows to a page, even documents as tables, others as lines among table rows: which layout reads each page, and what it reads."""
    rows = ledger_of(spark, sf_dir).withColumn("page", F.floor((F.col("seq") - 1) / 25).cast("int") + 1)
    size, balance = (F.format_number(F.abs(c) / 100, 2) for c in (F.col("cents"), F.col("balance")))
    said = F.concat(F.lit("Order "), F.col("id").cast("string"))
    table_row = F.concat(F.lit("| "), F.col("day"), F.lit(" | "), said, F.lit(" | "), size, F.lit(" | "), balance, F.lit(" |"))
    as_table = (F.col("doc") % 2 == 0) | (F.col("seq") % 3 == 0)
    line = F.when(as_table, table_row).otherwise(F.concat_ws(" ", "day", said, size, balance))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda r: r["line"])
    pages = rows.groupBy("doc", "page").agg(F.array_join(lines, "\n").alias("body"))
    text = F.concat(F.lit("| Date | Details | Amount | Balance |\n|---|---|---|---|\n"), F.col("body"))
    pages = pages.select("doc", "page", text.alias("text"), F.lit(None).cast("int").alias("year_hint"), F.lit("DMY").alias("date_order"))
    found = parsers.best_layout(staged(pages, "ledger-pages"))
    return found.groupBy("doc", "page", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.abs("amount") * 100)).cast("bigint").alias("cents"))


QUERIES = {
    f.__name__: f
    for f in (
        analysis, metadata, consensus_rows, consensus_verdict, refused_documents, reader_report, chunk_attempts, blank_pages, record_summaries,
        record_parts, analysed_again, clipped, json_rows, duplicate_urls, first_disputes, display_rows, upload_filter, structured_metadata, classify_others, classes_by_signal, mixed_tables, layout_contest, layouts_of_ledgers,
    )
}

#: The readers that could read, and their reads.
VOTERS = """voters AS (
  SELECT doc AS vd, k FROM (SELECT DISTINCT doc FROM ledger), generate_series(1, 3) AS g(k) WHERE doc % 10 <> 0 AND NOT (k = 3 AND doc % 5 = 0)
)"""
HEARD = (
    VOTE.replace("WHERE NOT (k = 2", "WHERE doc % 10 <> 0 AND NOT (k = 3 AND doc % 5 = 0) AND NOT (k = 2")
    .replace(", reads AS (", ", " + VOTERS + ", reads AS (", 1)
    .replace("CROSS JOIN generate_series(1, 3) AS r(k)", "JOIN voters r ON r.vd = d.doc")
)
#: Every attempt with its outcome, and the one that counts.
ATTEMPTS = f"""{LEDGER}, c AS (SELECT doc, (seq - 1) // 12 AS chunk, count(*) AS n FROM ledger GROUP BY ALL), a AS (
  SELECT doc, k, chunk, CASE WHEN k = 3 AND doc % 5 = 0 THEN 'not signed in' WHEN k = 2 AND doc % 10 = 0 THEN 'timed out' END AS reason, (doc + chunk + k) % 4 = 0 AS cut
  FROM c, generate_series(1, 3) AS r(k)
), f AS (SELECT *, CASE WHEN reason = 'not signed in' THEN 1 WHEN reason IS NOT NULL OR cut THEN 2 ELSE 1 END AS attempt FROM a)"""
DAY = "strftime(o_orderdate, '%Y-%m-%d')"
ORACLES = {
    "analysis": f"""WITH {LEDGER}, {TOTALS}, p AS (SELECT *, balance + CASE WHEN id % 31 = 0 THEN 100 ELSE 0 END AS printed FROM ledger), q AS (
        SELECT *, lag(printed) OVER (PARTITION BY doc ORDER BY seq) + cents <> printed AS off FROM p
      ), b AS (SELECT doc, count(*) FILTER (off) AS breaks, arg_max(printed, seq) AS last, count(*) FILTER (cents >= 0) AS cn FROM q GROUP BY doc)
      SELECT doc, n AS transactions, cn AS credits_n, n - cn AS debits_n, credits AS total_credits, debits AS total_debits, credits - debits AS net, opening,
        CASE WHEN doc % 3 = 0 THEN closing ELSE last END AS closing, breaks AS chain_breaks, breaks = 0 AS consistent,
        doc % 3 = 0 OR last = closing AS closes, doc % 5 <> 0 AS count_ok, doc % 4 <> 0 AS credits_ok, true AS debits_ok FROM totals JOIN b USING (doc)""",
    "metadata": f"""WITH {LEDGER}, {TOTALS}, d AS (SELECT doc, min(day) AS f, max(day) AS t, count(*) FILTER (cents >= 0) AS cn FROM ledger GROUP BY doc)
      SELECT doc, 'ACME BANK PLC' AS company_name, 'Customer ' || doc AS account_name, '00' || lpad(CAST(doc AS VARCHAR), 8, '0') AS account_number, 'USD' AS currency,
        'bank_statement' AS document_type, CAST(CASE WHEN doc % 3 = 0 THEN 0.825 ELSE 0.7 END AS DOUBLE) AS confidence, f AS period_from, t AS period_to, opening, CASE WHEN doc % 3 = 0 THEN closing END AS closing,
        cn + CASE WHEN doc % 5 = 0 THEN 1 ELSE 0 END AS credit_count, credits + CASE WHEN doc % 4 = 0 THEN 100 ELSE 0 END AS total_credits, n - cn AS debit_count, debits AS total_debits
      FROM totals JOIN d USING (doc)""",
    "consensus_rows": f"WITH {HEARD} SELECT doc, k AS key, occ AS occurrence, matched_by, readers, date_iso, amount, balance, description FROM accepted",
    "consensus_verdict": f"""WITH {HEARD}, {TOTALS}, m AS (SELECT doc, max(n) AS most FROM (SELECT doc, reader, count(*) AS n FROM reads GROUP BY ALL) GROUP BY doc),
      t AS (SELECT doc, count(*) AS c, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS credits, CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS debits FROM accepted GROUP BY doc),
      j AS (SELECT totals.doc, coalesce(c, 0) AS transactions, coalesce(t.credits, 0) AS total_credits, coalesce(t.debits, 0) AS total_debits, opening, closing, most FROM totals JOIN m USING (doc) LEFT JOIN t USING (doc))
      SELECT doc, CASE WHEN doc % 7 = 0 THEN 'other' ELSE 'bank_statement' END AS document_type, CAST(CASE WHEN doc % 5 = 0 THEN 2 ELSE 3 END AS BIGINT) AS votes,
        CASE WHEN transactions / greatest(most, transactions) >= 0.98 AND opening + total_credits - total_debits = closing THEN 'extracted' ELSE 'needs_review' END AS verdict,
        transactions, total_credits, total_debits, total_credits - total_debits AS net, opening, closing, opening + total_credits - total_debits = closing AS closes FROM j""",
    "refused_documents": "SELECT DISTINCT o_custkey AS doc, 1::BIGINT AS voted, 2::BIGINT AS needed FROM orders WHERE o_custkey % 10 = 0",
    "reader_report": f"""WITH {ATTEMPTS}, r AS (
        SELECT doc, k, bool_or(reason IS NULL) AS voted, count(*) FILTER (reason IS NULL) AS chunks_read, count(reason) AS chunks_failed,
          coalesce(string_agg((chunk + 1) || ':' || reason, '; ' ORDER BY chunk) FILTER (chunk < 2), '') AS errors, CAST(sum(attempt * 100 + k) AS BIGINT) AS duration_ms,
          CAST(sum(k * 10) AS BIGINT) AS input_tokens, CAST(sum(attempt) AS BIGINT) AS output_tokens, count(*) * 7 AS cost_micros FROM f GROUP BY doc, k
      ), x AS (SELECT doc, count(*) AS n, count(*) FILTER (id % 11 = 0) AS missed, count(*) FILTER (id % 17 = 0) AS doubled FROM ledger GROUP BY doc)
      SELECT doc, 'r' || k AS reader, voted, chunks_read, chunks_failed, errors, duration_ms, input_tokens, output_tokens, cost_micros,
        CASE WHEN NOT voted THEN 0 WHEN k = 1 THEN n WHEN k = 2 THEN n - missed ELSE n + doubled END AS transactions FROM r JOIN x USING (doc)""",
    "chunk_attempts": f"WITH {ATTEMPTS} SELECT doc, 'r' || k AS reader, chunk, CAST(attempt AS BIGINT) AS attempt, reason IS NULL AS ok, reason, coalesce(reason, '') <> 'not signed in' AS retryable FROM f",
    "blank_pages": """SELECT o_custkey AS doc, count(*) AS pages, count(*) FILTER (b) AS blank, bool_and(b) AS all_blank, CASE WHEN bool_and(b) THEN 0 ELSE count(*) END AS kept
      FROM (SELECT o_custkey, o_orderkey % 5 IN (0, 1) OR o_custkey % 6 = 0 AS b FROM orders) GROUP BY o_custkey""",
    "record_summaries": """SELECT CAST(c_custkey AS VARCHAR) AS id, ['queued', 'processing', 'completed', 'failed'][c_custkey % 4 + 1] AS status, c_name AS original_name, c_custkey AS size_bytes, c_custkey % 101 AS progress,
      CASE WHEN c_custkey % 4 = 2 THEN 'bank_statement' END AS document_type, CASE WHEN c_custkey % 4 = 2 THEN c_custkey END AS transactions, CASE WHEN c_custkey % 4 = 3 THEN 'no pages' END AS error FROM customer""",
    "record_parts": "SELECT CAST(c_custkey AS VARCHAR) AS id, 1 AS pages, c_custkey AS transactions FROM customer WHERE c_custkey % 4 = 2",
    "analysed_again": "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 >= 2 THEN c_name END AS text FROM customer",
    "clipped": """SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) > 40 THEN text[1:40] || chr(10) || '…[clipped]' ELSE coalesce(text, '') END AS text,
      CASE WHEN length(one) > 20 THEN one[1:19] || '…' ELSE one END AS line FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS one FROM conversations)""",
    "json_rows": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"name":' || CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || '"' ELSE 'null' END || ',"inner":{"a":null}}' AS body FROM nation""",
    "duplicate_urls": """SELECT 'https://n' || s_nationkey || '.example.org' AS url, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids FROM supplier GROUP BY s_nationkey HAVING count(*) > 1""",
    "first_disputes": f"""{SCALAR_SQL}, {VOTE.replace(LEDGER + ",", "", 1)}, d AS (
      SELECT doc, 'duplicate_row' AS kind, NULL AS field FROM placed WHERE agreed > 0 AND occ > agreed
      UNION ALL SELECT doc, 'unmatched_row', NULL FROM again WHERE agreed = 0
      UNION ALL SELECT doc, 'row_description', NULL FROM accepted WHERE matched_by <> 'exact' AND NOT agreed
      UNION ALL SELECT doc, 'field', field FROM scalars WHERE NOT agreed
    ) SELECT doc, place, kind, field FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY kind <> 'field', field, kind) AS place FROM d) WHERE place <= 3""",
    "display_rows": f"""WITH {VOTE} SELECT doc, k AS key, occ AS occurrence, date_iso AS day, CASE WHEN amount >= 0 THEN 'credit' ELSE 'debit' END AS type,
      CASE WHEN amount >= 0 THEN amount / 100 END AS credit, CASE WHEN amount < 0 THEN -amount / 100 END AS debit, amount / 100 AS amount, balance / 100 AS balance FROM accepted""",
    "upload_filter": "SELECT p_partkey AS id, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS pdf FROM part",
    "structured_metadata": """WITH c AS (SELECT *, c_custkey AS k, c_custkey % 5 <> 0 AS s FROM customer)
      SELECT k AS doc, CASE WHEN s THEN c_name ELSE 'Guess' END AS company_name, CAST(NULL AS VARCHAR) AS account_name, CASE WHEN s AND k % 2 = 1 THEN '77' ELSE '55' END AS account_number,
        'EUR' AS currency, CASE WHEN s THEN '1993-02-01' END AS period_from, CAST(NULL AS VARCHAR) AS period_to, CASE WHEN k % 3 = 0 THEN 5.0::DOUBLE WHEN s THEN 1000.5::DOUBLE END AS opening, CAST(NULL AS DOUBLE) AS closing FROM c""",
    "classes_by_signal": classes_sql(),
    "classify_others": """SELECT c_custkey AS id, ['credit_card_statement', 'receipt', 'payslip', 'payslip'][c_custkey % 4 + 1] AS document_type,
      CASE WHEN c_custkey % 4 = 3 THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence FROM customer""",
    "mixed_tables": """SELECT c_custkey AS doc, m.seq, m.mode, m.date_iso, replace(m.said, '#', CAST(c_custkey AS VARCHAR)) AS description, m.amount, m.type, m.words AS desc_only, m.goes_on AS continuation
      FROM customer, (VALUES (1::BIGINT, 'tables', '1995-02-03', 'Fee #', -5.0::DOUBLE, 'debit', false, false), (2, 'tables', '1995-02-04', 'Pay #', 6.0, 'credit', false, false),
        (3, 'lines', '1995-02-05', 'Bread #', 7.0, NULL, false, false), (4, 'lines', '1995-02-05', 'and a Cake', 8.0, NULL, false, true),
        (5, 'lines', '1995-02-06', 'only words here', NULL, NULL, true, false)) AS m(seq, mode, date_iso, said, amount, type, words, goes_on)""",
    "layouts_of_ledgers": f"""WITH {LEDGER} SELECT doc, CAST((seq - 1) // 25 + 1 AS INTEGER) AS page,
      CASE WHEN count(*) FILTER (doc % 2 <> 0 AND seq % 3 <> 0) > 0 THEN 'lines' ELSE 'tables' END AS mode, count(*) AS n, CAST(sum(abs(cents)) AS BIGINT) AS cents FROM ledger GROUP BY ALL""",
    "layout_contest": """SELECT c_custkey AS doc, page, mode, n FROM customer, (VALUES (1, 'tables', 2), (2, 'lines', 3), (3, 'cells', 3)) AS m(page, mode, n)""",
}
_VERDICT = CHAIN_ORACLES["verdict"]
_MONEY = "coalesce(currency || ' ', '') || format('{{:,.2f}}', {} / 100.0)".format


def _many(c: str, what: str) -> str:
    return f"{c} || ' {what}' || CASE WHEN {c} = 1 THEN '' ELSE 's' END"


#: The note of a result, put together from the verdict's figures once more.
SENTENCE_SQL = f"""WITH v AS ({_VERDICT}), k AS ({SCALAR_SQL}, {VOTE.replace(LEDGER + ",", "", 1)}
  SELECT doc, CAST(sum(f) AS BIGINT) AS fields, CAST(sum(r) AS BIGINT) AS rows FROM (
    SELECT doc, 0 AS f, 1 AS r FROM placed WHERE agreed > 0 AND occ > agreed
    UNION ALL SELECT doc, 0, 1 FROM again WHERE agreed = 0
    UNION ALL SELECT doc, 0, 1 FROM accepted WHERE matched_by <> 'exact' AND NOT agreed
    UNION ALL SELECT doc, 1, 0 FROM scalars WHERE NOT agreed
  ) GROUP BY doc
), p AS (SELECT o_custkey AS doc, (count(*) + 24) // 25 AS pages FROM orders GROUP BY o_custkey
), j AS (SELECT v.*, pages, coalesce(fields, 0) AS fields, coalesce(rows, 0) AS rows FROM v JOIN p USING (doc) LEFT JOIN k USING (doc)
), w AS (SELECT *, {_many("transactions", "row")} || ' on ' || {_many("pages", "page")} || ': ' || {_MONEY("total_credits")} || ' received, ' || {_MONEY("total_debits")} || ' paid.' AS head,
  concat_ws(', ', CASE WHEN fields > 0 THEN {_many("fields", "field")} || ' left open' END, CASE WHEN rows > 0 THEN {_many("rows", "row")} || ' without a second read' END,
    CASE WHEN NOT stated_ok THEN 'printed totals differ' END, CASE WHEN NOT closes THEN 'opening and net do not make closing' END,
    CASE WHEN NOT chain_ok THEN {_many("chain_breaks", "break")} || ' in the balance column' END) AS why FROM j)
SELECT doc, CASE WHEN verdict = 'extracted' THEN head || ' Every read agrees' || CASE WHEN provably_complete THEN ', and so do the printed totals.' ELSE '.' END
  ELSE head || ' To be checked: ' || CASE WHEN why = '' THEN 'too little agreement' ELSE why END || '.' END AS note FROM w"""
ORACLES["result_sentence"] = SENTENCE_SQL
