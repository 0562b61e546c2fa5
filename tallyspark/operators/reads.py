"""Readers' replies: recovering JSON, canonical rows, chunks of pages and their merge into one read."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import document_type, int_or_null, is_balance_line, iso_day, to_cents, trimmed_or_null
from .parsers import once

# What in a failure's message says that another try would not help.
FINAL_FAILURES = r"(?i)cancelled|empty|API_KEY|not signed in|not on this machine's PATH"
RETRIES = 1
#: A text without what only a lenient parser takes; characters one by one, which Java looks up in a table.
NO_LENIENCY = "^[^'" + "".join(rf"\x{n:02x}" for n in range(32)) + r"]*\z"
ROW = "struct<page:string,dateRaw:string,dateIso:string,description:string,reference:string,credit:string,debit:string,balance:string>"
REPLY = (
    "documentType string,"
    "metadata struct<companyName:string,accountName:string,accountNumber:string,accountType:string,branch:string,currency:string,"
    "statementPeriodFrom:string,statementPeriodTo:string,statementDate:string>,"
    "balances struct<opening:string,closing:string>,"
    "statedTotals struct<totalCredits:string,totalDebits:string,transactionCount:string>,"
    f"transactions array<{ROW}>"
)
FIRST = ("document_type", "company_name", "account_name", "account_number", "account_type", "branch", "currency", "period_from", "statement_date")
LAST = ("period_to", "closing_cents", "stated_credits", "stated_debits", "stated_count")


def _json_object(text: str | None) -> str | None:
    """The JSON of a reply: fenced or bare, or else its first whole object; None if it breaks off."""
    if not text or not text.strip():
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    body = (fenced[1] if fenced else text).strip()
    decoder = json.JSONDecoder()
    for at in dict.fromkeys((0, body.find("{"))):
        if at >= 0:
            try:
                value, end = decoder.raw_decode(body, at)
            except ValueError:
                continue
            if at or not body[end:].strip():
                return body[at:end]
    return None


@F.pandas_udf(T.StringType())
def json_object(replies: pd.Series) -> pd.Series:
    """The object in a reply's text, whatever stands around it; null for a reply that broke off."""
    return replies.map(_json_object, na_action=None)


def loose_json(text: Column) -> Column:
    """From the first opening to the last closing brace, if that is JSON."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & (last > first), F.substring(text, first, last - first + 1))
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def is_bare_object(text: Column) -> Column:
    """Whether a text is one JSON object, by the strict spelling, and nothing else; :func:`json_object` of it is the text itself.

    Spark's parsers pass over what follows a value. Behind it could stand no more than a bracket's
    end for the first of them, and a brace's end or a comma for the second: together, nothing.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    inner = F.concat(F.lit('{"a":'), text, F.lit("}"))
    # the parser that only skips also takes single quotes and bare control characters
    strict = F.when(text.rlike(NO_LENIENCY), F.size(F.json_object_keys(inner)) == 1).otherwise(F.try_parse_json(inner).isNotNull())
    shaped = text.startswith("{") & text.endswith("}") & ~text.contains("```")
    return F.coalesce(shaped & alone & strict, F.lit(False))


def recovered(replies: DataFrame) -> DataFrame:
    """``replies`` and ``ok``, ``reason`` and ``body``, the JSON object of a reply's text.

    A call that itself failed has its message in ``error``, if there is such a column. Python
    looks only at texts that are more or less than an object.
    """
    error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    found = replies.withColumn("bare", is_bare_object(F.col("text")))
    found = found.withColumn("found", json_object(F.when(error.isNull() & ~F.col("bare"), F.col("text"))))
    found = found.withColumn("body", F.when(error.isNull(), F.when(F.col("bare"), F.col("text")).otherwise(F.col("found"))))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    reason = F.coalesce(error, F.when(F.col("body").isNotNull(), None).when(blank, "the reply is empty").otherwise("no complete JSON object"))
    return found.withColumns({"ok": F.col("body").isNotNull(), "reason": reason}).select(*replies.columns, "ok", "reason", "body")


def parse_replies(replies: DataFrame) -> DataFrame:
    """``replies(doc, reader, reader_ord, chunk, text)`` and ``ok``, ``reason`` and the reply's parts; see :func:`recovered`."""
    return recovered(replies).withColumn("reply", F.from_json("body", REPLY)).drop("body")


def page_chunks(pages: DataFrame, size: int = 4) -> DataFrame:
    """Adds ``chunk`` (from 0) and whether it is the document's first or last; pages in order, ``size`` to a chunk."""
    by_page = Window.partitionBy("doc").orderBy("page")
    out = pages.withColumn("chunk", F.floor((F.row_number().over(by_page) - 1) / size).cast("bigint"))
    last = F.max("chunk").over(Window.partitionBy("doc"))
    return out.withColumns({"is_first": F.col("chunk") == 0, "is_last": F.col("chunk") == last})


def clamp_page(page: Column, floor: Column, ceiling: Column) -> Column:
    """The page within its chunk; a missing page is the chunk's first."""
    page = F.coalesce(page, floor)
    page = F.when(page < floor, floor).otherwise(page)
    return F.when(page > ceiling, ceiling).otherwise(page)


def canonical_rows(rows: DataFrame) -> DataFrame:
    """Raw text columns (page, date_raw, date_iso, description, reference, credit, debit, balance; page_floor, page_ceil) made canonical.

    Money is cents and two columns become one signed amount; with both filled the
    amount is unknown and the row ambiguous. Rows of nothing, and balance lines
    without money, go.
    """
    read = {c: trimmed_or_null(F.col(c)) for c in ("date_raw", "description", "reference")} | {c: to_cents(F.col(c)) for c in ("credit", "debit", "balance")}
    read |= {"date_iso": iso_day(F.col("date_iso")), "page": int_or_null(F.col("page"))}
    # one generated value: the filter would work its columns out again
    out = once(rows, "read", F.struct(*[v.alias(c) for c, v in read.items()]))
    credit, debit, said = (F.col("read")[c] for c in ("credit", "debit", "description"))
    out = out.filter(~(credit.isNull() & debit.isNull() & (said.isNull() | is_balance_line(said))))
    both = credit.isNotNull() & debit.isNotNull()
    return out.withColumns(
        {c: F.col("read")[c] for c in read}
        | {
            "page": clamp_page(F.col("read")["page"], F.col("page_floor"), F.col("page_ceil")),
            "amount": F.when(~both, F.coalesce(credit, -F.abs(debit))),
            "debit": F.abs(debit),
            "ambiguous": both,
        }
    ).drop("page_floor", "page_ceil", "read")


def chunk_rows(parsed: DataFrame, *more: str) -> DataFrame:
    """Parsed replies with (page_floor, page_ceil) as canonical rows, with ``more`` of their columns; ``idx`` is a row's place in its reply."""
    kept = ["doc", "reader", "reader_ord", "chunk", "page_floor", "page_ceil", *more]
    rows = parsed.filter("ok").select(*kept, F.posexplode("reply.transactions").alias("idx", "t"))
    names = {"dateRaw": "date_raw", "dateIso": "date_iso"}
    fields = ("page", "dateRaw", "dateIso", "description", "reference", "credit", "debit", "balance")
    return canonical_rows(
        rows.select(*kept, "idx", *[F.col(f"t.{f}").alias(names.get(f, f)) for f in fields])
    )


def chunk_scalars(parsed: DataFrame, *more: str | Column) -> DataFrame:
    """Parsed replies as one canonical row of scalar fields for each (document, reader, chunk), null where the reply failed, and ``more`` of their columns."""
    m, b, t = (lambda f, p=p: F.col(f"reply.{p}.{f}") for p in ("metadata", "balances", "statedTotals"))
    return parsed.select(
        "doc", "reader", "reader_ord", "chunk", "ok",
        document_type(F.col("reply.documentType")).alias("document_type"),
        trimmed_or_null(m("companyName")).alias("company_name"),
        trimmed_or_null(m("accountName")).alias("account_name"),
        trimmed_or_null(m("accountNumber")).alias("account_number"),
        trimmed_or_null(m("accountType")).alias("account_type"),
        trimmed_or_null(m("branch")).alias("branch"),
        F.upper(trimmed_or_null(m("currency"))).alias("currency"),
        iso_day(m("statementPeriodFrom")).alias("period_from"),
        iso_day(m("statementPeriodTo")).alias("period_to"),
        iso_day(m("statementDate")).alias("statement_date"),
        to_cents(b("opening")).alias("opening_cents"),
        to_cents(b("closing")).alias("closing_cents"),
        to_cents(t("totalCredits")).alias("stated_credits"),
        to_cents(t("totalDebits")).alias("stated_debits"),
        int_or_null(t("transactionCount")).alias("stated_count"),
        *more,
    )


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each (document, reader) that read any chunk.

    Most fields are of the first chunk that has them, those that a statement ends
    with of the last; the opening balance is the first chunk's that could be read,
    even where it has none.
    """
    seen = chunks.filter("ok")
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("chunk"))).alias(c) for c in FIRST]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("chunk"))).alias(c) for c in LAST]
    opening = F.min_by("opening_cents", "chunk").alias("opening_cents")
    return seen.groupBy("doc", "reader", "reader_ord").agg(*first, *last, opening)


def merged_rows(rows: DataFrame) -> DataFrame:
    """A reader's rows of all chunks; ``idx`` orders them by page, then as they came. It is a place, not a number, so that no row moves for it."""
    return rows.withColumn("idx", F.struct(F.coalesce("page", F.lit(0)).cast("bigint").alias("page"), "chunk", "idx")).drop("chunk")


def is_retryable(reason: Column) -> Column:
    """Whether a read that failed for this reason is tried again."""
    return ~F.coalesce(reason, F.lit("")).rlike(FINAL_FAILURES)


def final_attempts(replies: DataFrame, retries: int = RETRIES) -> DataFrame:
    """``replies(doc, reader, chunk, attempt, ok, reason, …)`` -> the attempt that counts of each chunk, ``attempt`` from 1.

    That is the first after which there is no other: it was read, failed for good, or
    used up the retries; attempts beyond it do not count. If all that there are could go
    on, it is the last of them. One attempt of each chunk is carried along, as the two rules make one order.
    """
    ends = F.col("ok") | ~is_retryable(F.col("reason")) | (F.col("attempt") > retries)
    row = F.struct(*[c for c in replies.columns if c not in ("doc", "reader", "chunk")])
    order = F.when(ends, F.struct(F.lit(0).alias("go_on"), F.col("attempt").alias("at"))).otherwise(F.struct(F.lit(1).alias("go_on"), (-F.col("attempt")).alias("at")))
    best = F.min_by(row, order).alias("a")
    return replies.groupBy("doc", "reader", "chunk").agg(best).select("doc", "reader", "chunk", "a.*")


def voters(replies: DataFrame) -> DataFrame:
    """Readers of whom at least one chunk could be read; the others do not vote."""
    return replies.groupBy("doc", "reader", "reader_ord").agg(F.bool_or("ok").alias("ok")).filter("ok").drop("ok")


def with_voters(replies: DataFrame) -> DataFrame:
    """Adds ``voters``: how many readers could read a chunk of the document, as :func:`voters` names them."""
    read = F.when(F.col("ok"), F.struct("reader", "reader_ord"))
    return replies.withColumn("voters", F.size(F.collect_set(read).over(Window.partitionBy("doc"))))


def refused(replies: DataFrame, quorum: int = 2) -> DataFrame:
    """``(doc, voted, needed)`` of the documents that fewer readers than the quorum could read: they get no verdict."""
    by_reader = replies.groupBy("doc", "reader").agg(F.bool_or("ok").alias("ok"))
    out = by_reader.groupBy("doc").agg(F.count_if("ok").alias("voted")).filter(F.col("voted") < quorum)
    return out.withColumn("needed", F.lit(quorum).cast("bigint"))


def reader_report(replies: DataFrame, rows: DataFrame, errors: int = 10) -> DataFrame:
    """Of each document and reader: whether it voted, chunks read and failed, rows, the first ``errors`` failures, usage and time."""
    failed = F.when(~F.col("ok"), F.struct((F.col("chunk") + 1).alias("chunk"), "reason"))
    used = ("duration_ms", "input_tokens", "output_tokens", "cost_micros")
    report = replies.groupBy("doc", "reader").agg(
        F.bool_or("ok").alias("voted"),
        F.count_if("ok").alias("chunks_read"),
        F.count_if(~F.col("ok")).alias("chunks_failed"),
        F.slice(F.array_sort(F.collect_list(failed)), 1, errors).alias("errors"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in used],
    )
    counts = rows.groupBy("doc", "reader").agg(F.count(F.lit(1)).alias("transactions"))
    return report.join(counts, ["doc", "reader"], "left").na.fill(0, ["transactions"])


def usage_totals(replies: DataFrame) -> DataFrame:
    """Tokens, cost and failures per reader, and over all readers as reader null; time too, where it was taken."""
    timed = [F.sum("duration_ms").alias("duration_ms")] if "duration_ms" in replies.columns else []
    return replies.rollup("reader").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_micros").alias("cost_micros"),
        *timed,
    )


STRUCTURED = (
    "companyName string, accountName string, accountNumber string, currency string, periodFrom string, periodTo string,"
    " openingBalance string, closingBalance string"
)


def structured_metadata(replies: DataFrame) -> DataFrame:
    """A model's replies on first pages ``(doc, text)`` as the columns that :func:`selection.merge_metadata` takes; replies without JSON go."""
    found = replies.select("doc", F.from_json(loose_json(F.col("text")), STRUCTURED).alias("s")).filter("s IS NOT NULL")
    names = {
        "company_name": "companyName", "account_name": "accountName", "account_number": "accountNumber", "currency": "currency",
        "period_from": "periodFrom", "period_to": "periodTo", "opening": "openingBalance", "closing": "closingBalance",
    }
    return found.select("doc", *[F.col(f"s.{v}").alias(k) for k, v in names.items()])
