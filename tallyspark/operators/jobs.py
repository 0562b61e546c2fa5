"""Whole jobs in one call: pages to an analysis, replies to a result. Each gives frames that may be read apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import staged, staging
from . import chain, hints, parsers, reads, repair, result, vote
from .spread import spread


def blank_pages(pages: DataFrame) -> DataFrame:
    """``(doc, pages, blank, all_blank)``: how many of a document's pages have no text."""
    empty = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    out = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.count_if(empty).alias("blank"))
    return out.withColumn("all_blank", F.col("blank") == F.col("pages"))


def readable(pages: DataFrame) -> DataFrame:
    """``pages`` without the documents of which every page is blank, which cannot be read."""
    return pages.join(blank_pages(pages).filter("all_blank").select("doc"), "doc", "left_anti")


@dataclass
class Analysis:
    #: The transactions, signed, repaired and marked where the balances break.
    rows: DataFrame
    #: One row per document: counts, sums, balances and the self-check.
    summary: DataFrame
    metadata: DataFrame


def analyze(pages: DataFrame) -> Analysis:
    """``pages(doc, page, text)`` of any statements, through parser, signs, repair and self-check.

    Signs are settled by the balances, damaged rows repaired by their neighbours, and
    signs settled again, as repaired balances say more. A printed opening or closing
    balance goes before the first and last balance of the rows. Documents without
    a readable page are left out; one without transactions has a summary of zeros.
    """
    # given pages are read twice, for blank documents and without them, and what gives them runs once
    pages = staged(readable(staged(pages, "given-pages")), "pages")
    hinted = staged(hints.document_metadata(hints.document_hints(pages), "year_hint", "date_order"), "metadata")
    metadata = hinted.drop("year_hint", "date_order")
    # read by the repair and by the join with what it hands on
    parsed = staged(parsers.parse_documents(pages.join(hinted.select("doc", "year_hint", "date_order"), "doc")), "parsed")
    signed = chain.resolve_signs(parsed)
    fixed = repair.repair(signed)
    kept = parsed.select("doc", "seq", "page", "date", "date_iso", "description", "reference")
    rows = staged(chain.mark_breaks(chain.resolve_signs(fixed)).join(kept, ["doc", "seq"]), "transactions")
    summary = metadata.select("doc", "opening", "closing", "stated", "currency").join(
        result.summarise_parsed(rows).withColumnsRenamed({"opening": "first_balance", "closing": "last_balance"}), "doc", "left"
    )
    counts = ("transactions", "credits_n", "debits_n", "total_credits", "total_debits", "net", "chain_breaks")
    summary = summary.withColumns(
        {"opening": F.coalesce("opening", "first_balance"), "closing": F.coalesce("closing", "last_balance")}
    ).na.fill(0, list(counts))
    return Analysis(rows, result.reconcile_parsed(summary.drop("first_balance", "last_balance"), F.col("stated")), metadata)


@dataclass
class Consensus:
    accepted: DataFrame
    disputes: DataFrame
    scalars: DataFrame
    results: DataFrame
    #: Documents that too few readers could read.
    refused: DataFrame
    report: DataFrame


def consensus(replies: DataFrame, quorum: int = 2) -> Consensus:
    """All attempts of all readers at all chunks, to accepted rows, voted fields, verdicts and a report.

    ``replies(doc, reader, reader_ord, chunk, attempt, error, text, page_floor, page_ceil,
    duration_ms, input_tokens, output_tokens, cost_micros)``. Of each chunk the attempt that
    counts is parsed and written once, without its text.
    A reader that failed at every chunk does not vote, and a document that fewer readers
    than the quorum could read gets no verdict.
    """
    # dealt out by document once: which attempt counts, who votes and the reply's parts are told where these lie
    tried = spread(reads.recovered(replies).drop("text"), "doc")
    parsed = reads.with_voters(reads.final_attempts(tried)).withColumn("reply", F.from_json("body", reads.REPLY)).drop("body")
    report = ("reason", "page_floor", "page_ceil", "duration_ms", "input_tokens", "output_tokens", "cost_micros", "voters")
    final = staged(reads.chunk_scalars(parsed, *report, F.struct("reply.transactions").alias("reply")), "final-attempts")
    refused = reads.refused(final, quorum)
    readers = reads.voters(final).join(refused, "doc", "left_anti")
    rows = staged(reads.merged_rows(reads.chunk_rows(final, "voters")), "read-rows")
    heard = F.col("voters") >= quorum
    accepted, row_disputes = vote.vote_rows(rows.filter(heard), readers, quorum)
    scalars = staged(vote.vote_scalars(reads.merge_chunks(final.filter(heard)), quorum), "voted-fields")
    placed = vote.in_printed_order(accepted, rows)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    disputes = row_disputes.select("doc", "kind", none("field", "string"), "key", "reader").unionByName(
        result.field_disputes(scalars).select("doc", "kind", "field", none("key", "string"), none("reader", "string"))
    )
    return Consensus(placed, disputes, scalars, result.results(placed, scalars, rows), refused, reads.reader_report(final, rows))


#: What kinds of job there are, by name.
HANDLERS: dict[str, Callable[[DataFrame], Analysis | Consensus]] = {"statement": analyze, "vote": consensus}


def run(kind: str, rows: DataFrame) -> Analysis | Consensus:
    """The job of a kind; an unknown kind is an error."""
    if kind not in HANDLERS:
        raise ValueError(f"no job of kind {kind!r}; there are {', '.join(sorted(HANDLERS))}")
    return HANDLERS[kind](rows)


def extract(pages: DataFrame, folder: str) -> None:
    """Pages to JSON files: one object per document, with its summary, metadata and ``rows``; nulls stay.

    A document's rows are one object, as a reader of the file has them. What the job stages is
    deleted once the files are written.
    """
    with staging(pages.sparkSession):
        done = analyze(pages)
        row = F.struct("seq", "page", "date_iso", "description", "amount", "balance", "type")
        rows = done.rows.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        about = F.struct("company_name", "account_name", "account_number", "period", "class").alias("metadata")
        whole = done.summary.join(done.metadata.select("doc", about), "doc").join(rows, "doc", "left")
        whole.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
