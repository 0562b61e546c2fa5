"""Which reading of a page counts, and whose metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import choose_page_text, normalize_date, page_source, parse_amount, trimmed
from .hints import money_coverage


def read_pages(embedded: DataFrame, ocr: DataFrame) -> DataFrame:
    """``(doc, page, source, text)`` from ``embedded(doc, page, text)`` and ``ocr(doc, page, markdown)``, either of which may lack a page."""
    both = embedded.withColumnRenamed("text", "embedded").join(ocr, ["doc", "page"], "full_outer")
    return both.select(
        "doc",
        "page",
        page_source(F.col("embedded"), F.col("markdown")).alias("source"),
        choose_page_text(F.col("embedded"), F.col("markdown")).alias("text"),
    )


def needs_retry(coverage: Column) -> Column:
    """A page of three dated lines or more, under 60 % of them with money, is read again at a higher resolution."""
    return (coverage["rows"] >= 3) & (coverage["coverage"] < 0.6)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """``attempts(doc, page, attempt, markdown)``: the first, unless it needs a retry and a later one reads more money lines, or as many and more lines."""
    seen = attempts.withColumn("c", money_coverage(F.col("markdown")))
    rank = F.struct(F.col("c.money_rows"), F.col("c.rows"), -F.col("attempt"))
    each = F.struct("attempt", "markdown", "c")
    pages = seen.groupBy("doc", "page").agg(F.min_by(each, "attempt").alias("first"), F.max_by(each, rank).alias("best"))
    kept = F.when(needs_retry(F.col("first.c")), F.col("best")).otherwise(F.col("first"))
    return pages.select("doc", "page", kept.alias("k")).select(
        "doc", "page", "k.attempt", "k.markdown", (F.col("k.attempt") > 1).alias("retried")
    )


def clean(text: Column) -> Column:
    kept = trimmed(text)
    return F.when(~F.lower(kept).isin("", "null"), kept)


def merge_metadata(heuristic: DataFrame, structured: DataFrame) -> DataFrame:
    """Metadata by document: a model's names, number, currency and period go before the heuristic ones; its balances only fill gaps."""
    h, s = heuristic.alias("h"), structured.alias("s")
    both = h.join(s, F.col("h.doc") == F.col("s.doc"), "left")

    def over(name: str) -> Column:
        return F.coalesce(clean(F.col(f"s.{name}")), F.col(f"h.{name}"))

    def day(name: str) -> Column:
        raw = clean(F.col(f"s.{name}"))
        return F.coalesce(normalize_date(raw), raw, F.col(f"h.{name}"))

    return both.select(
        "h.doc",
        *[over(c).alias(c) for c in ("company_name", "account_name", "account_number")],
        F.coalesce(F.upper(clean(F.col("s.currency"))), F.col("h.currency")).alias("currency"),
        day("period_from").alias("period_from"),
        day("period_to").alias("period_to"),
        F.coalesce("h.opening", parse_amount(F.col("s.opening"))).alias("opening"),
        F.coalesce("h.closing", parse_amount(F.col("s.closing"))).alias("closing"),
    )
