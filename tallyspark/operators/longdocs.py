"""Running values of documents of any length, over all tasks: segmented prefix scans over ranges.

A window by document puts a document into one task. Here rows are dealt out by ranges
of (doc, seq), so that a long document lies in many tasks and a range holds many
short ones. A running value is then made in three steps: within each range; over
one row for each range and document in it, which says what the range adds or
leaves behind; and once more over the rows, each with what the ranges before its
own have left. The rows of the second step are as many as ranges and documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import near
from ..sources.folders import staged

DOC, SEQ, RANGE = "doc", "seq", "range"


class Ranges:
    """Rows with (doc, seq) in ranges; each method adds a running value as a column."""

    def __init__(self, rows: DataFrame, ranges: int | None = None):
        ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(ranges, DOC, SEQ).withColumn(RANGE, F.spark_partition_id())
        self.rows = staged(dealt, "ranges")

    def with_columns(self, columns: dict[str, Column]) -> Ranges:
        self.rows = self.rows.withColumns(columns)
        return self

    def _own(self, upto: int):
        return Window.partitionBy(RANGE, DOC).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, upto)

    def _left(self, summary: Column, carry) -> DataFrame:
        """``(range, doc, carry)``: what the ranges before one have left to it of a document."""
        each = staged(self.rows.groupBy(RANGE, DOC).agg(summary.alias("own")), "range-sums")
        before = Window.partitionBy(DOC).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        left = each.select(RANGE, F.col(DOC).alias("of"), carry("own", before).alias("carry")).filter("carry IS NOT NULL")
        return staged(left.withColumnRenamed(RANGE, "in"), "carries")

    def _joined(self, name: str, summary: Column, carry, combined) -> Ranges:
        left = self._left(summary, carry)
        joined = self.rows.join(left, (F.col(RANGE) == F.col("in")) & F.col(DOC).eqNullSafe(F.col("of")), "left")
        self.rows = joined.withColumn(name, combined(F.col("carry"))).drop("in", "of", "carry")
        return self

    def sum_upto(self, name: str, value: Column) -> Ranges:
        """The document's sum of ``value`` up to the row."""
        zero = F.coalesce(value, F.lit(0))
        return self._joined(
            name, F.sum(zero), lambda own, before: F.sum(own).over(before), lambda carry: F.sum(zero).over(self._own(0)) + F.coalesce(carry, F.lit(0))
        )

    def _last(self, name: str, value: Column, upto: int) -> Ranges:
        """Values are wrapped, so that a null inside a struct that is none is kept as it is."""
        kept = F.max_by(value, F.when(value.isNotNull(), F.col(SEQ)))
        return self._joined(
            name, kept, lambda own, before: F.last(own, ignorenulls=True).over(before), lambda carry: F.coalesce(F.last(value, ignorenulls=True).over(self._own(upto)), carry)
        )

    def last_upto(self, name: str, value: Column) -> Ranges:
        """The document's last value that is not null, the row's own included."""
        return self._last(name, value, 0)

    def last_before(self, name: str, value: Column) -> Ranges:
        """The document's last value that is not null, before the row."""
        return self._last(name, value, -1)

    def lag(self, name: str, value: Column) -> Ranges:
        """The value of the document's row before, which may be null."""
        self._last(name, F.struct(value.alias("v")), -1)
        return self.with_columns({name: F.col(name)["v"]})

    def done(self) -> DataFrame:
        return self.rows.drop(RANGE)


def walk_balances(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of :func:`chain.walk_balances` for documents of any length.

    A running balance is the balance at the row that opened the stretch and what has been
    added since, as the difference of two running sums.
    """
    opens = F.col("printed").isNotNull() | F.col("cents").isNull()
    out = Ranges(rows, ranges).sum_upto("total", F.when(opens, 0).otherwise(F.col("cents")))
    out.last_upto("opened", F.when(opens, F.struct("printed", "total")))
    out.with_columns({"running": F.col("opened")["printed"] + F.col("total") - F.col("opened")["total"]})
    walked = out.lag("before", F.col("running")).done()
    expected = F.col("before") + F.col("cents")
    checked = expected.isNotNull() & F.col("printed").isNotNull()
    return walked.withColumns(
        {"expected": expected, "checked": checked, "severed": F.col("cents").isNull() & F.col("printed").isNull(), "broken": checked & (expected != F.col("printed"))}
    ).drop("total", "opened", "running", "before")


def mark_breaks(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of :func:`chain.mark_breaks` for documents of any length."""
    out = Ranges(rows, ranges).last_before("before", F.col("balance")).done()
    off = ~near(F.col("before") + F.col("amount"), F.col("balance"))
    marked = F.coalesce(off & F.col("before").isNotNull() & F.col("balance").isNotNull(), F.lit(False))
    return out.withColumn("chain_break", marked).drop("before")


def resolve_signs(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of :func:`chain.resolve_signs` for documents of any length."""
    has = F.col("amount").isNotNull()
    out = Ranges(rows, ranges).last_before("before", F.when(has, F.struct("balance"))).done()
    before, size = F.when(has, F.col("before")["balance"]), F.abs("amount")
    told = F.when(near(before + size, F.col("balance")), "credit").when(near(before - size, F.col("balance")), "debit")
    out = out.withColumn("type", F.when(has, F.coalesce(told, "type", F.lit("debit"))).otherwise(F.col("type")))
    return out.withColumn("amount", F.when(F.col("type") == "credit", size).otherwise(-size)).drop("before")


def numbered(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds ``place``, each row's number from 1 in its document by ``seq``."""
    return Ranges(rows, ranges).sum_upto("place", F.lit(1).cast("long")).done()
