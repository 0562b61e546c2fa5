"""Running-balance logic: signs, breaks, the balance walk and the document's own totals.

Every function takes rows keyed by ``doc`` in ``seq`` order. Their windows all
partition by ``doc`` first, so one exchange serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import near


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc").orderBy("seq")


def resolve_signs(rows: DataFrame) -> DataFrame:
    """Sets ``type`` and the sign of ``amount`` (doubles) from the balance before and after; rows without amount stay as they are.

    Where the balances do not tell, the type that was there counts; where there was
    none, it is a debit.
    """
    size = F.abs("amount")
    before = F.when(
        F.col("amount").isNotNull(),
        F.lag("balance").over(Window.partitionBy("doc", F.col("amount").isNull()).orderBy("seq")),
    )
    told = F.when(near(before + size, F.col("balance")), "credit").when(near(before - size, F.col("balance")), "debit")
    out = rows.withColumn("type", F.when(F.col("amount").isNotNull(), F.coalesce(told, "type", F.lit("debit"))).otherwise(F.col("type")))
    return out.withColumn("amount", F.when(F.col("type") == "credit", F.abs("amount")).otherwise(-F.abs("amount")))


def last_printed() -> Column:
    """The last balance printed before a row."""
    return F.last("balance", ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))


def next_complete() -> Column:
    """The next row as a struct (amount, balance), null unless it has both."""
    after = F.lead(F.struct("amount", "balance")).over(by_doc())
    return F.when(after["amount"].isNotNull() & after["balance"].isNotNull(), after)


def mark_breaks(rows: DataFrame) -> DataFrame:
    """Adds ``chain_break``: the printed balance is not the last printed one and the amount."""
    off = ~near(F.col("before") + F.col("amount"), F.col("balance"))
    return (
        rows.withColumn("before", last_printed())
        .withColumn("chain_break", F.coalesce(off & F.col("before").isNotNull() & F.col("balance").isNotNull(), F.lit(False)))
        .drop("before")
    )


def walk_balances(rows: DataFrame) -> DataFrame:
    """Adds ``expected``, ``checked``, ``severed`` and ``broken`` to rows of (cents, printed).

    A running balance is carried over rows that print none, starts afresh at every
    printed one, and is lost at a row whose amount is unreadable until the next
    printed one. So each printed balance or unreadable amount opens a stretch; the
    running balance is the stretch's printed start and the amounts since.
    """
    opens = F.col("printed").isNotNull() | F.col("cents").isNull()
    upto = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy("doc", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("stretch", F.sum(opens.cast("int")).over(upto))
    running = F.first("printed").over(within) + F.sum(F.when(opens, 0).otherwise(F.col("cents"))).over(within)
    out = out.withColumn("running", running).withColumn("expected", F.lag("running").over(by_doc()) + F.col("cents"))
    checked = F.col("expected").isNotNull() & F.col("printed").isNotNull()
    return (
        out.withColumn("checked", checked)
        .withColumn("severed", F.col("cents").isNull() & F.col("printed").isNull())
        .withColumn("broken", checked & (F.col("expected") != F.col("printed")))
        .drop("stretch", "running")
    )


def chain_counts() -> list[Column]:
    """Aggregates over walked rows: printed, checked, severed and break_count."""
    return [F.count("printed").alias("printed"), *[F.count_if(c).alias(n) for c, n in (("checked", "checked"), ("severed", "severed"), ("broken", "break_count"))]]


def chain_verdict(prefix: str = "") -> list[Column]:
    """What chain_counts say: ok, null where nothing could be checked, as with fewer than two printed balances; and the counts, zero then."""
    enough = F.col("printed") >= 2
    none = F.lit(0).cast("bigint")
    ok = F.when(enough & (F.col("checked") > 0), F.col("break_count") == 0).alias(f"{prefix}ok")
    return [ok, *[F.when(enough, F.col(c)).otherwise(none).alias(f"{prefix}{c}") for c in ("checked", "severed", "break_count")]]


def balance_chain(rows: DataFrame, shown: int = 20) -> DataFrame:
    """``(doc, ok, checked, severed, break_count, breaks)``, the first ``shown`` breaks as structs (seq, expected, printed).

    Breaks are numbered before they are gathered, so that no more than these leave the rows.
    """
    upto = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = walk_balances(rows).withColumn("nth", F.sum(F.col("broken").cast("int")).over(upto))
    broken = F.when(F.col("broken") & (F.col("nth") <= shown), F.struct("seq", "expected", "printed"))
    out = numbered.groupBy("doc").agg(*chain_counts(), F.array_sort(F.collect_list(broken)).alias("breaks"))
    return out.select("doc", *chain_verdict(), F.when(F.col("printed") >= 2, F.col("breaks")).alias("breaks"))


def opening_net_closing(opening: Column, net: Column, closing: Column) -> Column:
    """Whether opening and net make closing, to the cent; null unless both are printed."""
    return opening + net == closing


def stated_totals_ok(checks: list[tuple[Column, Column]]) -> Column:
    """Whether all printed (stated, extracted) pairs agree; null if none is printed."""
    said = F.filter(F.array(*[F.when(a.isNotNull(), a == b) for a, b in checks]), lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, F.forall(said, lambda x: x))
