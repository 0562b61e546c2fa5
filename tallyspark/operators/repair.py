"""Repair of damaged rows from the balances around them.

Each repair looks at the last balance before a row and at the row after it, as it
stands, which must be whole. Where that row is whole, a row without amount or without
balance hands on nothing that the row after does not replace by its own balance. So the
last balance before a row is the last one printed, which is a window, and the repair an
expression; the exception is a run of rows with several numbers each, which may all be
repaired, each upon the one before. Only such runs go, dealt out by run, through a
fold in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spread import spread

COLUMNS = ("doc", "seq", "amount", "balance", "type", "alt_amounts", "desc_only")
OUT = "seq bigint, amount double, balance double, type string, repaired string, inferred boolean"
CENT = 0.015


def _round(value: float) -> float:
    return math.floor(value * 100 + 0.5) / 100 if math.isfinite(value) else value


def _fixed(amount: float, balance: float, how: str | None) -> tuple:
    return _round(amount), _round(balance), "credit" if amount >= 0 else "debit", how, how is None


def repaired_row(prev, amount, balance, kind, alt, desc_only, after) -> tuple:
    """(amount, balance, type, repaired, inferred) of a row, given the last balance before it and (amount, balance) of a whole row after it.

    Without an amount on a row of words only, the gap to the next balance is the
    amount. Without a balance, either amount and next row close the chain, or the one
    number was the balance. With more than two numbers, one of the others may be
    the amount, either sign, that makes the next row follow.
    """
    kept = amount, balance, kind, None, False
    if prev is None or after is None:
        return kept
    then, closing = after
    if amount is None:
        gap = closing - then - prev
        return _fixed(gap, prev + gap, None) if desc_only and abs(gap) > 0.009 else kept
    if balance is None:
        if abs(prev + amount + then - closing) < CENT:
            return amount, _round(prev + amount), kind, "balance-filled", False
        size = abs(amount)
        if abs(size + then - closing) < CENT and abs(size - prev) > 0.009:
            return _fixed(size - prev, size, "amount-balance-merge")
        return kept
    if alt and not abs(prev + amount - balance) < CENT:
        for x in (y for t in alt if t is not None for y in (abs(t), -abs(t))):
            if abs(prev + x + then - closing) < CENT:
                return _fixed(x, prev + x, "multi-amount-disambiguated")
    return kept


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (doc, run, seq), whose first rows have the last balance printed before."""
    run, prev = None, None
    for batch in batches:
        rows = []
        for doc, n, seq, first, after, *row in zip(*(batch.column(c).to_pylist() for c in ("doc", "run", "seq", "prev", "after", *COLUMNS[2:])), strict=True):
            if (doc, n) != run:
                run, prev = (doc, n), first
            done = repaired_row(prev, *row, (after["amount"], after["balance"]))
            prev = done[1] if done[1] is not None else prev
            rows.append((doc, seq, *done))
        kinds = [batch.schema.field("doc").type, pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
        names = ["doc", "seq", "amount", "balance", "type", "repaired", "inferred"]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _sql_round(value: str) -> str:
    return f"if(abs({value}) < 1e15, floor(({value}) * 100 + 0.5) / 100, {value})"


def _sql_fixed(amount: str, balance: str, how: str) -> str:
    return (
        f"named_struct('amount', {_sql_round(amount)}, 'balance', {_sql_round(balance)}, 'type', if({amount} >= 0, 'credit', 'debit'),"
        f" 'repaired', CAST({how} AS STRING), 'inferred', {how} IS NULL)"
    )


def repaired_columns() -> str:
    """:func:`repaired_row` in SQL: a struct of a row with ``prev`` and ``after``, null where it stays as it is."""
    gap = "(after.balance - after.amount - prev)"
    filled = f"named_struct('amount', amount, 'balance', {_sql_round('prev + amount')}, 'type', type, 'repaired', 'balance-filled', 'inferred', false)"
    signed = "flatten(transform(filter(alt_amounts, t -> t IS NOT NULL), t -> array(abs(t), -abs(t))))"
    fitting = f"filter({signed}, x -> abs(prev + x + after.amount - after.balance) < {CENT})"
    chosen = f"get(transform(slice({fitting}, 1, 1), x -> {_sql_fixed('x', '(prev + x)', "'multi-amount-disambiguated'")}), 0)"
    return f"""CASE WHEN prev IS NULL OR after IS NULL THEN NULL
      WHEN amount IS NULL THEN if(desc_only AND abs{gap} > 0.009 AND NOT isnan{gap}, {_sql_fixed(gap, f"(prev + {gap})", "NULL")}, NULL)
      WHEN balance IS NULL THEN CASE WHEN abs(prev + amount + after.amount - after.balance) < {CENT} THEN {filled}
        WHEN abs(abs(amount) + after.amount - after.balance) < {CENT} AND abs(abs(amount) - prev) > 0.009
          THEN {_sql_fixed("(abs(amount) - prev)", "abs(amount)", "'amount-balance-merge'")} END
      WHEN NOT abs(prev + amount - balance) < {CENT} THEN {chosen} END"""


def repair(rows: DataFrame) -> DataFrame:
    """``(doc, seq, amount, balance, type, repaired, inferred)`` of rows with (amount, balance, type, alt_amounts, desc_only).

    Rows that have no amount in the end are dropped.
    """
    money = [rows[c].cast("double") for c in ("amount", "balance")]
    picked = rows.select("doc", rows["seq"].cast("bigint"), *money, "type", rows["alt_amounts"].cast("array<double>"), "desc_only")
    by_doc = Window.partitionBy("doc").orderBy("seq")
    after = F.lead(F.struct("amount", "balance")).over(by_doc)
    whole = F.col("amount").isNotNull() & F.col("balance").isNotNull()
    several = whole & (F.coalesce(F.size("alt_amounts"), F.lit(0)) > 0)
    damaged = F.when(F.col("amount").isNull(), F.coalesce("desc_only", F.lit(False))).otherwise(F.col("balance").isNull() | several)
    seen = spread(picked, "doc").withColumns(
        {
            "after": F.when(after["amount"].isNotNull() & after["balance"].isNotNull(), after),
            "prev": F.last("balance", ignorenulls=True).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    seen = seen.withColumn("damaged", damaged & F.col("after").isNotNull())
    seen = seen.withColumn("goes_on", several & F.col("damaged") & F.lag("damaged", 1, False).over(by_doc))
    seen = seen.withColumn("in_run", F.col("goes_on") | F.lead("goes_on", 1, False).over(by_doc))
    fixed = seen.filter("NOT in_run").withColumn("fixed", F.when(F.col("damaged"), F.expr(repaired_columns())))
    out = ["amount", "balance", "type"]
    alone = fixed.select(
        "doc", "seq", *[F.when(F.col("fixed").isNull(), F.col(c)).otherwise(F.col(f"fixed.{c}")).alias(c) for c in out], "fixed.repaired",
        F.coalesce("fixed.inferred", F.lit(False)).alias("inferred"),
    )
    run = F.count_if(~F.col("goes_on")).over(by_doc)
    runs = seen.withColumn("run", run).filter("in_run").select("doc", "run", "seq", "prev", "after", *COLUMNS[2:])
    schema = T.StructType([rows.schema["doc"], *T.StructType.fromDDL(OUT).fields])
    folded = spread(runs, "doc", "run").sortWithinPartitions("doc", "run", "seq").mapInArrow(_fold, schema)
    return alone.unionByName(folded).filter("amount IS NOT NULL")
