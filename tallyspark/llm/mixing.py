"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A never-null stand-in for a source, so that null sources join."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def hash_of(id_: Column, text: Column, source: Column, seed: int) -> Column:
    return F.xxhash64(id_, text, source_key(source), F.lit(seed))


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """``rows(h, at, …)`` whose ``h`` other rows have too, with ``h`` hashed again with the row's number among these.

    ``at`` is unique and has the number of the partition it was given in above its
    lowest 33 bits. Equal rows are numbered within each partition, after as many as
    the partitions before have, so that no task gets all of a row that repeats often. Any
    numbering gives the same hashes.
    """
    part = F.shiftright("at", 33)
    counts = rows.groupBy("h", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("h", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("h", "part").orderBy("at"))
    placed = rows.withColumn("part", part).withColumn("nth", within).join(first, ["h", "part"])
    again = F.xxhash64("h", F.col("first") + F.col("nth"), F.lit(seed))
    return placed.select(*[again.alias("h") if c == "h" else c for c in rows.columns])


def ranked_sources(totals: DataFrame) -> DataFrame:
    """Adds ``rank``: 0 for the first source by code point, null last. Ranges are sorted apart; the driver sees one count a range."""
    placed = materialise(
        totals.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "sources"
    )
    ranges = placed.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    before, first = [], 0
    for r in ranges:
        before.append((r["part"], first))
        first += r["count"]
    offsets = totals.sparkSession.createDataFrame(before, "part long, first long")
    return placed.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("part")).select(
        *totals.columns, (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    )


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """Adds ``target`` to ``sources(..., weight, cap)``: shares of ``total`` by weight, clamped at the cap.

    Each round sums the caps of the sources whose share is above their cap and
    the weights of the others, and raises the level; it ends when no source is
    above any more. Only two sums a round reach the driver.
    """
    w, cap = F.col("weight"), F.col("cap")
    level = -1.0
    while True:
        over = cap < F.lit(level) * w if level >= 0 else F.lit(False)
        got = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(w)).alias("open")
        ).first()
        if not got["open"]:
            return sources.withColumn("target", cap)
        after = max(0.0, total - got["full"]) / got["open"]
        if after <= level:
            return sources.withColumn("target", F.least(cap, F.lit(level) * w))
        level = after


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sized, plan, ties)``: rows ``(id, key, size, h)``, per source ``(key, source_size, target, whole, cut)``, and hashes that repeat.

    A document of a source is taken ``whole`` times, and once more if the seeded
    hash ``h`` of its id, text and source is at most ``cut``. Rows equal in these are numbered and
    hashed again with their number, so that the cut can fall between them (see :func:`numbered`). The cut is where the running sum of sizes in
    hash order comes nearest to the words still wanted. That sum is kept per hash
    range, about the square root of the number of rows of them for each source,
    and only the range that holds the cut is walked row by row, so that no task
    gets all of a hot source.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            source_key(F.col(source_col)).alias("key"),
            word_count(F.col(text_col)).alias("size"),
            hash_of(F.col(id_col), F.col(text_col), F.col(source_col), seed).alias("h"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "sized",
    )
    ties = materialise(sized.groupBy("h").count().filter("count > 1").select("h"), "ties")
    if not ties.isEmpty():
        alone, tied = sized.join(ties, "h", "left_anti"), sized.join(ties, "h", "left_semi")
        sized = materialise(alone.unionByName(numbered(tied, seed)), "sized")
    rows = sized.count()
    totals = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialise(
        ranked_sources(totals).select(
            "key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")
        ),
        "weighted-sources",
    )
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    wanted = water_fill(sources, total).withColumn(
        "whole",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    )
    wanted = materialise(wanted.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "wanted")

    bits = max(1, math.ceil(math.log2(max(2, rows)) / 2))
    piece = F.shiftright("h", 64 - bits).alias("piece")
    by_piece = sized.groupBy("key", piece).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("piece")
    cut_piece = (
        by_piece.withColumn("end", F.sum("words").over(upto))
        .join(wanted.select("key", "rest"), "key")
        .filter((F.col("end") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("end")) & (F.col("rest") > 0))
        .select("key", "piece", (F.col("rest") - (F.col("end") - F.col("words"))).alias("room"))
    )
    cut_piece = materialise(cut_piece, "cut-pieces")
    inside = sized.select("key", piece, "h", "size").join(cut_piece, ["key", "piece"])
    in_order = Window.partitionBy("key").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.shiftleft(F.col("piece").cast("long"), 64 - bits)
    cuts = (
        inside.withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        .groupBy("key")
        .agg(
            F.coalesce(
                F.max(F.when(F.col("before") + F.col("size") / 2 <= F.col("room"), F.col("h"))), F.min(first) - 1
            ).alias("cut")
        )
    )
    least = F.lit(-(1 << 63))
    plan = wanted.join(cuts, "key", "left").select(
        "key", "source_size", "target", "whole", F.coalesce("cut", least).alias("cut"), F.col("cut").isNotNull().alias("some")
    )
    return sized, materialise(plan, "mixing-plan"), ties


def repeats() -> Column:
    """How often the mix takes a row of (h) under its source's plan."""
    return F.col("whole") + (F.col("some") & (F.col("h") <= F.col("cut"))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` for every row of ``docs``.

    Null texts have size 0. A null source is a source, the last one. Rows that
    repeat an id are taken each by its own text, rows that repeat both as many as
    the cut leaves. An empty table gives no rows. Other columns are ignored. Options
    are those of :func:`mixing_plan`.
    """
    sized, plan, _ = mixing_plan(docs, id_col=id_col, **options)
    return sized.join(plan, "key").select(
        F.col("id").alias(id_col), "size", "source_size", "target", (repeats() * F.col("size")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8, **options
) -> DataFrame:
    """The mix itself: each row of ``docs``, with its own columns, as often as it is taken."""
    _, plan, ties = mixing_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    plan = plan.select("key", "whole", "some", "cut")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        source_key(docs[source_col]).alias("key"),
        hash_of(docs[id_col], docs[text_col], docs[source_col], seed).alias("h"),
    )
    if not ties.isEmpty():
        tied = materialise(rows.join(ties, "h", "left_semi").withColumn("at", F.monotonically_increasing_id()), "tied")
        rows = rows.join(ties, "h", "left_anti").unionByName(numbered(tied, seed).select(*rows.columns))
    copies = F.explode(F.array_repeat(F.lit(1), repeats().cast("int")))
    return rows.join(plan, "key").withColumn("copy", copies).select(*[F.col(f"row.{c}").alias(c) for c in docs.columns])
