"""Quorum votes: on single fields, on the fields a document has once, and on multisets of rows.

Rows have (doc, reader, reader_ord, idx); ``readers`` names who read each document.
A document's readers are few, so what they say about one thing is one small
array, gathered in a single exchange, and the vote is an expression on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let, row_key, row_key_loose
from ..sources.folders import staged
from .parsers import once
from .spread import spread

TEXT_KEY = "nullif(trim(regexp_replace(upper(x), '[^A-Z0-9]+', ' ')), '')"
DIGITS = "regexp_replace(x, '[^0-9]', '')"
ACCOUNT_KEY = f"CASE WHEN length({DIGITS}) >= 4 THEN {DIGITS} ELSE {TEXT_KEY} END"
#: How a field's values x are compared, in SQL; others compare as they are.
COMPARE = {
    "company_name": TEXT_KEY,
    "account_name": TEXT_KEY,
    "account_number": ACCOUNT_KEY,
    "account_type": TEXT_KEY,
    "branch": TEXT_KEY,
    "currency": "upper(x)",
    "description": TEXT_KEY,
    "reference": TEXT_KEY,
}
SCALARS = (
    "document_type", "company_name", "account_name", "account_number", "account_type", "branch", "currency", "period_from",
    "period_to", "statement_date", "opening_cents", "closing_cents", "stated_credits", "stated_debits", "stated_count",
)
CRITICAL = ("account_number", "period_from", "period_to", "opening_cents", "closing_cents")
ROW_FIELDS = ("page", "date_iso", "date_raw", "description", "reference", "credit", "debit", "amount", "balance")


def vote(values: str, compare: str = "x", quorum: str = "2") -> Column:
    """struct(value, agreed, votes, of, unanimous) of an array of what each reader said, in reader order.

    Values of one comparison key are one candidate, shown as first said; the most
    votes win, ties to what was said first. Null is a vote. A null that wins over
    some candidate's first value is no agreement. Where all said the same, there is
    nothing to count. The arguments are SQL, for one
    expression of this size takes seconds to put together call by call; ``get`` of a
    one-element ``transform`` names what is used more than once.
    """
    top = f"try_element_at({values}, CAST(array_position(c.counts, n) AS INT))"
    some = f"exists(zip_with({values}, c.first, (v, new) -> v IS NOT NULL AND new), z -> z)"
    decided = (
        f"named_struct('value', if(n >= {quorum}, {top}, NULL), 'agreed', n >= {quorum} AND NOT ({top} IS NULL AND {some}),"
        f" 'votes', n, 'of', size({values}), 'unanimous', size({values}) > 1 AND n = size({values}))"
    )
    counts = "transform(keys, k -> size(filter(keys, y -> y <=> k)))"
    first = "transform(keys, (k, i) -> size(filter(slice(keys, 1, i), y -> y <=> k)) = 0)"
    most = f"get(transform(array(coalesce(array_max(c.counts), 0)), n -> {decided}), 0)"
    counted = f"get(transform(array(named_struct('counts', {counts}, 'first', {first})), c -> {most}), 0)"
    voted = f"get(transform(array(transform({values}, x -> {compare})), keys -> {counted}), 0)"
    n = f"size({values})"
    same = f"named_struct('value', if({n} >= {quorum}, get({values}, 0), NULL), 'agreed', {n} >= {quorum}, 'votes', {n}, 'of', {n}, 'unanimous', {n} > 1)"
    return F.expr(f"if(size(array_distinct({values})) = 1, {same}, {voted})")


def votes_of(fields: tuple[str, ...], said: str, quorum: str = "2") -> dict[str, Column]:
    """A vote for each field of an array of structs."""
    return {f: vote(f"{said}.{f}", COMPARE.get(f, "x"), quorum) for f in fields}


def in_reader_order(*columns: str) -> Column:
    """The rows of a group as an array of structs, by reader."""
    return F.sort_array(F.collect_list(F.struct("reader_ord", "reader", *columns)))


def vote_scalars(reads: DataFrame, quorum: int = 2) -> DataFrame:
    """One row per document with a vote struct for each of SCALARS."""
    said = reads.groupBy("doc").agg(in_reader_order(*SCALARS).alias("said"))
    return said.select("doc", *[v.alias(f) for f, v in votes_of(SCALARS, "said", str(quorum)).items()])


def vote_entries(entries: DataFrame, by: list[str], quorum: int = 2) -> DataFrame:
    """A vote for each group ``by`` of long ``(…, reader, reader_ord, value, key)`` rows, with every candidate and who said it."""
    groups = entries.groupBy(*by, "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("value", "reader_ord").alias("value"),
        F.min("reader_ord").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("reader_ord", "reader"))), lambda x: x["reader"]).alias("readers"),
    )
    candidate = F.struct((-F.col("n")).alias("minus"), "first", "value", "readers")
    ordered = groups.groupBy(*by).agg(
        F.array_sort(F.collect_list(candidate)).alias("candidates"),
        F.sum("n").alias("of"),
        F.count("value").alias("said"),
    )
    top = F.col("candidates")[0]
    reached = -top["minus"] >= quorum
    return ordered.select(
        *by,
        F.when(reached, top["value"]).alias("value"),
        (reached & ~(top["value"].isNull() & (F.col("said") > 0))).alias("agreed"),
        (-top["minus"]).alias("votes"),
        "of",
        ((F.size("candidates") == 1) & (F.col("of") > 1)).alias("unanimous"),
        top["readers"].alias("readers"),
        F.transform("candidates", lambda c: F.struct(c["value"].alias("value"), c["readers"].alias("readers"))).alias("candidates"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the strict and the loose row key."""
    money = [F.col(c) for c in ("date_iso", "date_raw", "amount", "credit", "debit")]
    return rows.withColumns({"key": row_key(*money, F.col("description")), "loose": row_key_loose(*money)})


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``occurrence``, which numbers a reader's rows of one key, and ``n``, how many these are."""
    own = Window.partitionBy("doc", key, "reader").orderBy(*order)
    count = F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns({"occurrence": F.row_number().over(own), "n": count})


def with_counts(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``occurrence``, which numbers a reader's rows of one key, and ``seen``, structs (reader_ord, reader, n) of how many each reader has.

    All windows partition by document and key, so rows dealt out by these move no more,
    and a document of any length lies in many tasks.
    """
    out = numbered(rows, key, order)
    one = F.when(F.col("occurrence") == 1, F.struct("reader_ord", "reader", "n"))
    return out.withColumn("seen", F.collect_list(one).over(Window.partitionBy("doc", key))).drop("n")


def told_quorum(rows: DataFrame, quorum: int = 2) -> DataFrame:
    """``agreed`` and ``seen_by`` for ``seen``, in rows that carry ``voters``, how many read the document.

    ``agreed`` is the smallest count of the key that ``quorum`` readers share, readers
    without it counting zero; null if there is none.
    """
    return rows.withColumns({"agreed": shared_count(quorum), "seen_by": F.sort_array("seen")["reader"]}).drop("seen")


def with_quorum(rows: DataFrame, key: str, order: list[str], quorum: int = 2) -> DataFrame:
    """:func:`with_counts` and :func:`told_quorum`, row by row."""
    return told_quorum(with_counts(rows, key, order), quorum)


def shared_count(quorum: int) -> Column:
    """The smallest count in ``seen``, of structs with a reader's count ``n``, that ``quorum`` of ``voters`` share; those not seen count zero.

    Where all that are seen have the same count there is nothing to compare.
    """

    def smallest(counts: Column) -> Column:
        return F.array_min(F.filter(counts, lambda n: F.size(F.filter(counts, lambda x: x == n)) >= quorum))

    seen, absent = F.size("seen"), F.greatest(F.lit(0), F.col("voters") - F.size("seen")).cast("int")
    missing = F.array_repeat(F.lit(0).cast("bigint"), absent)
    other = let(F.concat(F.transform("seen", lambda s: s["n"]), missing), smallest)
    same = F.when(absent >= quorum, F.lit(0).cast("bigint")).when(seen >= quorum, F.col("seen.n")[0])
    return F.when(F.size(F.array_distinct("seen.n")) == 1, same).otherwise(other)


def with_voters(rows: DataFrame, readers: DataFrame) -> DataFrame:
    return rows.join(readers.groupBy("doc").agg(F.count(F.lit(1)).alias("voters")), "doc")


def quorum_counts(rows: DataFrame, readers: DataFrame, quorum: int = 2) -> DataFrame:
    """``(doc, key, agreed, seen_by)`` of the rows' strict keys, as :func:`with_quorum` has them: counts by reader, then one row for each key."""
    dealt = spread(keyed(rows).select("doc", "key", "reader_ord", "reader"), "doc", "key")
    counts = dealt.groupBy("doc", "key", "reader_ord", "reader").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("reader_ord", "reader", "n"))).alias("seen"))
    return with_voters(seen, readers).select("doc", "key", shared_count(quorum).alias("agreed"), F.transform("seen", lambda s: s["reader"]).alias("seen_by"))


def _grouped(rows: DataFrame, key: str, *shared: str) -> DataFrame:
    """One row for each (doc, key, occurrence): what its readers ``said``, and what all rows of the key share."""
    one = F.struct("reader_ord", "reader", "idx", *ROW_FIELDS)
    each = once(rows, "one", one).select("doc", F.col(key).alias("key"), "occurrence", *shared, "one")
    return each.groupBy("doc", "key", "occurrence").agg(F.sort_array(F.collect_list("one")).alias("said"), *[F.first(c).alias(c) for c in shared])


def _side_by_side(rows: DataFrame) -> DataFrame:
    """:func:`numbered` rows of dealt keys as :func:`_grouped` has them, with ``seen`` as in :func:`with_counts` and ``first``, the least (reader_ord, idx) of the key.

    One more sort puts the rows of an occurrence side by side, where windows gather them. An
    aggregate would hold all rows of its task a second time, with what their key shares on each. The
    first occurrence has every reader of the key, so what is shared is told from there, once rows are gathered.
    """
    one = F.struct("reader_ord", "reader", "idx", *ROW_FIELDS, "n")
    heard = F.collect_list("one").over(Window.partitionBy("doc", "key", "occurrence"))
    each = rows.select("doc", "key", "occurrence", "voters", one.alias("one")).withColumn("heard", heard)
    # a reader has one row of an occurrence: that of the reader who comes first in the array stays for all
    groups = each.filter(F.col("one.reader").eqNullSafe(F.col("heard")[0]["reader"]))
    from_first = lambda c: F.first(c).over(Window.partitionBy("doc", "key").orderBy("occurrence"))
    seen = F.transform("heard", lambda s: F.struct(s["reader_ord"], s["reader"], s["n"]))
    least = F.array_min(F.transform("heard", lambda s: F.struct(s["reader_ord"], s["idx"])))
    return groups.select(
        "doc", "key", "occurrence", F.sort_array("heard").alias("said"), from_first(seen).alias("seen"), from_first(least).alias("first"), "voters"
    )


def _accept(groups: DataFrame, matched_by: str, quorum: int) -> DataFrame:
    """The groups as accepted rows, their fields voted among the readers that have them."""
    voted = votes_of(ROW_FIELDS, "said", f"least({quorum}, size(said))")
    out = groups.withColumns({f"v_{f}": v for f, v in voted.items()})
    return out.select(
        "doc",
        "key",
        "occurrence",
        F.lit(matched_by).alias("matched_by"),
        F.col("said.reader").alias("readers"),
        "seen_by",
        *[F.col(f"v_{f}")["value"].alias(f) for f in ROW_FIELDS],
        F.col("v_description")["agreed"].alias("description_agreed"),
    )


def vote_rows(rows: DataFrame, readers: DataFrame, quorum: int = 2) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, disputes) of the readers' row multisets.

    First rows match on day, amount and the start of the description: of each key
    the smallest count that ``quorum`` readers share is accepted, and what a reader
    has beyond it is a ``duplicate_row``. Rows of keys without such a count, or with
    zero, match again on day and amount alone; what still finds no quorum is an
    ``unmatched_row``, and an accepted row whose descriptions differ a
    ``row_description``. Surplus of the second pass goes without a dispute. The first pass runs
    once: its groups are written, what readers said of an occurrence side by side, and both what it
    accepts and what goes on to the second read them. ``rows`` that carry ``voters``, how many
    read the document, need no ``readers``.
    """
    counted = rows.filter("doc IS NOT NULL") if "voters" in rows.columns else with_voters(rows, readers)
    dealt = spread(keyed(counted.select("doc", "reader", "reader_ord", "idx", *ROW_FIELDS, "voters")).drop("loose"), "doc", "key")
    strict = staged(told_quorum(_side_by_side(numbered(dealt, "key", ["idx"])), quorum), "strict-matches")
    agreed = F.coalesce(F.col("agreed"), F.lit(0))
    exact = _accept(strict.filter(F.col("occurrence") <= agreed), "exact", quorum)
    other = strict.filter(F.col("occurrence") > agreed).withColumn("r", F.explode("said")).select("doc", "agreed", "first", "voters", "r.*")
    other = keyed(other.drop("n"))
    doubles = other.filter(agreed > 0)

    left = other.filter(agreed == 0).drop("agreed")
    left = staged(with_quorum(left, "loose", ["first", "idx"], quorum), "loose-matches")
    loose = _accept(_grouped(left.filter(F.col("occurrence") <= agreed), "loose", "seen_by"), "amount+date", quorum)
    alone = left.filter(agreed == 0)

    def dispute(frame: DataFrame, kind: str) -> DataFrame:
        have = set(frame.columns)
        pick = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
        return frame.select(
            "doc", F.lit(kind).alias("kind"), pick("reader", "string").alias("reader"), "key",
            F.coalesce("date_iso", "date_raw").alias("day"), "description", "credit", "debit", "balance",
        )

    told = loose.filter(~F.col("description_agreed"))
    disputes = (
        dispute(doubles, "duplicate_row")
        .unionByName(dispute(alone.withColumn("key", F.col("loose")), "unmatched_row"))
        .unionByName(dispute(told, "row_description"))
    )
    return exact.unionByName(loose), disputes


def in_printed_order(accepted: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``position``: accepted rows by page, then by their first place in the read with most rows, then by key."""
    own = Window.partitionBy("doc", "reader")
    keys = keyed(rows).withColumn("n", F.count(F.lit(1)).over(own))
    fullest = F.max_by("reader", F.struct("n", -F.col("reader_ord"))).over(Window.partitionBy("doc"))
    first = keys.withColumn("fullest", fullest).filter("reader = fullest").groupBy("doc", "key").agg(F.min("idx").alias("at"))
    both = accepted.withColumn("at", F.lit(None).cast(first.schema["at"].dataType)).unionByName(first, allowMissingColumns=True)
    at = F.max("at").over(Window.partitionBy("doc", "key"))
    # one exchange by document for the keys' places and the order; a row of an accepted key has an occurrence, a place has none
    dealt = spread(both, "doc").withColumn("at", at).filter("occurrence IS NOT NULL")
    order = Window.partitionBy("doc").orderBy(
        F.coalesce("page", F.lit(0)), F.col("at").asc_nulls_last(), F.collate("key", "UNICODE"), "occurrence"
    )
    return dealt.withColumn("position", F.row_number().over(order)).drop("at")


def most_rows(rows: DataFrame) -> DataFrame:
    """``(doc, most)``: how many rows a document's fullest read has."""
    return rows.groupBy("doc", "reader").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.max("n").alias("most"))


def agreement(accepted: DataFrame, rows: DataFrame, readers: DataFrame) -> DataFrame:
    """``(doc, accepted, most, ratio)``: accepted rows against the fullest read; 1 if nobody proposed a row."""
    most = most_rows(rows)
    counts = accepted.groupBy("doc").agg(F.count(F.lit(1)).alias("accepted"))
    zero = F.lit(0).cast("bigint")
    out = readers.select("doc").distinct().join(most, "doc", "left").join(counts, "doc", "left")
    out = out.select("doc", F.coalesce("accepted", zero).alias("accepted"), F.coalesce("most", zero).alias("most"))
    proposed = F.greatest("most", "accepted")
    return out.withColumn("ratio", F.when(proposed == 0, 1.0).otherwise(F.col("accepted") / proposed))
