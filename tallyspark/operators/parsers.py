"""Page text to transaction rows, in three layouts: tables, flattened lines, one cell per line.

All take ``pages(doc, page, text, year_hint, date_order)`` and give rows of
``(doc, page, line_no, date, date_iso, description, reference, amount, type, balance,
alt_amounts, desc_only, continuation)``; ``line_no`` orders the rows of a page.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    DATE_TOKEN,
    MARK,
    MAYBE_MONEY,
    WHITE_SPACE,
    date_token,
    is_date,
    is_date_like,
    is_non_transaction,
    is_plain_day,
    is_pure_money,
    is_separator,
    let_sql,
    literal,
    mark_plain_lines,
    markdown_cells,
    money_tokens,
    normalize_date,
    parse_amount,
    plain_day,
    strip_html,
    stripped,
    tentative_type,
    told,
    trimmed,
    trimmed_sql,
)
from .spread import spread

# The roles of a table's columns by their headings, in the order in which they are claimed.
COLUMN_ROLES = (
    ("date", r"^(?:txn\s*|value\s*|posting\s*|trans(?:action)?\s*)?date$|^date\b"),
    ("description", r"descri|particular|narration|details|memo|remark|transaction\s*(?:details)?$"),
    ("reference", r"\bref|cheque|chq|check\s*no|txn\s*id|transaction\s*id|utr|voucher|trx"),
    ("debit", r"debit|withdraw|paid\s*out|money\s*out|^dr\.?$"),
    ("credit", r"credit|deposit|paid\s*in|money\s*in|^cr\.?$"),
    ("balance", r"balance"),
    ("type", r"^type$|dr\s*/\s*cr"),
    ("amount", r"amount|value$"),
)
ROLES = tuple(name for name, _ in COLUMN_ROLES)
#: A line that can be led by a date: its first token, or one spelt like it, stands at one of the first three places.
MAYBE_LED = r"(?s)^.{0,2}?(?:" + DATE_TOKEN.replace(r"\b", "") + ")"
#: A line that can go on under a date: two things like money.
MAYBE_TWO = rf"(?s)(?:{MAYBE_MONEY}).*(?:{MAYBE_MONEY})"
#: A page that can have one cell per line: a line that is spelt like a date and nothing else, of no more than 14 characters.
MAYBE_CELLS = rf"(?:\A|\n)[{WHITE_SPACE}]*+(?=[^\n]{{0,14}}+(?:[{WHITE_SPACE}]|\z))(?:{DATE_TOKEN})[{WHITE_SPACE.replace(chr(10), '')}]*+(?:\n|\z)"
COLUMNS = (
    "doc", "page", "line_no", "date", "date_iso", "description", "reference", "amount", "type", "balance", "alt_amounts",
    "desc_only", "continuation",
)


def page_lines(pages: DataFrame, *more: str) -> DataFrame:
    return pages.select("doc", "page", "year_hint", "date_order", *more, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a dear value: as a generated row it is not worked out again where filters and later columns use it.

    The value is a column first: a lambda inside the generator would have its type worked out for every row.
    """
    return rows.withColumn("value", value).select("*", F.explode(F.array("value")).alias(name)).drop("value")


def likely(pages: DataFrame, worth: Column) -> DataFrame:
    """The pages worth a closer look, told behind the exchange that the layouts share: pushed before it, it would be one for each."""
    return once(pages, "likely", worth).filter("likely").drop("likely")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def from_lines(pages: DataFrame) -> DataFrame:
    """Flattened lines: a date, a description, an amount and, last, a balance.

    A date-led line without money is a candidate whose amount the repair may find.
    A line without a date goes on under the last date, if it has an amount, a balance
    and words. Plain lines are found and taken apart in one search of the page; the
    others are looked at one by one.
    """
    fresh = ~F.col("text").contains(MARK)
    texts = pages.withColumns({"fresh": fresh, "text": F.when(fresh, mark_plain_lines(F.col("text"))).otherwise(F.col("text"))})
    # a date or money has a digit
    lines = page_lines(texts, "fresh").withColumnRenamed("line", "printed").filter(F.col("printed").rlike("[0-9]"))
    taken = lambda line: F.col("fresh") & F.col(line).startswith(MARK)
    tidy = F.regexp_replace(stripped(F.col("printed")), r"(?U)\s{2,}", " ")
    line = F.when(taken("printed"), F.col("printed")).when(F.col("fresh"), mark_plain_lines(tidy)).otherwise(tidy)
    lines = once(lines, "line", line).drop("printed").filter(F.length("line") >= 8)
    lines = lines.withColumn("plain", taken("line")).drop("fresh")
    plain = F.col("plain")
    token = F.when(plain, F.substring(F.col("line"), 2, 10)).when(F.col("line").rlike(MAYBE_LED), date_token(F.col("line")))
    lines = once(lines, "token", token)
    at = F.instr("line", F.col("token"))
    led = F.when(plain, True).otherwise(F.coalesce((at <= 3) & is_date(F.col("token")), F.lit(False)))
    lines = once(lines, "led", led).filter(F.col("led") | F.col("line").rlike(MAYBE_TWO))
    upto = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("date", F.last(F.when(F.col("led"), F.col("token")), ignorenulls=True).over(upto)).filter("date IS NOT NULL")
    lines = once(lines, "parts", F.when(plain, F.split("line", MARK)))
    words, first, last, sought = (F.get("parts", F.lit(k)) for k in range(2, 6))
    after = F.substring(F.col("line"), at + F.length("token"), F.length("line"))
    # of a plain line without any of the words sought there is nothing more to look for
    rest = F.when(plain, F.when(sought != "", F.concat(F.ltrim(words), F.lit(" "), first))).when(F.col("led"), trimmed(after)).otherwise(F.col("line"))
    lines = once(lines, "rest", rest).filter(F.col("rest").isNull() | ~is_non_transaction(F.col("rest")))
    lines = once(lines, "money", F.when(~plain, money_tokens(F.col("rest")))).withColumn("n", F.when(plain, 2).otherwise(F.size("money")))
    pick = F.when(F.col("n") >= 2, F.element_at("money", -2)).when(F.col("n") == 1, F.element_at("money", 1))
    lines = lines.withColumn("pick", F.when(~plain, pick))
    before = squeezed(F.substring(F.col("rest"), F.lit(1), F.length("rest") - F.col("pick")["rest"]))
    lines = lines.filter(F.when(F.col("led"), (F.col("n") > 0) | (F.length("rest") >= 6)).otherwise(F.col("n") >= 2))
    said = F.when(plain, F.ltrim(words)).when(F.col("n") == 0, squeezed(F.col("rest"))).otherwise(before)
    lines = once(lines, "said", said)
    worded = (F.col("said") != "") & ~F.col("said").rlike(r"^[\d\s$.,-]*$")
    lines = lines.filter(F.col("led") | worded)
    some = F.col("n") > 0
    figure = lambda amount: F.translate(amount, ",", "").try_cast("double")
    return lines.select(
        "doc",
        "page",
        "line_no",
        "date",
        F.when(plain, plain_day(F.col("date"), F.col("date_order")))
        .otherwise(normalize_date(F.col("date"), F.col("year_hint"), F.col("date_order")))
        .alias("date_iso"),
        F.nullif("said", F.lit("")).alias("description"),
        F.lit(None).cast("string").alias("reference"),
        F.abs(F.when(plain, figure(first)).otherwise(F.col("pick")["value"])).alias("amount"),
        F.when(some & F.col("rest").isNotNull(), tentative_type(F.col("said"))).alias("type"),
        F.when(plain, figure(last)).when(F.col("n") >= 2, F.element_at("money", -1)["value"]).alias("balance"),
        F.when(F.col("led") & (F.col("n") > 2), F.transform("money", lambda m: m["value"])).alias("alt_amounts"),
        (~some).alias("desc_only"),
        (~F.col("led")).alias("continuation"),
    )


def from_cells_per_line(pages: DataFrame) -> DataFrame:
    """One cell per line: a date opens a record of up to four lines of text and two of money, signed as printed."""
    lines = page_lines(likely(pages, F.col("text").rlike(MAYBE_CELLS)))
    lines = once(lines.withColumnRenamed("line", "printed"), "line", stripped(F.col("printed"))).drop("printed").filter("line <> ''")
    spelt = F.col("line").rlike(f"^(?:{DATE_TOKEN})$") & is_date(F.col("line"), F.col("date_order"))
    dated = F.coalesce((F.length("line") <= 14) & spelt, F.lit(False))
    lines = once(lines, "dated", dated).withColumn("money", is_pure_money(F.col("line")))
    upto = Window.partitionBy("doc", "page").orderBy("line_no")
    lines = lines.withColumn("record", F.sum(F.col("dated").cast("int")).over(upto)).filter("record > 0")
    before = Window.partitionBy("doc", "page", "record").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    body = ~F.col("dated")
    count = lambda c: F.coalesce(F.sum((body & c).cast("int")).over(before), F.lit(0))
    lines = lines.withColumns({"moneys": count(F.col("money")), "words": count(~F.col("money"))})
    ends = body & ((F.col("moneys") >= 2) | (~F.col("money") & ((F.col("moneys") > 0) | (F.col("words") >= 4))))
    upto = Window.partitionBy("doc", "page", "record").orderBy("line_no")
    lines = lines.withColumn("ended", F.max(ends.cast("int")).over(upto)).filter("ended = 0")
    cells = F.array_sort(F.collect_list(F.struct("line_no", "line", "dated", "money")))
    records = lines.groupBy("doc", "page", "record").agg(
        cells.alias("cells"), F.first("year_hint").alias("year_hint"), F.first("date_order").alias("date_order")
    )
    words = F.filter("cells", lambda c: ~c["dated"] & ~c["money"])
    money = F.transform(F.filter("cells", lambda c: ~c["dated"] & c["money"]), lambda c: parse_amount(c["line"]))
    said = squeezed(F.array_join(F.transform(words, lambda c: c["line"]), " "))
    records = records.withColumns({"said": said, "values": money})
    records = records.filter((F.size("values") >= 1) & (F.col("said") != "") & ~is_non_transaction(F.col("said")))
    first = F.col("cells")[0]
    return records.select(
        "doc",
        "page",
        first["line_no"].alias("line_no"),
        first["line"].alias("date"),
        normalize_date(first["line"], F.col("year_hint"), F.col("date_order")).alias("date_iso"),
        F.col("said").alias("description"),
        F.lit(None).cast("string").alias("reference"),
        F.col("values")[0].alias("amount"),
        F.when(F.col("values")[0] < 0, "debit").otherwise("credit").alias("type"),
        F.get("values", F.lit(1)).alias("balance"),
        F.lit(None).cast("array<double>").alias("alt_amounts"),
        F.lit(False).alias("desc_only"),
        F.lit(False).alias("continuation"),
    )


def pipe_tables(pages: DataFrame) -> DataFrame:
    """``(doc, page, table_no, row_no, cells)`` of tables drawn with bars; lines of dashes are left out, and tables of one row."""
    lines = page_lines(likely(pages, F.col("text").contains("|"))).withColumnRenamed("line", "printed")
    lines = once(lines, "line", stripped(F.col("printed"))).drop("printed")
    broken = reduce(or_, [F.col("line").contains(c) for c in "\n\r\x85\u2028\u2029"])
    piped = lines.filter(F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") > 2) & ~broken)
    upto = Window.partitionBy("doc", "page").orderBy("line_no")
    lines = piped.withColumn("table_no", (F.col("line_no") + 1 - F.row_number().over(upto)).cast("bigint"))  # lines without bars up to here
    maybe_drawn = F.col("line").rlike(r"(?U)^[-:|\s]*\z") | F.col("line").contains("<")
    rows = lines.withColumn("cells", markdown_cells(F.col("line"))).filter(~(maybe_drawn & is_separator(F.col("cells"))))
    return _numbered(rows.select("doc", "page", "year_hint", "date_order", "table_no", "line_no", "cells"))


def html_tables(pages: DataFrame) -> DataFrame:
    """``(doc, page, table_no, row_no, cells)`` of HTML tables of two rows or more."""
    every = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?is)(<{tag}.*?</{tag}>)"), F.lit(1))
    pages = likely(pages, F.col("text").contains("<") & F.col("text").rlike("(?i)</table>"))
    tables = pages.select("doc", "page", "year_hint", "date_order", F.posexplode(every(F.col("text"), "table")).alias("table_no", "table"))
    rows = tables.select("doc", "page", "year_hint", "date_order", "table_no", F.posexplode(every(F.col("table"), "tr")).alias("line_no", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_html)
    return _numbered(rows.withColumn("cells", cells).filter(F.size("cells") > 0).drop("row"))


def _numbered(rows: DataFrame) -> DataFrame:
    table = Window.partitionBy("doc", "page", "table_no")
    rows = rows.withColumns({"row_no": F.row_number().over(table.orderBy("line_no")), "rows": F.count(F.lit(1)).over(table)})
    return rows.filter("rows >= 2").drop("rows", "line_no")


def header_roles(cells: Column) -> Column:
    """array<int> in the order of ROLES: the place of the column that has each role, or -1.

    Cells claim in turn; a cell takes the first role that its heading fits and no earlier cell has taken.
    A heading meets the patterns of the roles in turn, and none after the first that it takes.
    """
    bound = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    fits = " ".join(f"WHEN st.taken[{k}] < 0 AND h RLIKE {literal(p.replace(chr(92) + 'b', bound))} THEN {k}" for k, (_, p) in enumerate(COLUMN_ROLES))
    role = let_sql(f"lower({trimmed_sql('c')})", "h", f"CASE WHEN h = '' THEN -1 {fits} ELSE -1 END")
    claim = let_sql(role, "role", "named_struct('i', st.i + 1, 'taken', if(role < 0, st.taken, transform(st.taken, (old, k) -> if(k = role, st.i, old))))")
    start = f"named_struct('i', 0, 'taken', array_repeat(-1, {len(ROLES)}))"
    return told(cells, f"aggregate(x, {start}, (st, c) -> {claim}, st -> st.taken)")


def is_transaction_header(roles: Column) -> Column:
    has = lambda name: roles[ROLES.index(name)] >= 0
    return has("date") & (has("amount") | has("debit") | has("credit") | has("balance"))


def from_tables(pages: DataFrame) -> DataFrame:
    """Tables under a heading with a date and money: the credit column counts before debit, and both before a single amount."""
    head = F.when(F.col("row_no") == 1, header_roles(F.col("cells")))
    roles = F.max(head).over(Window.partitionBy("doc", "page", "table_no"))

    def headed(tables: DataFrame, kind: int) -> DataFrame:
        rows = tables.withColumn("roles", roles).filter((F.col("row_no") > 1) & is_transaction_header(F.col("roles")))
        return rows.withColumn("kind", F.lit(kind))

    rows = headed(pipe_tables(pages), 0).unionByName(headed(html_tables(pages), 1))

    def cell(name: str) -> Column:
        return F.coalesce(F.get("cells", F.get("roles", F.lit(ROLES.index(name)))), F.lit(""))

    rows = rows.withColumns({name: cell(name) for name in ROLES})
    rows = once(rows, "texts", F.struct(stripped(F.col("date")).alias("date"), stripped(F.col("description")).alias("said")))
    date, said = F.col("texts.date"), F.col("texts.said")
    rows = rows.filter(~is_non_transaction(said) & ~is_non_transaction(date) & is_date_like(date))
    rows = once(rows, "token", F.when(is_plain_day(date), date).otherwise(F.coalesce(date_token(date), date)))
    credit, debit, generic = (parse_amount(F.col(c)) for c in ("credit", "debit", "amount"))
    rows = once(rows, "m", F.struct(credit.alias("c"), debit.alias("d"), generic.alias("g"))).withColumns({k: F.col(f"m.{k}") for k in "cdg"})
    credited = (F.col("c") != 0) & (F.col("d").isNull() | (F.col("d") == 0))
    debited = F.col("d") != 0
    kind = F.lower("type")
    typed = (
        F.when(kind.rlike("cr|credit|deposit|in(?![A-Za-z0-9_])"), "credit")
        .when(kind.rlike("dr|debit|withdraw|out(?![A-Za-z0-9_])"), "debit")
        .otherwise(F.coalesce(tentative_type(said), F.when(F.col("g") < 0, "debit")))
    )
    amount = F.when(credited, F.abs("c")).when(debited, -F.abs("d")).otherwise(F.col("g"))
    line_no = (F.col("kind") * 10_000_000 + F.col("table_no") * 10_000 + F.col("row_no")).cast("int")
    return rows.select(
        "doc",
        "page",
        line_no.alias("line_no"),
        date.alias("date"),
        normalize_date(F.col("token"), F.col("year_hint"), F.col("date_order")).alias("date_iso"),
        F.nullif(said, F.lit("")).alias("description"),
        F.nullif(trimmed(F.col("reference")), F.lit("")).alias("reference"),
        amount.alias("amount"),
        F.when(credited, "credit").when(debited, "debit").otherwise(typed).alias("type"),
        parse_amount(F.col("balance")).alias("balance"),
        F.lit(None).cast("array<double>").alias("alt_amounts"),
        F.lit(False).alias("desc_only"),
        F.lit(False).alias("continuation"),
    ).filter("amount IS NOT NULL")


def best_layout(pages: DataFrame) -> DataFrame:
    """Every page's rows in the layout that reads most of it; ties to tables, then lines. ``mode`` says which.

    All layouts read the same exchange of the pages, which their windows need anyhow.
    """
    pages = spread(pages.select("doc", "page", "text", "year_hint", "date_order"), "doc", "page")
    modes = {"tables": from_tables, "lines": from_lines, "cells": from_cells_per_line}
    each = [f(pages).withColumn("mode", F.lit(name)) for name, f in modes.items()]
    rows = reduce(DataFrame.unionByName, each)
    page = Window.partitionBy("doc", "page")
    read = {name: F.count_if((F.col("mode") == name) & ~F.col("desc_only")).over(page) for name in modes}
    tables, lines, cells = (F.col("read")[name] for name in modes)
    # lines alone can have rows of which none counts
    best = (
        F.when(F.col("mode") == "tables", (tables >= lines) & (tables >= cells))
        .when(F.col("mode") == "lines", ((lines > tables) | (tables == 0)) & (lines >= cells))
        .otherwise((cells > tables) & (cells > lines))
    )
    return rows.withColumn("read", F.struct(*[n.alias(name) for name, n in read.items()])).filter(best).drop("read")


def parse_documents(pages: DataFrame) -> DataFrame:
    """Rows of whole documents, ``seq`` numbering them in printed order."""
    in_order = Window.partitionBy("doc").orderBy("page", "line_no")
    return best_layout(pages).withColumn("seq", F.row_number().over(in_order).cast("bigint"))
