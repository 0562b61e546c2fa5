"""What a document's whole text says about itself: date order, year, currency, class, labels, stated totals."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    DATE_TOKEN,
    MONEY_LIKE,
    PURE_MONEY,
    amount_sql,
    let,
    let_sql,
    literal,
    money_tokens_sql,
    normalize_date,
    parse_amount,
    told,
    trimmed,
    trimmed_sql,
)
from .spread import spread

# The signals by which documents are classed, currencies counted and labels found.
CLASS_SIGNALS = {
    "bank_statement": (
        r"account\s+statement|statement\s+of\s+account|bank\s+statement|statement\s+activity",
        r"(?:opening|beginning)\s+balance",
        r"(?:closing|ending)\s+balance",
        r"withdraw|deposit",
        r"branch|ifsc|iban|sort\s+code|routing",
        r"available\s+balance|running\s+balance|average\s+balance",
        r"transaction\s+detail",
        r"statement\s+(?:date|period|thru)",
    ),
    "mobile_wallet_statement": (
        r"bkash|nagad|rocket|upay|wallet",
        r"cash\s+in|cash\s+out",
        r"send\s+money|receive\s+money|mobile\s+recharge",
        r"merchant\s+payment",
    ),
    "credit_card_statement": (
        r"credit\s+card",
        r"minimum\s+(?:amount\s+)?(?:payment|due)",
        r"payment\s+due\s+date",
        r"credit\s+limit",
        r"card\s+(?:no|number)",
    ),
    "invoice": (r"\binvoice\b", r"bill\s+to", r"subtotal", r"total\s+due|amount\s+due", r"payment\s+terms|po\s+number"),
    "receipt": (r"\breceipt\b", r"change\s+due|cash\s+tendered", r"cashier|till", r"thank\s+you\s+for"),
    "payslip": (
        r"payslip|pay\s+slip|salary\s+slip",
        r"gross\s+(?:pay|salary)",
        r"net\s+pay",
        r"deductions",
        r"employee\s+(?:id|no)",
    ),
}
CURRENCY_SIGNALS = {
    "BDT": r"(?i)৳|\bBDT\b|\bTk\.?\b|taka",
    "USD": r"\$|\bUSD\b",
    "EUR": r"€|\bEUR\b",
    "GBP": r"£|\bGBP\b",
    "INR": r"₹|\bINR\b|\bRs\.?\b",
    "JPY": r"¥|\bJPY\b",
}
#: What a text has, in lower case, in which a currency's pattern can find anything.
CURRENCY_MARKS = {"BDT": ("৳", "bdt", "tk", "taka"), "USD": ("$", "usd"), "EUR": ("€", "eur"), "GBP": ("£", "gbp"), "INR": ("₹", "inr", "rs"), "JPY": ("¥", "jpy")}
DATED_LINE = r"^(?:[A-Z][a-z]{2}\s+\d{1,2}|\d{1,2}[-/.]\d{1,2})(?:[-/.]\d{2,4})?\s+\S"
MONEY_IN_LINE = r"\d[.,]\d{2}(?![A-Za-z0-9_])|\d,\d{3}"
ORGANISATION = (
    r"(?i)(?<![A-Za-z0-9_])(?:bank|plc|ltd|limited|inc\.?|llc|corp(?:oration)?|company|financial|finance|n\.a\.|gmbh)(?![A-Za-z0-9_])"
)
BRAND = r"(?i)bkash|nagad|rocket|paypal|stripe|wise|payoneer"
#: What a line has, in lower case, in which one of these can be found.
COMPANY_MARKS = ("bank", "plc", "ltd", "limited", "inc", "llc", "corp", "company", "financ", "n.a.", "gmbh", *BRAND.removeprefix("(?i)").split("|"))
ACCOUNT_NUMBER_LABEL = (
    r"account\s*(?:no|number|#)|a/c\s*(?:no|number)?|acct\.?\s*(?:no|number)?|\biban\b|wallet\s*(?:no|number)"
)
ACCOUNT_NAME_LABEL = (
    r"account\s*(?:name|holder|title|owner)(?:\(s\))?|customer\s*name|name\s+of\s+(?:account\s+)?holder"
)
OPENING_LABEL = r"(?i)(?:opening|beginning|previous)\s+balance|balance\s+(?:b/?f|brought\s+forward)"
CLOSING_LABEL = r"(?i)(?:closing|ending|new)\s+balance|balance\s+(?:c/?f|carried\s+forward)"
STATED_CREDITS = (
    r"(?i)(?:deposits(?:\s+and\s+credits)?|total\s+credits?)\s*\((\d+)\)\s*[-−]?[$€£₹৳¥]?\s?[-−]?([\d,]+\.?\d*)"
)
STATED_DEBITS = (
    r"(?i)(?:withdrawals(?:\s+and\s+debits)?|total\s+debits?)\s*\((\d+)\)\s*[-−]?[$€£₹৳¥]?\s?[-−]?([\d,]+\.?\d*)"
)
PERIOD = (
    r"(?i)(?:statement\s+period|period|statement\s+for|for\s+the\s+period)\s*[:\-]?\s*"
    rf"({DATE_TOKEN})\s*(?:to|through|till|until|[-–—])\s*({DATE_TOKEN})"
)
#: Two numbers of one or two digits, a third one behind them or not, within ASCII word bounds.
DATE_PAIR = r"\d(?<![A-Za-z0-9_]\d)\d?SEPARATOR\d{1,2}(?:[/.-]\d{2,4})?(?![A-Za-z0-9_])"
#: 19 or 20 and two digits within ASCII word bounds; its first digit is looked for before the bound.
YEAR = r"([12](?<![A-Za-z0-9_][12])(?:(?<=1)9|(?<=2)0)\d{2})(?![A-Za-z0-9_])"
OPENED_AS_OF = rf"(?i)(?:beginning|opening)\s+balance\s+as\s+of\s+({DATE_TOKEN})"
CLOSED_AS_OF = rf"(?i)(?:ending|closing)\s+balance\s+as\s+of\s+({DATE_TOKEN})"
NO_COMPANY = r"(?i)statement|page\s+\d"
NUMBER_LIKE = r"(?:[\dXx*][\s-]?){5,}"


def ascii_bounds(pattern: str) -> str:
    """Word bounds that only ASCII letters, digits and _ make; before a letter or digit it is enough to look back, from behind a letter that is there."""
    pattern = re.sub(r"\\b([A-Za-z])(?![?*+{])", r"\1(?<![A-Za-z0-9_]\1)", pattern)
    pattern = re.sub(r"\\b(?=(?:\((?:\?:)?)*(?:\\d|[A-Za-z0-9]))", lambda _: "(?<![A-Za-z0-9_])", pattern)
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def holds_sql(marks: tuple[str, ...]) -> str:
    """Whether a text whose lower case goes by l holds one of the marks: far cheaper than a search by pattern."""
    return "(" + " OR ".join(f"contains(l, '{m}')" for m in dict.fromkeys(marks)) + ")"


def needed(pattern: str) -> tuple[str, ...]:
    """Of each alternative of a signal the longest word that stands outside its groups, without which it finds nothing."""
    flat = pattern.replace(r"\b", "")
    while (inner := re.sub(r"\([^()]*\)\??", "\0", flat)) != flat:
        flat = inner
    return tuple(max(re.findall("[a-z]+", alternative.replace(r"\s", "\0")), key=len) for alternative in flat.split("|"))


def spellings(pattern: str) -> tuple[tuple[str, ...], ...]:
    """The words of each way to spell a signal or label, its groups told apart; what may be left out is no word of any."""
    ways, words = [re.sub(r"\(\?i\)|\\b", "", pattern).replace(r"\s", "\0")], []
    for way in ways:
        if group := re.search(r"\((?:\?:)?([^()]*)\)(\??)", way):
            options = ["\0"] if group[2] else group[1].split("|")
            ways += [way[: group.start()] + option + way[group.end() :] for option in options]
        else:
            words += [tuple(dict.fromkeys(re.findall("[a-z]+", re.sub("[a-z][?*]", "\0", x)))) for x in way.split("|")]
    return tuple(dict.fromkeys(words))


def likely_sql(pattern: str) -> str:
    """Whether a text whose lower case goes by l has all words of some way to spell the pattern, which finds nothing else."""
    every = " OR ".join("(" + " AND ".join(f"contains(l, '{word}')" for word in way) + ")" for way in spellings(pattern))
    return f"({holds_sql(needed(pattern))} AND ({every}))"


def date_order(text: Column) -> Column:
    """MDY if more number pairs can only be month first than only day first; else DMY."""
    late = r"(?:1[3-9]|[2-9]\d)"

    def many(before: str, after: str) -> Column:
        """How many pairs are so; a place without a digit is passed at once, and their order is told at the separator."""
        pair = DATE_PAIR.replace("SEPARATOR", f"(?:{before}([/.-]){after}|[/.-])")
        return F.size(F.array_remove(F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.lit("")))

    return F.when(many(f"(?<!{late})", f"(?={late})") > many(f"(?<={late})", f"(?!{late})"), "MDY").otherwise("DMY")


def year_hint(text: Column) -> Column:
    """The commonest year from 1900 to 2099, the first seen on a tie; null if none is written."""
    years = f"regexp_extract_all(x, {literal(YEAR)}, 1)"
    left = "transform(apart, y -> size(array_remove(years, y)))"
    first = "CAST(try_element_at(apart, CAST(array_position(left, array_min(left)) AS INT)) AS INT)"
    return told(text, let_sql(years, "years", let_sql("array_distinct(years)", "apart", let_sql(left, "left", first))))


def currency(text: Column) -> Column:
    """The currency written most often, the earlier of CURRENCY_SIGNALS on a tie; null if none is."""
    counts = ", ".join(f"if({holds_sql(CURRENCY_MARKS[c])}, regexp_count(x, {literal(ascii_bounds(p))}), 0)" for c, p in CURRENCY_SIGNALS.items())
    names = ", ".join(f"'{c}'" for c in CURRENCY_SIGNALS)
    most = f"CASE WHEN array_max(counts) > 0 THEN element_at(array({names}), CAST(array_position(counts, array_max(counts)) AS INT)) END"
    return told(text, let_sql("lower(x)", "l", let_sql(f"array({counts})", "counts", most)))


def class_scores(text: Column) -> Column:
    """struct of each class's share of signals found."""

    def share(found: tuple[str, ...]) -> str:
        return " + ".join(f"CAST(if({likely_sql(p)}, x RLIKE {literal('(?i)' + ascii_bounds(p))}, x IS NULL AND NULL) AS INT)" for p in found)

    shares = ", ".join(f"'{name}', ({share(found)}) / {len(found)}" for name, found in CLASS_SIGNALS.items())
    return told(text, let_sql("lower(x)", "l", f"named_struct({shares})"))


def classify(scores: Column) -> Column:
    """struct(document_type, confidence) of class scores."""
    names = list(CLASS_SIGNALS)
    array = F.array(*[scores[n] for n in names])
    best = F.array_max(array)
    name = F.element_at(F.array(*map(F.lit, names)), F.array_position(array, best).cast("int"))
    wallet = (name == "bank_statement") & (scores["mobile_wallet_statement"] >= 0.5)
    return F.struct(
        F.when(wallet, "mobile_wallet_statement").when(best >= 0.3, name).otherwise("document").alias("document_type"),
        F.when(wallet, scores["mobile_wallet_statement"])
        .when(best >= 0.3, F.least(F.lit(1.0), best + 0.2))
        .otherwise(0.3)
        .alias("confidence"),
    )


def money_coverage(text: Column) -> Column:
    """struct(rows, money_rows, coverage): of the date-led lines, those with money; coverage 1 without lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), trimmed), lambda x: x.rlike(DATED_LINE))
    money = F.size(F.filter(lines, lambda x: x.rlike(MONEY_IN_LINE)))
    rows = F.size(lines)
    return F.struct(
        rows.cast("bigint").alias("rows"),
        money.cast("bigint").alias("money_rows"),
        F.when(rows > 0, money / rows).otherwise(1.0).alias("coverage"),
    )


def first_match(text: Column, pattern: str) -> Column:
    """What the pattern first matches, empty if nothing: the text is searched once, and groups are then read off the match."""
    return F.regexp_extract(text, pattern, 0)


def stated_totals(text: Column) -> Column:
    """struct(credit_count, total_credits, debit_count, total_debits) as the text prints them; null without either."""

    def part(found: Column, pattern: str) -> tuple[Column, Column]:
        count = F.regexp_extract(found, pattern, 1)
        return F.nullif(count, F.lit("")).try_cast("bigint"), parse_amount(F.nullif(F.regexp_extract(found, pattern, 2), F.lit("")))

    def whole(both: Column) -> Column:
        (cn, ct), (dn, dt) = part(both["c"], STATED_CREDITS), part(both["d"], STATED_DEBITS)
        values = F.struct(cn.alias("credit_count"), ct.alias("total_credits"), dn.alias("debit_count"), dt.alias("total_debits"))
        return F.when((both["c"] != "") | (both["d"] != ""), values)

    return let(F.struct(first_match(text, STATED_CREDITS).alias("c"), first_match(text, STATED_DEBITS).alias("d")), whole)


def labelled_value(text: Column, label: str, valid=lambda v: F.lit(True)) -> Column:
    """What follows a label on its line, up to a wide gap or a bar; the first that is valid."""
    pattern = "(?i)(?:" + ascii_bounds(label) + r")\s*[:.\-]*\s*(.{2,80})"
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda v: trimmed(F.regexp_replace(F.element_at(F.split(v, r"\s{3,}|\||\n"), 1), "[,;.]+$", "")),
    )
    return F.get(F.filter(found, lambda v: (v != "") & valid(v)), F.lit(0))


def labelled_amount(text: Column, label: str) -> Column:
    """The last money on the first labelled line that has any, or a money line within the two after it."""
    after = lambda n: trimmed_sql(f"coalesce(get(lines, i + {n}), 'x')")
    below = f"if({after(1)} <> '', {after(1)}, {after(2)})"
    pure = f"CASE WHEN below RLIKE {literal(PURE_MONEY)} AND below RLIKE {literal(MONEY_LIKE)} THEN {amount_sql('below')} END"
    own = let_sql(f"regexp_replace(get(lines, i), {literal(label)}, ' ')", "said", money_tokens_sql("said"))
    value = let_sql(own, "own", f"CASE WHEN size(own) > 0 THEN element_at(own, -1).value ELSE {let_sql(below, 'below', pure)} END")
    worth = holds_sql(needed(label)).replace("(l,", "(lower(get(lines, i)),")
    named = f"filter(sequence(0, size(lines) - 1), i -> {worth} AND get(lines, i) RLIKE {literal(label)})"
    values = f"get(filter(transform({named}, i -> {value}), v -> v IS NOT NULL), 0)"
    found = let_sql(r"split(x, r'\r?\n')", "lines", values)
    return told(text, let_sql("lower(x)", "l", f"CASE WHEN {likely_sql(label)} THEN {found} END"))


def company_name(first_page: Column) -> Column:
    """Of the first twelve lines the first with an organisation's or brand's word; else the first that is no heading."""
    # marks and white space of all lines at once
    spaced = F.regexp_replace(F.translate(first_page, "|*_`", "    "), r"(?U)[\s&&[^\n]]+", " ")
    tidy = F.transform(F.split(spaced, "\n"), lambda x: F.trim(F.when(x.startswith("#"), F.regexp_replace(x, r"^#+\s*", "")).otherwise(x)))
    top = F.slice(F.filter(tidy, lambda x: F.length(x) >= 3), 1, 12)
    short = lambda x: F.length(x) <= 70
    marked = lambda x: let(F.lower(x), lambda l: reduce(or_, [l.contains(m) for m in COMPANY_MARKS]))
    named = F.filter(top, lambda x: marked(x) & x.rlike(f"{ORGANISATION}|{BRAND}") & short(x) & ~x.rlike(NO_COMPANY))
    other = F.filter(top, lambda x: short(x) & ~x.rlike(f"{NO_COMPANY}|date"))
    return F.coalesce(F.get(named, F.lit(0)), F.get(other, F.lit(0)))


def statement_period(text: Column, hint: Column, order: Column) -> Column:
    """struct(from, to) of the printed period, or of the balances' as-of dates; null without any."""

    def day(found: Column, pattern: str, n: int) -> Column:
        raw = F.nullif(F.regexp_extract(found, pattern, n), F.lit(""))
        return let(raw, lambda x: F.coalesce(normalize_date(x, hint, order), x))

    def printed(found: Column) -> Column:
        return F.when(found != "", F.struct(day(found, PERIOD, 1).alias("from"), day(found, PERIOD, 2).alias("to"))).otherwise(as_of)

    def balances(both: Column) -> Column:
        ends = F.struct(day(both["o"], OPENED_AS_OF, 1).alias("from"), day(both["c"], CLOSED_AS_OF, 1).alias("to"))
        return F.when((both["o"] != "") | (both["c"] != ""), ends)

    as_of = let(F.struct(first_match(text, OPENED_AS_OF).alias("o"), first_match(text, CLOSED_AS_OF).alias("c")), balances)
    return let(first_match(text, PERIOD), printed)


def gathered(pages: DataFrame, *columns: str) -> DataFrame:
    """``(doc, kept, text, first_page)``, one row per document; ``kept`` has the pages' columns.

    Documents are dealt out by an explicit exchange, which adaptive execution does not
    shrink to a few tasks because the text is small: what is read off it is dear.
    """
    docs = spread(pages.select("doc", *columns), "doc").groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("kept"))
    docs = docs.withColumn("pieces", F.sort_array(F.transform("kept", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text")))))
    text = F.array_join(F.transform("pieces", lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n")
    return docs.select("doc", "kept", text.alias("text"), F.coalesce(F.col("pieces")[0]["text"], F.lit("")).alias("first_page"))


def document_texts(pages: DataFrame) -> DataFrame:
    """``pages(doc, page, text)`` -> ``(doc, text, first_page)``, one row per document."""
    return gathered(pages, "page", "text").drop("kept")


def document_hints(pages: DataFrame) -> DataFrame:
    """``pages(doc, page, text)`` -> one row per document: its text, first page, year hint and date order."""
    docs = document_texts(pages)
    return docs.select("*", year_hint(F.col("text")).alias("year_hint"), date_order(F.col("text")).alias("date_order"))


def with_hints(pages: DataFrame) -> DataFrame:
    """``pages`` with their document's year hint and date order, as the parsers take them; pages of no document are left out.

    A document's pages are gathered for its text anyhow and handed on from there, so that what gives the pages runs once.
    """
    others = [c for c in pages.columns if c != "doc"]
    docs = gathered(pages.filter("doc IS NOT NULL"), *others)
    hinted = docs.select("doc", "kept", year_hint(F.col("text")).alias("year_hint"), date_order(F.col("text")).alias("date_order"))
    return hinted.select("doc", "year_hint", "date_order", F.explode("kept").alias("p")).select("doc", *[F.col("p")[c].alias(c) for c in others], "year_hint", "date_order")


def document_metadata(hints: DataFrame, *more: str) -> DataFrame:
    """Class, names, account, period, currency, balances and totals that a document prints, and ``more`` of the hints' columns."""
    text = F.col("text")
    number_like = lambda v: v.rlike(NUMBER_LIKE) & (F.length(F.regexp_replace(v, r"\D", "")) >= 4)
    number = labelled_value(text, ACCOUNT_NUMBER_LABEL, number_like)
    number = F.element_at(F.split(F.trim(F.regexp_replace(number, r"[^A-Za-z0-9*\- ]", "")), r"\s{2,}"), 1)
    return hints.withColumn("scores", class_scores(text)).select(
        "doc",
        classify(F.col("scores")).alias("class"),
        "scores",
        company_name(F.col("first_page")).alias("company_name"),
        labelled_value(text, ACCOUNT_NAME_LABEL).alias("account_name"),
        number.alias("account_number"),
        statement_period(text, F.col("year_hint"), F.col("date_order")).alias("period"),
        currency(text).alias("currency"),
        labelled_amount(text, OPENING_LABEL).alias("opening"),
        labelled_amount(text, CLOSING_LABEL).alias("closing"),
        stated_totals(text).alias("stated"),
        *more,
    )
