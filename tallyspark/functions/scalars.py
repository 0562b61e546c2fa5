"""Scalar functions on text, money, dates and identifiers, as Column expressions.

Parsed text is never trusted: numbers and dates go through ``try_`` forms, so a
cell that is no number is null and no error, in ANSI mode too.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and word lists that decide what a statement's text means.
CURRENCY = "$€£₹৳¥"
AMOUNT_TOKEN = (
    r"\(?-?[$€£₹৳¥]?\s?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?\)?(?:\s?(?:Cr|Dr|CR|DR))?"
    r"|\(?-?[$€£₹৳¥]?\s?\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?\)?"
)
DATE_TOKEN = (
    r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
    r"|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"
    r"|\d{1,2}[\s\-.]?[A-Za-z]{3,9}[\s\-.,]?\s?\d{2,4}"
    r"|[A-Za-z]{3,9}[\s\-.]?\d{1,2}(?:st|nd|rd|th)?[\s,.]+\d{2,4}"
    r"|[A-Za-z]{3,9}[\s.]+\d{1,2}\b"
    r"|\d{1,2}[\s.]+[A-Za-z]{3,9}\b"
    r"|\d{1,2}/\d{1,2}\b"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NON_TRANSACTION = (
    r"(?i)^(?:sub\s*)?total\b|(?:beginning|opening|closing|ending|average|available)\s+balance"
    r"|balance\s+(?:b/?f|c/?f|brought|carried|as\s+of)|grand\s+total|service\s+charges?\s+for\s+(?:the\s+)?period"
    r"|^page\s+\d|statement\s+(?:date|thru|period)"
)
NON_TRANSACTION_MARKS = ("total", "balance", "service", "page", "statement")
CHECKS_PAID = r"(?i)number\s+of\s+checks\s+paid"
CREDIT_WORDS = r"(?i)credit|deposit|reward|refund|rebate|interest\s+(?:paid|earned)|cash\s?back|salary|payroll|received|reversal"
CREDIT_MARKS = ("credit", "deposit", "reward", "refund", "rebate", "interest", "cash", "salary", "payroll", "received", "reversal")
DEBIT_WORDS = r"(?i)debit|withdraw|purchase|payment|fee|charge|pos\b|atm\b|bill|transfer\s+to|sent|paid\s+out"
DEBIT_MARKS = ("debit", "withdraw", "purchase", "payment", "fee", "charge", "pos", "atm", "bill", "transfer", "sent", "paid")
BALANCE_LINE = (
    r"(?i)(?<![A-Za-z0-9_])(?:bal(?:ance)?\s*(?:b/?f|c/?f|fwd|brought|carried)|brought\s+forward|carried\s+forward"
    r"|opening\s+balance|closing\s+balance|previous\s+balance|sub[\s-]?total|grand\s+total)(?![A-Za-z0-9_])|^\s*total(?![A-Za-z0-9_])"
)
PURE_MONEY = r"^[-(]?\s?[$€£₹৳¥]?\s?-?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?\)?$"
MONEY_LIKE = r"\d\.\d{2}(?![A-Za-z0-9_])|\d,\d{3}|[$€£₹৳¥]\s?\d"
#: What a text has that holds anything like money, wherever its tokens end.
MAYBE_MONEY = r"\d\.\d{2}|\d,\d{3}|[$€£₹৳¥]\s?\d"
NEGATIVE = (r"(?s)^\(.*\)$", r"(?i)(?<![A-Za-z0-9_])(?:dr|debit)\.?\s*\)?$")
NEGATIVE_BARE = r"^\(?[-−]|[-−]\)?$"
#: (pattern, groups of year, month and day; 0 where there is none); all-number days and months may be the other way round
DATE_SPELLINGS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 1, 2, 3, "fixed"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", 3, 2, 1, "numbers"),
    (r"^(\d{1,2})[\s\-.]?([A-Za-z]{3,9})[\s\-.,]?\s?(\d{4}|\d{2})$", 3, 2, 1, "name"),
    (r"^([A-Za-z]{3,9})[\s\-.]?(\d{1,2})(?:st|nd|rd|th)?[\s,.]+(\d{4}|\d{2})$", 3, 1, 2, "name"),
    (r"^([A-Za-z]{3,9})[\s.]+(\d{1,2})$", 0, 1, 2, "name"),
    (r"^(\d{1,2})[\s.]+([A-Za-z]{3,9})$", 0, 2, 1, "name"),
    (r"^(\d{1,2})[/-](\d{1,2})$", 0, 2, 1, "numbers"),
)
CLIPPED = "\n…[clipped]"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DOCUMENT_TYPES = (
    "bank_statement",
    "credit_card_statement",
    "mobile_wallet_statement",
    "loan_statement",
    "investment_statement",
    "other",
)
#: Stages of a job and the percent of the bar that each owns.
STAGES = {"fetching": (0, 5), "reading": (5, 60), "analyzing": (60, 92), "reconciling": (92, 99), "done": (100, 100)}

EMBEDDED_MIN = 200
BLANK = r"\s"
#: What (?U)\s matches: the white space of Unicode.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Most figures and days are spelt so, and are read without what the other spellings take.
PLAIN_AMOUNT = r"^ ?-?[$€£₹৳¥]? ?(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.[0-9]+)?\z"
#: Words and, last, two amounts with cents, in a table's row between bars: no more tokens of money than these two.
PLAIN_PAIR = r"^(?:[A-Za-z0-9 |]* )?-?[0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2} (?:\| )*-?[0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2}(?: \|)*\z"
PLAIN_ISO = r"^(?:19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\z"
EARLY_DAY = r"^(?:19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])\z"
PLAIN_INT = r"^[0-9]{1,9}\z"
PLAIN_NUMBERS = r"^(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20|21)[0-9]{2}\z"
#: Stands before each part of a line that :func:`mark_plain_lines` has taken apart.
MARK = "\x01"


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def let_sql(value: str, name: str, body: str) -> str:
    """:func:`let` in SQL text: ``body``, in which the value goes by ``name``.

    ``element_at`` knows its type once; ``get`` works it out of all that is nested in it, row by row.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def told(value: Column, body: str) -> Column:
    """SQL of a value that it calls x.

    The larger expressions are written as SQL, which is parsed in one go; put together
    call by call, each of them takes the driver a good part of a second.
    """
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"x -> {body}")), 1)


def literal(text: str) -> str:
    """A pattern as an SQL literal."""
    return f"r'{text}'"


def trimmed_sql(text: str) -> str:
    return f"btrim({text}, '{WHITE_SPACE}')"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end, non-breaking spaces included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def stripped(text: Column) -> Column:
    """:func:`trimmed` for a column that is at hand: one that starts and ends in printable ASCII is not searched."""
    inked = lambda at: F.substring(text, at, 1).between("!", "~")
    return F.when(inked(1) & inked(-1), text).otherwise(trimmed(text))


def holds(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds one of the marks, without which a dearer pattern need not be tried."""
    low = F.lower(text)
    return reduce(or_, [low.contains(m) for m in marks])


# Text


def text_key(text: Column) -> Column:
    """Upper case, everything but A-Z and 0-9 as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " ")), F.lit(""))


def account_key(text: Column) -> Column:
    """The digits, if there are four; else the text key."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, digits).otherwise(text_key(text))


def trimmed_or_null(text: Column) -> Column:
    kept = stripped(text)
    # no text of more than four bytes is one of these in lower case
    return F.when((F.octet_length(kept) > 4) | ~F.lower(kept).isin("", "null", "n/a"), kept)


def document_type(text: Column) -> Column:
    """Unknown types are ``other``; no type stays null."""
    kept = trimmed_or_null(text)
    return F.when(kept.isNull(), F.lit(None)).when(kept.isin(*DOCUMENT_TYPES), kept).otherwise("other")


def strip_html(text: Column) -> Column:
    """Tags become spaces, four references are decoded, white space is one space."""
    out = whole = F.when(text.contains("<"), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text)
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.when(text.contains("&"), out).otherwise(whole), r"(?U)\s+", " "))


def markdown_cells(line: Column) -> Column:
    """The cells of a pipe-table line."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^\s*\|", ""), r"\|\s*$", "")
    unbroken = lambda c: F.when(c.contains("<"), F.regexp_replace(c, r"(?i)<br\s*/?\s*>", " ")).otherwise(c)
    # between bars at both ends, without two spaces in a row: no more than one is next to a bar
    plain = line.startswith("|") & line.endswith("|") & (F.length(line) > 1) & ~line.contains("<") & ~line.contains("  ") & line.rlike(r"^[ -~]*+\z")
    tight = F.trim(F.substring(line, F.lit(2), F.length(line) - 2))
    for loose in (" |", "| "):
        tight = F.replace(tight, F.lit(loose), F.lit("|"))
    return F.when(plain, F.split(tight, r"\|")).otherwise(F.transform(F.split(inner, r"\|"), lambda c: trimmed(unbroken(c))))


def is_separator(cells: Column) -> Column:
    """A row of dashes, as under a pipe table's header."""
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    drawn = lambda c: (c == "") | F.when(c.contains("-"), bare(c).rlike(r"^:?-{2,}:?$")).otherwise(bare(c) == "")
    return F.forall(cells, drawn) & F.exists(cells, lambda c: c.contains("-"))


def is_non_transaction(text: Column) -> Column:
    return holds(text, NON_TRANSACTION_MARKS) & text.rlike(NON_TRANSACTION) & ~text.rlike(CHECKS_PAID)


def is_balance_line(text: Column) -> Column:
    return F.coalesce(text.rlike(BALANCE_LINE), F.lit(False))


def tentative_type(description: Column) -> Column:
    """credit or debit by the words; both kinds of words: credit if the last word is one of credit, else null."""
    said = F.coalesce(description, F.lit(""))
    credit, debit = holds(said, CREDIT_MARKS) & said.rlike(CREDIT_WORDS), holds(said, DEBIT_MARKS) & said.rlike(DEBIT_WORDS)
    last = F.element_at(F.split(said, r"\s+"), -1)
    return F.when(credit & ~debit, "credit").when(debit & ~credit, "debit").when(credit & last.rlike(CREDIT_WORDS), "credit")


def clip(text: Column, n: int) -> Column:
    """The first ``n`` characters and a mark, if there are more; null is empty."""
    said = F.coalesce(text, F.lit(""))
    return F.when(F.length(said) > n, F.concat(F.substring(said, 1, n), F.lit(CLIPPED))).otherwise(said)


def clip_line(text: Column, n: int) -> Column:
    """One line of ``n`` characters at most, the last one an ellipsis if there are more; null is empty."""
    said = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(said) > n, F.concat(F.substring(said, 1, n - 1), F.lit("…"))).otherwise(said)


def json_text(value: Column) -> Column:
    """A struct as JSON in which nulls stay, as readers must send every property."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def is_pdf(mime: Column, name: Column) -> Column:
    """An upload counts as PDF by its media type or by its file name."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID)


# Money


def amount_sql(raw: str) -> str:
    """Money as a double: the last separator says which locale; brackets, a minus or a trailing dr make it negative."""
    last = lambda mark: f"if(instr(k, '{mark}') = 0, -1, length(k) - instr(reverse(k), '{mark}'))"
    european = f"{last(',')} > {last('.')} AND length(k) - {last(',')} - 1 BETWEEN 1 AND 2"
    turned = f"if({european}, regexp_replace(translate(k, '.', ''), '^([^,]*),', '$1.'), translate(k, ',', ''))"
    number = f"CASE WHEN k RLIKE '[0-9]' THEN try_cast({turned} AS DOUBLE) END"
    bare = f"regexp_replace(s, {literal(f'(?U)[{CURRENCY}' + BLANK + ']')}, '')"
    negative = " OR ".join([*[f"s RLIKE {literal(p)}" for p in NEGATIVE], f"{bare} RLIKE {literal(NEGATIVE_BARE)}"])
    signed = let_sql(number, "n", f"CASE WHEN {negative} THEN -abs(n) ELSE n END")
    other = let_sql(trimmed_sql(raw), "s", let_sql("regexp_replace(s, '[^0-9.,]', '')", "k", signed))
    plain = f"try_cast(translate({raw}, ', {CURRENCY}', '') AS DOUBLE)"
    return f"CASE WHEN {raw} RLIKE {literal(PLAIN_AMOUNT)} THEN {plain} WHEN {raw} RLIKE '[0-9]' THEN {other} END"


def parse_amount(raw: Column) -> Column:
    """See :func:`amount_sql`; what is plain is read before the lambda."""
    plain = F.translate(raw, f", {CURRENCY}", "").try_cast("double")
    figure = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    return F.when(raw.rlike(f"^{PLAIN_FIGURE}\\z"), figure).when(raw.rlike(PLAIN_AMOUNT), plain).when(raw.rlike("[0-9]"), told(raw, amount_sql("x")))


def cents_of(value: Column) -> Column:
    """A double as whole cents, halves up."""
    return F.floor(value * 100 + 0.5).cast("bigint")


def to_cents(raw: Column) -> Column:
    """Money text as whole cents."""
    return cents_of(parse_amount(raw))


def from_cents(cents: Column) -> Column:
    return cents / F.lit(100)


def round2(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def round4(value: Column) -> Column:
    return F.floor(value * 10000 + 0.5) / 10000


def near(a: Column, b: Column, within: float = 0.015) -> Column:
    return F.abs(a - b) < F.lit(within)


def int_or_null(raw: Column) -> Column:
    """A number's whole part; null for anything that is no number, the empty text included."""
    value = trimmed(raw)
    plain = F.when(raw.rlike(PLAIN_INT), raw.try_cast("bigint"))
    number = F.when(value.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), value.try_cast("double"))
    return F.coalesce(plain, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint"))


def is_money_like(raw: Column) -> Column:
    """Decimals, thousand groups or a currency sign; bare integers are no money."""
    return raw.rlike(MONEY_LIKE)


def is_pure_money(line: Column) -> Column:
    return line.rlike(PURE_MONEY) & is_money_like(line)


def money_tokens_sql(text: str) -> str:
    """array<struct<raw, value, rest>> of the money tokens of a text in order; ``rest`` is how much text follows the token's start.

    A token is what the pattern finds and is_money_like accepts. The text after
    each find is carried along, since the built-in finder gives no positions.
    """
    kind = "array<struct<raw:string,value:double,rest:int>>"
    token = "array(named_struct('raw', found, 'value', v, 'rest', CAST(length(st.tail) - at + 1 AS INT)))"
    kept = f"CASE WHEN found RLIKE {literal(MONEY_LIKE)} THEN {let_sql(amount_sql('found'), 'v', f'CASE WHEN v IS NOT NULL THEN {token} END')} END"
    step = (
        "named_struct('tail', substring(st.tail, at + length(found), length(st.tail)),"
        f" 'out', {let_sql(kept, 'one', 'if(one IS NULL, st.out, concat(st.out, one))')})"
    )
    start = f"named_struct('tail', {text}, 'out', CAST(array() AS {kind}))"
    finds = f"regexp_extract_all({text}, {literal(f'({AMOUNT_TOKEN})')}, 1)"
    tokens = f"aggregate({finds}, {start}, (st, found) -> {let_sql('instr(st.tail, found)', 'at', step)}, st -> st.out)"
    none = f"WHEN NOT {text} RLIKE {literal(MAYBE_MONEY)} THEN CAST(array() AS {kind})"
    return f"CASE WHEN {text} RLIKE {literal(PLAIN_PAIR)} THEN CAST({_last_two(text)} AS {kind}) {none} ELSE {tokens} END"


def _last_two(text: str) -> str:
    """The tokens of a text that is spelt as PLAIN_PAIR has it; a space before a token without sign belongs to it."""

    def token(upto: str, word: str) -> str:
        space = f"if(startswith({word}, '-') OR length({word}) = length({upto}), '', ' ')"
        value = f"try_cast(translate({word}, ',', '') AS DOUBLE)"
        return let_sql(f"concat({space}, {word})", "raw", f"named_struct('raw', raw, 'value', {value}, 'rest', length({text}) - length({upto}) + length(raw))")

    pair = f"array({token('before', 'first')}, {token('upto', 'last')})"
    before = "rtrim(' |', substring(upto, 1, length(upto) - length(last)))"
    words = let_sql(before, "before", let_sql("substring_index(before, ' ', -1)", "first", pair))
    return let_sql(f"rtrim(' |', {text})", "upto", let_sql("substring_index(upto, ' ', -1)", "last", words))


def _words_sought() -> str:
    """Any of the words without which a line is neither left out nor typed, by first letter, so that most places meet one class."""
    words = sorted({*NON_TRANSACTION_MARKS, *CREDIT_MARKS, *DEBIT_MARKS})
    rest = {c: "|".join(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    return f"(?=[{''.join(rest)}])(?:" + "|".join(f"{c}(?:{r})" for c, r in rest.items()) + ")"


#: A day in one of these two spellings, words and such a pair, single spaces between them: a line of a statement, or a table's row between bars,
#: anywhere in a text. Its parts are the day, a word of the kinds sought if it has one, its words and its two amounts.
PLAIN_FIGURE = r"(-?[0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})"
PLAIN_PARTS = (
    rf"(?dm)^(?:\| )?({PLAIN_ISO[1:-2]}|{PLAIN_NUMBERS[1:-2]})(?>(?=[^\n.]*?((?i){_words_sought()}))|)"
    rf"((?: (?:[A-Za-z0-9]++(?![.,])|\|))++) {PLAIN_FIGURE} (?:\| )*{PLAIN_FIGURE}(?: \|)*(?=\r?\n|\z)"
)


def mark_plain_lines(text: Column) -> Column:
    """The text with each plain line taken apart, all in one search: day, words, two amounts and a word sought (empty without one), a MARK before each."""
    return F.regexp_replace(text, PLAIN_PARTS, "".join(f"{MARK}${k}" for k in (1, 3, 4, 5, 2)))


def money_tokens(text: Column) -> Column:
    """See :func:`money_tokens_sql`."""
    return told(text, money_tokens_sql("x"))


# Dates


def date_parts_sql(raw: str, order: str) -> str:
    """struct<year, month, day> of a date in one of eight spellings; a null year where none is written; null if it is no date.

    All-number dates are read day first or, with order MDY, month first, and the
    other way round where only that gives a month.
    """

    def spelt(pattern: str, y: int, m: int, d: int, kind: str) -> str:
        got = lambda n: f"regexp_extract(s, {literal(pattern)}, {n})" if n else "''"
        return f"WHEN s RLIKE {literal(pattern)} THEN named_struct('y', {got(y)}, 'm', {got(m)}, 'd', {got(d)}, 'kind', '{kind}')"

    found = f"CASE {' '.join(spelt(*x) for x in DATE_SPELLINGS)} END"
    months = "map(" + ", ".join(f"'{m}', {i + 1}" for i, m in enumerate(MONTHS)) + ")"
    month = f"if(f.kind = 'name', try_element_at({months}, lower(substring(f.m, 1, 3))), try_cast(f.m AS INT))"
    year, day = "try_cast(nullif(f.y, '') AS INT)", "try_cast(f.d AS INT)"
    turned = f"f.kind = 'numbers' AND {order} = 'MDY'"
    numbers = (
        f"named_struct('year', if(length(f.y) = 2, {year} + 2000, {year}), 'month', if({turned}, {day}, {month}),"
        f" 'day', if({turned}, {month}, {day}), 'free', f.kind = 'numbers')"
    )
    swap = "q.free AND q.month > 12 AND q.day <= 12"
    month, day = f"if({swap}, q.day, q.month)", f"if({swap}, q.month, q.day)"
    fine = f"{month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 AND (q.year IS NULL OR q.year BETWEEN 1900 AND 2200)"
    checked = f"CASE WHEN {fine} THEN named_struct('year', q.year, 'month', {month}, 'day', {day}) END"
    known = f"CASE WHEN f IS NOT NULL THEN {let_sql(numbers, 'q', checked)} END"
    one_space = f"regexp_replace({raw}, {literal('(?U)' + BLANK + '+')}, ' ')"
    return let_sql(trimmed_sql(one_space), "s", let_sql(found, "f", known))


def _dated(raw: Column, order: Column | str, year_hint: Column | None = None) -> Column:
    order = F.lit(order) if isinstance(order, str) else order
    hint = F.lit(None).cast("int") if year_hint is None else year_hint
    return F.struct(raw.alias("raw"), order.alias("ord"), hint.alias("hint"))


def date_parts(raw: Column, order: Column | str = "DMY") -> Column:
    """See :func:`date_parts_sql`."""
    return told(_dated(raw, order), date_parts_sql("x.raw", "x.ord"))


def is_plain_day(raw: Column) -> Column:
    """Whether it is a day in one of the two usual spellings, which :func:`date_parts` takes for one in either order."""
    return raw.rlike(PLAIN_ISO) | raw.rlike(PLAIN_NUMBERS)


def is_date(raw: Column, order: Column | str = "DMY") -> Column:
    """Whether :func:`date_parts` are found."""
    return F.when(is_plain_day(raw), True).otherwise(date_parts(raw, order).isNotNull())


def normalize_date(raw: Column, year_hint: Column | None = None, order: Column | str = "DMY") -> Column:
    """``YYYY-MM-DD`` text; impossible days up to 31 pass, as printed."""
    year = "coalesce(p.year, x.hint)"
    two = lambda n: f"lpad(CAST({n} AS STRING), 2, '0')"
    shown = f"CASE WHEN p IS NOT NULL AND {year} IS NOT NULL THEN concat_ws('-', CAST({year} AS STRING), {two('p.month')}, {two('p.day')}) END"
    other = told(_dated(raw, order, year_hint), let_sql(date_parts_sql("x.raw", "x.ord"), "p", shown))
    return F.when(is_plain_day(raw), plain_day(raw, order)).otherwise(other)


def plain_day(raw: Column, order: Column | str = "DMY") -> Column:
    """:func:`normalize_date` of a day that :func:`is_plain_day` accepts."""
    part = lambda start, n: F.substring(raw, start, n)
    month_first = ((F.lit(order) if isinstance(order, str) else order) == "MDY") | (part(4, 2) > "12")
    month, day = (F.when(month_first, part(a, 2)).otherwise(part(b, 2)) for a, b in ((1, 4), (4, 1)))
    return F.when(part(5, 1) == "-", raw).otherwise(F.concat_ws("-", part(7, 4), month, day))


def date_token(text: Column) -> Column:
    """The first thing in the text that is spelt like a date; null if there is none."""
    return F.nullif(F.regexp_extract(text, f"({DATE_TOKEN})", 1), F.lit(""))


def is_date_like(raw: Column) -> Column:
    day_first = "'DMY'"
    token = f"nullif(regexp_extract(t, {literal(f'({DATE_TOKEN})')}, 1), '')"
    short = let_sql(trimmed_sql("coalesce(x, '')"), "t", f"length(t) <= 24 AND {date_parts_sql(token, day_first)} IS NOT NULL")
    return F.when(is_plain_day(raw), True).otherwise(told(raw, short))


def iso_day(raw: Column) -> Column:
    """The leading ``YYYY-MM-DD``, if it is a day of the calendar."""
    day = F.regexp_extract(trimmed(raw), r"^(\d{4}-\d{2}-\d{2})", 1)
    # every month has 28 days
    return F.when(raw.rlike(EARLY_DAY), raw).when((day != "") & F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd").isNotNull(), day)


# Keys and choices


def row_key(date_iso: Column, date_raw: Column, amount: Column, credit: Column, debit: Column, description: Column) -> Column:
    """What matches a reader's row with another's: day, cents and the start of the description."""
    prefix = F.substring(F.coalesce(text_key(description), F.lit("")), 1, 24)
    return F.concat_ws("|", row_key_loose(date_iso, date_raw, amount, credit, debit), prefix)


def row_key_loose(date_iso: Column, date_raw: Column, amount: Column, credit: Column, debit: Column) -> Column:
    day = F.coalesce(F.nullif(date_iso, F.lit("")), F.nullif(date_raw, F.lit("")), F.lit("?"))
    money = F.coalesce(amount, credit, debit).cast("string")
    return F.concat_ws("|", day, F.coalesce(money, F.lit("?")))


def choose_page_text(embedded: Column, ocr: Column) -> Column:
    """The embedded layer if it has EMBEDDED_MIN characters; else the OCR text, if there is any."""
    enough = F.length(trimmed(embedded)) >= EMBEDDED_MIN
    return F.when(enough, embedded).otherwise(F.coalesce(F.nullif(ocr, F.lit("")), embedded, F.lit("")))


def page_source(embedded: Column, ocr: Column) -> Column:
    enough = F.length(trimmed(F.coalesce(embedded, F.lit("")))) >= EMBEDDED_MIN
    has_ocr = F.length(F.coalesce(ocr, F.lit(""))) > 0
    return F.when(enough | ~has_ocr, "embedded-text").otherwise("glm-ocr")


def stage_percent(low: float, high: float, progress: Column) -> Column:
    """A stage's share of the way, its progress clamped to 0..1, in whole percent."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))
    return F.floor(F.lit(low) + (F.lit(high) - F.lit(low)) * inside + 0.5).cast("int")


