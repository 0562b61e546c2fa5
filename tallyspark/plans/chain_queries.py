"""Queries on the running balance, the votes and the results, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import account_key, from_cents
from ..operators import chain, longdocs, repair, result, vote
from ..sources.folders import staged
from . import ledger as L
from .sql import DAMAGED, LEDGER, READS, TOTALS, VOTE, WALK


def ledger_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger(L.table(spark, sf_dir, "orders"))


def ledger(spark, sf_dir):
    return ledger_of(spark, sf_dir)


def ledger_summary(spark, sf_dir):
    rows = ledger_of(spark, sf_dir)
    return L.ledger_totals(rows)


def sign_resolution(spark, sf_dir):
    """Magnitudes and balances alone give the signs back, but for a document's first row."""
    rows = ledger_of(spark, sf_dir).select(
        "doc", "seq", F.abs(from_cents(F.col("cents"))).alias("amount"), from_cents(F.col("balance")).alias("balance"), F.lit(None).cast("string").alias("type")
    )
    out = chain.resolve_signs(rows)
    return out.select("doc", "seq", F.round(F.col("amount") * 100).cast("bigint").alias("cents"), "type")


def chain_breaks(spark, sf_dir):
    rows = L.damaged(ledger_of(spark, sf_dir)).filter("cents IS NOT NULL")
    rows = rows.select("doc", "seq", from_cents(F.col("cents")).alias("amount"), from_cents(F.col("printed")).alias("balance"))
    return chain.mark_breaks(rows).groupBy("doc").agg(F.count_if("chain_break").alias("breaks"))


def chain_walk(spark, sf_dir):
    rows = chain.walk_balances(L.damaged(ledger_of(spark, sf_dir)))
    return rows.select("doc", "seq", F.when(F.col("cents").isNotNull(), F.col("expected")).alias("expected"), "checked", "severed", "broken")


def as_one_document(rows):
    """All documents one after the other as a single one."""
    return rows.withColumns({"seq": F.col("doc") * 1_000_000 + F.col("seq"), "doc": F.lit(0).cast("bigint")})


def one_document_walk(spark, sf_dir):
    """The walk over all ledgers as one document, in ranges over all tasks."""
    rows = longdocs.walk_balances(as_one_document(L.damaged(ledger_of(spark, sf_dir))))
    return rows.select("seq", F.when(F.col("cents").isNotNull(), F.col("expected")).alias("expected"), "checked", "severed", "broken")


def one_document_signs(spark, sf_dir):
    rows = ledger_of(spark, sf_dir).select(
        "doc", "seq", F.abs(from_cents(F.col("cents"))).alias("amount"), from_cents(F.col("balance")).alias("balance"), F.lit(None).cast("string").alias("type")
    )
    out = longdocs.resolve_signs(as_one_document(rows))
    return out.select("seq", F.round(F.col("amount") * 100).cast("bigint").alias("cents"), "type")


def balance_chain(spark, sf_dir):
    """Three breaks are shown, as seq:expected:printed."""
    found = chain.balance_chain(L.damaged(ledger_of(spark, sf_dir)), 3)
    shown = F.array_join(F.transform("breaks", lambda b: F.concat_ws(":", b["seq"], b["expected"], b["printed"])), " ")
    return found.select("doc", "ok", "checked", "severed", "break_count", shown.alias("shown"))


def repair_fold(spark, sf_dir):
    """Rows with a lost balance or amount are repaired; what remains unrepaired is as it was."""
    rows = ledger_of(spark, sf_dir)
    lost = F.col("id") % 7 == 3
    words = F.col("id") % 7 == 5
    hurt = rows.select(
        "doc",
        "seq",
        F.when(~words, from_cents(F.col("cents"))).alias("amount"),
        F.when(~lost & ~words, from_cents(F.col("balance"))).alias("balance"),
        F.when(~words, F.col("type")).alias("type"),
        F.lit(None).cast("array<double>").alias("alt_amounts"),
        words.alias("desc_only"),
    )
    out = repair.repair(hurt)
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return out.select("doc", "seq", cents("amount"), cents("balance"), "type", "repaired", "inferred")


def repair_cases(spark, sf_dir):
    """Damage of all kinds: lost balances and amounts, a balance read as the amount, and a wrong one of several numbers."""
    rows = ledger_of(spark, sf_dir)
    kind, size = F.col("id") % 7, from_cents(F.abs("cents"))
    amount = F.when(kind == 1, from_cents(F.col("balance"))).when(kind == 6, 9.99).when(kind != 5, from_cents(F.col("cents")))
    balance = F.when(kind == 6, from_cents(F.col("balance") + 12300)).when(~kind.isin(1, 3, 5), from_cents(F.col("balance")))
    hurt = rows.select(
        "doc", "seq", amount.alias("amount"), balance.alias("balance"), F.when(kind != 5, F.col("type")).alias("type"),
        F.when(kind == 6, F.array(F.lit(9.99), size + 50, F.lit(None), size)).alias("alt_amounts"), (kind == 5).alias("desc_only"),
    )
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return repair.repair(hurt).select("doc", "seq", cents("amount"), cents("balance"), "type", "repaired", "inferred")


def reads_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = ledger_of(spark, sf_dir)
    return staged(L.reads(rows), "reads"), L.readers(rows)


def quorum_count(spark, sf_dir):
    reads, readers = reads_of(spark, sf_dir)
    out = vote.quorum_counts(reads, readers)
    return out.select("doc", "key", F.coalesce("agreed", F.lit(0)).cast("bigint").alias("agreed"), F.size("seen_by").cast("bigint").alias("seen_by"))


def row_vote_accepted(spark, sf_dir):
    accepted, _ = vote.vote_rows(*reads_of(spark, sf_dir))
    return accepted.select(
        "doc", "key", F.col("occurrence").cast("bigint").alias("occurrence"), "matched_by", F.size("readers").alias("readers"), "page", "date_iso", "amount", "description"
    )


def row_vote_disputes(spark, sf_dir):
    _, disputes = vote.vote_rows(*reads_of(spark, sf_dir))
    return disputes.groupBy("doc", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def agreement_ratio(spark, sf_dir):
    reads, readers = reads_of(spark, sf_dir)
    accepted, _ = vote.vote_rows(reads, readers)
    return vote.agreement(accepted, reads, readers)


def printed_order(spark, sf_dir):
    reads, readers = reads_of(spark, sf_dir)
    accepted, _ = vote.vote_rows(reads, readers)
    placed = vote.in_printed_order(accepted, reads)
    return placed.select("doc", "key", F.col("occurrence").cast("bigint").alias("occurrence"), F.col("position").cast("bigint").alias("position"))


def scalar_reads_of(spark, sf_dir) -> DataFrame:
    totals = L.ledger_totals(ledger_of(spark, sf_dir))
    return L.scalar_reads(L.table(spark, sf_dir, "customer"), totals)


def scalar_vote(spark, sf_dir):
    """The votes as (doc, field, value, agreed, votes, of, unanimous)."""
    votes = vote.vote_scalars(scalar_reads_of(spark, sf_dir))
    each = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").cast("string").alias("value"), *[F.col(f"{f}.{c}").alias(c) for c in ("agreed", "votes", "of", "unanimous")])
            for f in vote.SCALARS
        ]
    )
    return votes.select("doc", F.explode(each).alias("v")).select(
        "doc", "v.field", "v.value", "v.agreed", F.col("v.votes").cast("bigint").alias("votes"), F.col("v.of").cast("bigint").alias("of"), "v.unanimous"
    )


def field_vote(spark, sf_dir):
    """The same vote on long rows, for one field, with its candidates."""
    entries = scalar_reads_of(spark, sf_dir).select(
        "doc", F.lit("account_number").alias("field"), "reader", "reader_ord", F.col("account_number").alias("value"), account_key(F.col("account_number")).alias("key")
    )
    out = vote.vote_entries(entries, ["doc", "field"])
    return out.select("doc", "field", "value", "agreed", "votes", "of", "unanimous", F.array_join("readers", ",").alias("readers"), F.size("candidates").cast("bigint").alias("candidates"))


def outcome(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    reads, readers = reads_of(spark, sf_dir)
    accepted, disputes = vote.vote_rows(reads, readers)
    scalars = vote.vote_scalars(scalar_reads_of(spark, sf_dir))
    placed = vote.in_printed_order(accepted, reads)
    return result.results(placed, scalars, reads), disputes, scalars


def verdict(spark, sf_dir):
    return outcome(spark, sf_dir)[0]


def dispute_counts(spark, sf_dir):
    _, disputes, scalars = outcome(spark, sf_dir)
    return result.dispute_counts(disputes, scalars)


def result_sentence(spark, sf_dir):
    found, disputes, scalars = outcome(spark, sf_dir)
    pages = L.statement_pages(ledger_of(spark, sf_dir)).groupBy("doc").agg(F.count(F.lit(1)).alias("pages"))
    kinds = disputes.select("doc", "kind").unionByName(result.field_disputes(scalars).select("doc", "kind"))
    return result.sentence(found, kinds, pages)


SCALAR_SQL = f"""
WITH {LEDGER}, {TOTALS}, s AS (
  SELECT doc, k, c_name, c_mktsegment, c_nationkey, n, credits, debits, opening, closing, lpad(CAST(doc AS VARCHAR), 8, '0') AS num
  FROM customer JOIN totals ON doc = c_custkey, generate_series(1, 3) AS r(k)
), e AS (
  SELECT doc, k, unnest([
    {{'field': 'document_type', 'value': 'bank_statement', 'key': 'bank_statement'}},
    {{'field': 'company_name', 'value': 'Acme Bank' || CASE WHEN k = 2 THEN ' PLC.' ELSE ' Plc' END, 'key': 'acme'}},
    {{'field': 'account_name', 'value': CASE k WHEN 1 THEN c_name WHEN 2 THEN upper(c_name) ELSE replace(c_name, '#', ' ') END, 'key': 'name'}},
    {{'field': 'account_number', 'value': CASE WHEN k = 1 THEN '00' || num WHEN k = 2 THEN '00-' || num[1:4] || ' ' || num[5:8] WHEN doc % 7 <> 0 THEN '00.' || num END, 'key': CASE WHEN k < 3 OR doc % 7 <> 0 THEN num END}},
    {{'field': 'account_type', 'value': lower(c_mktsegment), 'key': 't'}},
    {{'field': 'branch', 'value': CASE WHEN k <> 3 THEN 'Branch ' || c_nationkey END, 'key': CASE WHEN k <> 3 THEN 'b' END}},
    {{'field': 'currency', 'value': CASE WHEN k = 2 THEN 'usd' ELSE 'USD' END, 'key': 'USD'}},
    {{'field': 'period_from', 'value': '1992-01-01', 'key': 'f'}},
    {{'field': 'period_to', 'value': '1998-12-31', 'key': 't'}},
    {{'field': 'statement_date', 'value': NULL, 'key': NULL}},
    {{'field': 'opening_cents', 'value': CAST(opening AS VARCHAR), 'key': CAST(opening AS VARCHAR)}},
    {{'field': 'closing_cents', 'value': CAST(closing + CASE WHEN k = 2 AND doc % 9 = 0 THEN 900 ELSE 0 END AS VARCHAR), 'key': CAST(closing + CASE WHEN k = 2 AND doc % 9 = 0 THEN 900 ELSE 0 END AS VARCHAR)}},
    {{'field': 'stated_credits', 'value': CASE WHEN doc % 3 <> 0 THEN CAST(credits AS VARCHAR) END, 'key': CASE WHEN doc % 3 <> 0 THEN 'c' END}},
    {{'field': 'stated_debits', 'value': CASE WHEN doc % 3 <> 0 THEN CAST(debits AS VARCHAR) END, 'key': CASE WHEN doc % 3 <> 0 THEN 'd' END}},
    {{'field': 'stated_count', 'value': CASE WHEN doc % 3 = 1 THEN CAST(n + CASE WHEN doc % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR) END, 'key': CASE WHEN doc % 3 = 1 THEN 'n' END}}
  ]) AS f FROM s
), g AS (
  SELECT doc, f.field AS field, f.key AS key, count(*) AS n, min(k) AS first, arg_min({{'v': f.value}}, k).v AS value FROM e GROUP BY ALL
), b AS (
  SELECT doc, field, CAST(sum(n) AS BIGINT) AS of, count(*) AS groups, max(n) AS votes, arg_min({{'v': value}}, first - 10 * n).v AS value, bool_or(value IS NOT NULL) AS any_value
  FROM g GROUP BY ALL
), scalars AS (
  SELECT doc, field, CASE WHEN votes >= 2 THEN value END AS value, votes >= 2 AND NOT (value IS NULL AND any_value) AS agreed, votes, of, groups = 1 AND of > 1 AS unanimous
  FROM b
)"""

#: Accepted rows in printed order: by page, then as the fullest read has them.
PLACED = """full_read AS (
  SELECT doc, arg_min(reader_ord, reader_ord - 100 * n) AS reader_ord FROM (SELECT doc, reader_ord, count(*) AS n FROM reads GROUP BY ALL) GROUP BY doc
), firsts AS (
  SELECT doc, key, min(idx) AS place FROM keyed JOIN full_read USING (doc, reader_ord) GROUP BY ALL
), placed_rows AS (
  SELECT a.doc, a.k AS key, occ AS occurrence, amount, balance,
    row_number() OVER (PARTITION BY a.doc ORDER BY page, coalesce(place, 2147483647), icu_sort_key(a.k, 'en'), occ) AS position
  FROM accepted a LEFT JOIN firsts f ON f.doc = a.doc AND f.key = a.k
)"""

QUERIES = {
    f.__name__: f
    for f in (
        ledger, ledger_summary, sign_resolution, chain_breaks, chain_walk, one_document_walk, one_document_signs, balance_chain, repair_fold, repair_cases, quorum_count, row_vote_accepted,
        row_vote_disputes, agreement_ratio, printed_order, scalar_vote, field_vote, verdict, dispute_counts, result_sentence,
    )
}

ORACLES = {
    "ledger": f"WITH {LEDGER} SELECT * FROM ledger",
    "ledger_summary": f"WITH {LEDGER}, {TOTALS} SELECT * FROM totals",
    "sign_resolution": f"""WITH {LEDGER} SELECT doc, seq, CASE WHEN seq = 1 THEN -abs(cents) ELSE cents END AS cents,
      CASE WHEN seq = 1 THEN 'debit' ELSE type END AS type FROM ledger""",
    "chain_breaks": f"""WITH {DAMAGED}, p AS (
      SELECT doc, seq, cents, printed, (SELECT arg_max(q.printed, q.seq) FROM damaged q WHERE q.doc = d.doc AND q.seq < d.seq AND q.printed IS NOT NULL AND q.cents IS NOT NULL) AS before
      FROM damaged d WHERE cents IS NOT NULL)
      SELECT doc, count(*) FILTER (before IS NOT NULL AND printed IS NOT NULL AND before + cents <> printed) AS breaks FROM p GROUP BY doc""",
    "chain_walk": f"""WITH {WALK} SELECT doc, seq, expected, expected IS NOT NULL AND printed IS NOT NULL AS checked,
      cents IS NULL AND printed IS NULL AS severed, coalesce(expected <> printed, false) AS broken FROM walk""",
    "one_document_walk": f"""WITH {DAMAGED}, d AS (SELECT doc * 1000000 + seq AS seq, cents, printed, printed IS NOT NULL OR cents IS NULL AS opens FROM damaged),
      s AS (SELECT *, count(*) FILTER (opens) OVER (ORDER BY seq) AS stretch FROM d),
      r AS (SELECT *, first_value(printed) OVER w + sum(CASE WHEN opens THEN 0 ELSE cents END) OVER w AS running FROM s WINDOW w AS (PARTITION BY stretch ORDER BY seq)),
      e AS (SELECT seq, cents, printed, CAST(lag(CASE WHEN stretch > 0 THEN running END) OVER (ORDER BY seq) + cents AS BIGINT) AS expected FROM r)
      SELECT seq, expected, expected IS NOT NULL AND printed IS NOT NULL AS checked, cents IS NULL AND printed IS NULL AS severed, coalesce(expected <> printed, false) AS broken FROM e""",
    "one_document_signs": f"""WITH {LEDGER}, o AS (SELECT doc * 1000000 + seq AS seq, abs(cents) AS size, balance, lag(balance) OVER (ORDER BY doc, seq) AS before FROM ledger)
      SELECT seq, CASE WHEN coalesce(before + size = balance, false) THEN size ELSE -size END AS cents, CASE WHEN coalesce(before + size = balance, false) THEN 'credit' ELSE 'debit' END AS type FROM o""",
    "balance_chain": f"""WITH {WALK}, s AS (
      SELECT doc, count(printed) >= 2 AS enough, count(*) FILTER (expected IS NOT NULL AND printed IS NOT NULL) AS c,
        count(*) FILTER (cents IS NULL AND printed IS NULL) AS v, count(*) FILTER (expected <> printed) AS b FROM walk GROUP BY doc)
      SELECT doc, CASE WHEN enough AND c > 0 THEN b = 0 END AS ok, CASE WHEN enough THEN c ELSE 0 END AS checked,
        CASE WHEN enough THEN v ELSE 0 END AS severed, CASE WHEN enough THEN b ELSE 0 END AS break_count,
        CASE WHEN enough THEN coalesce((SELECT string_agg(seq || ':' || expected || ':' || printed, ' ' ORDER BY seq) FROM
          (SELECT seq, expected, printed FROM walk w WHERE w.doc = s.doc AND expected <> printed ORDER BY seq LIMIT 3)), '') END AS shown FROM s""",
    # both damages are undone where a balance stands before and a whole row after; else a lost balance stays lost
    "repair_fold": f"""WITH {LEDGER.replace("ledger AS (", "RECURSIVE ledger AS (", 1)}, hurt AS (
      SELECT doc, seq, CASE WHEN id % 7 <> 5 THEN cents END AS cents, CASE WHEN id % 7 NOT IN (3, 5) THEN balance END AS balance, type, id % 7 = 5 AS words FROM ledger
    ), n AS (
      SELECT *, lead(cents) OVER w AS nc, lead(balance) OVER w AS nb FROM hurt WINDOW w AS (PARTITION BY doc ORDER BY seq)
    ), fold AS (
      SELECT doc, seq, cents AS amount, balance, type, CAST(NULL AS VARCHAR) AS repaired, false AS inferred, balance AS prev FROM n WHERE seq = 1
      UNION ALL
      SELECT n.doc, n.seq, CASE WHEN gap THEN nb - nc - prev ELSE cents END,
        CASE WHEN gap THEN nb - nc WHEN fill THEN prev + cents ELSE n.balance END,
        CASE WHEN gap THEN CASE WHEN nb - nc - prev >= 0 THEN 'credit' ELSE 'debit' END ELSE n.type END,
        CASE WHEN fill THEN 'balance-filled' END, gap, coalesce(CASE WHEN gap THEN nb - nc WHEN fill THEN prev + cents ELSE n.balance END, prev)
      FROM (
        SELECT n.*, f.prev, coalesce(words AND f.prev IS NOT NULL AND nc IS NOT NULL AND nb IS NOT NULL AND nb - nc <> f.prev, false) AS gap,
          coalesce(NOT words AND n.balance IS NULL AND f.prev + cents + nc = nb, false) AS fill
        FROM fold f JOIN n ON n.doc = f.doc AND n.seq = f.seq + 1
      ) n
    ) SELECT doc, seq, amount, balance, type, repaired, inferred FROM fold WHERE amount IS NOT NULL""",
    "repair_cases": f"""WITH {LEDGER.replace("ledger AS (", "RECURSIVE ledger AS (", 1)}, hurt AS (
      SELECT doc, seq, id % 7 AS kind, cents AS meant, CASE id % 7 WHEN 1 THEN balance WHEN 5 THEN NULL WHEN 6 THEN 999 ELSE cents END AS cents,
        CASE WHEN id % 7 = 6 THEN balance + 12300 WHEN id % 7 NOT IN (1, 3, 5) THEN balance END AS balance, CASE WHEN id % 7 <> 5 THEN type END AS type FROM ledger
    ), n AS (
      SELECT *, lead(cents) OVER w AS nc, lead(balance) OVER w AS nb FROM hurt WINDOW w AS (PARTITION BY doc ORDER BY seq)
    ), fold AS (
      SELECT doc, seq, cents AS amount, balance, type, CAST(NULL AS VARCHAR) AS repaired, false AS inferred, balance AS prev FROM n WHERE seq = 1
      UNION ALL
      SELECT doc, seq, a, b, CASE WHEN how IN ('gap', 'amount-balance-merge', 'multi-amount-disambiguated') THEN CASE WHEN a >= 0 THEN 'credit' ELSE 'debit' END ELSE type END,
        nullif(how, 'gap'), coalesce(how = 'gap', false), coalesce(b, prev)
      FROM (
        SELECT *, CASE how WHEN 'gap' THEN nb - nc - prev WHEN 'amount-balance-merge' THEN abs(cents) - prev WHEN 'multi-amount-disambiguated' THEN meant ELSE cents END AS a,
          CASE how WHEN 'gap' THEN nb - nc WHEN 'balance-filled' THEN prev + cents WHEN 'amount-balance-merge' THEN abs(cents) WHEN 'multi-amount-disambiguated' THEN prev + meant ELSE balance END AS b
        FROM (
          SELECT n.*, f.prev, CASE WHEN f.prev IS NULL OR nc IS NULL OR nb IS NULL THEN NULL
            WHEN kind = 5 THEN CASE WHEN nb - nc <> f.prev THEN 'gap' END
            WHEN n.balance IS NULL AND f.prev + cents + nc = nb THEN 'balance-filled'
            WHEN n.balance IS NULL AND abs(cents) + nc = nb AND abs(cents) <> f.prev THEN 'amount-balance-merge'
            WHEN kind = 6 AND f.prev + meant + nc = nb AND f.prev + cents <> n.balance THEN 'multi-amount-disambiguated' END AS how
          FROM fold f JOIN n ON n.doc = f.doc AND n.seq = f.seq + 1
        )
      )
    ) SELECT doc, seq, amount, balance, type, repaired, inferred FROM fold WHERE amount IS NOT NULL""",
    "quorum_count": f"""WITH {VOTE} SELECT doc, key, agreed, (SELECT count(*) FROM grid g WHERE g.doc = s.doc AND g.key = s.key AND n > 0) AS seen_by FROM strict s""",
    "row_vote_accepted": f"WITH {VOTE} SELECT doc, k AS key, occ AS occurrence, matched_by, readers, page, date_iso, amount, description FROM accepted",
    "row_vote_disputes": f"""WITH {VOTE}, d AS (
      SELECT doc, 'duplicate_row' AS kind, key FROM placed WHERE agreed > 0 AND occ > agreed
      UNION ALL SELECT doc, 'unmatched_row', loose FROM again WHERE agreed = 0
      UNION ALL SELECT doc, 'row_description', k FROM accepted WHERE matched_by <> 'exact' AND NOT agreed
    ) SELECT doc, kind, key, count(*) AS n FROM d GROUP BY ALL""",
    "agreement_ratio": f"""WITH {VOTE}, m AS (SELECT doc, max(n) AS most FROM (SELECT doc, reader, count(*) AS n FROM reads GROUP BY ALL) GROUP BY doc),
      a AS (SELECT doc, count(*) AS accepted FROM accepted GROUP BY doc)
      SELECT doc, coalesce(accepted, 0) AS accepted, most, coalesce(accepted, 0) / greatest(most, coalesce(accepted, 0)) AS ratio FROM m LEFT JOIN a USING (doc)""",
    "printed_order": f"""WITH {VOTE}, {PLACED} SELECT doc, key, occurrence, position FROM placed_rows""",
    "scalar_vote": f"{SCALAR_SQL} SELECT doc, field, value, agreed, votes, of, unanimous FROM scalars",
    "field_vote": f"""{SCALAR_SQL}, t AS (
      SELECT doc, field, key, row_number() OVER (PARTITION BY doc, field ORDER BY n DESC, first) AS r FROM g WHERE field = 'account_number'
    ) SELECT s.doc, s.field, s.value, s.agreed, s.votes, s.of, s.unanimous,
      (SELECT string_agg('r' || k, ',' ORDER BY k) FROM e, t WHERE t.r = 1 AND e.doc = s.doc AND t.doc = s.doc AND e.f.field = s.field AND e.f.key IS NOT DISTINCT FROM t.key) AS readers,
      (SELECT count(*) FROM g WHERE g.doc = s.doc AND g.field = s.field) AS candidates
    FROM scalars s WHERE field = 'account_number'""",
    "verdict": f"""{SCALAR_SQL}, {VOTE.replace(LEDGER + ",", "", 1)}, {PLACED}, wide AS (
      SELECT doc, count(*) FILTER (agreed) AS fields_agreed, count(*) FILTER (unanimous) AS fields_unanimous,
        bool_and(agreed) FILTER (field IN ('account_number', 'period_from', 'period_to', 'opening_cents', 'closing_cents')) AS critical,
        CAST(max(value) FILTER (field = 'opening_cents') AS BIGINT) AS opening, CAST(max(value) FILTER (field = 'closing_cents') AS BIGINT) AS closing,
        max(value) FILTER (field = 'currency') AS currency, CAST(max(value) FILTER (field = 'stated_credits') AS BIGINT) AS sc,
        CAST(max(value) FILTER (field = 'stated_debits') AS BIGINT) AS sd, CAST(max(value) FILTER (field = 'stated_count') AS BIGINT) AS sn
      FROM scalars GROUP BY doc
    ), c AS (
      SELECT *, lag(balance) OVER (PARTITION BY doc ORDER BY position) + amount AS expected FROM placed_rows
    ), t AS (
      SELECT doc, count(*) AS transactions, count(*) FILTER (amount > 0) AS credits_n, count(*) FILTER (amount < 0) AS debits_n,
        CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS total_credits, CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS total_debits,
        CAST(sum(amount) AS BIGINT) AS net, count(expected) AS checked, count(*) FILTER (expected <> balance) AS breaks
      FROM c GROUP BY doc
    ), m AS (
      SELECT doc, max(n) AS most FROM (SELECT doc, reader, count(*) AS n FROM reads GROUP BY ALL) GROUP BY doc
    ), j AS (
      SELECT wide.*, coalesce(transactions, 0) AS transactions, coalesce(credits_n, 0) AS credits_n, coalesce(debits_n, 0) AS debits_n,
        coalesce(total_credits, 0) AS total_credits, coalesce(total_debits, 0) AS total_debits, coalesce(net, 0) AS net,
        coalesce(checked, 0) AS checked, coalesce(breaks, 0) AS breaks, greatest(most, coalesce(transactions, 0)) AS most
      FROM wide JOIN m USING (doc) LEFT JOIN t USING (doc)
    ), k AS (
      SELECT *, opening + net = closing AS closes, transactions / most AS ratio,
        CASE WHEN sc IS NOT NULL OR sd IS NOT NULL OR sn IS NOT NULL
          THEN coalesce(sc = total_credits, true) AND coalesce(sd = total_debits, true) AND coalesce(sn = transactions, true) END AS stated_ok
      FROM j
    )
    SELECT doc, CASE WHEN critical AND ratio >= 0.98 AND closes IS NOT FALSE AND stated_ok IS NOT FALSE THEN 'extracted' ELSE 'needs_review' END AS verdict,
      floor((fields_agreed + transactions) / (15 + most) * 10000 + 0.5) / 10000 AS agreement_score, floor(ratio * 10000 + 0.5) / 10000 AS row_agreement,
      transactions, credits_n, debits_n, total_credits, total_debits, net, opening, closing, currency, closes, stated_ok,
      coalesce(stated_ok, false) AND closes IS NOT FALSE AS provably_complete, CASE WHEN checked > 0 THEN breaks = 0 END AS chain_ok,
      checked AS chain_checked, 0::BIGINT AS chain_severed, breaks AS chain_breaks, fields_unanimous, fields_agreed
    FROM k""",
    "dispute_counts": f"""{SCALAR_SQL}, {VOTE.replace(LEDGER + ",", "", 1)}, d AS (
      SELECT 'duplicate_row' AS kind FROM placed WHERE agreed > 0 AND occ > agreed
      UNION ALL SELECT 'unmatched_row' FROM again WHERE agreed = 0
      UNION ALL SELECT 'row_description' FROM accepted WHERE matched_by <> 'exact' AND NOT agreed
      UNION ALL SELECT 'field' FROM scalars WHERE NOT agreed
    ) SELECT kind, count(*) AS n FROM d GROUP BY kind""",
}
