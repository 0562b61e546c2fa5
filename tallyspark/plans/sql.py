"""Common table expressions that the oracles share; each rebuilds a derived relation from the driver's tables."""

LEDGER = """
ledger AS (
  SELECT doc, CAST(row_number() OVER w AS BIGINT) AS seq, id, day, cents, type, CAST(sum(cents) OVER w AS BIGINT) AS balance
  FROM (
    SELECT o_custkey AS doc, o_orderkey AS id, o_orderdate AS d, strftime(o_orderdate, '%Y-%m-%d') AS day,
      CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents,
      CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS type
    FROM orders
  ) WINDOW w AS (PARTITION BY doc ORDER BY d, id)
)"""
DAMAGED = (
    LEDGER
    + """, damaged AS (
  SELECT doc, seq, id, day, CASE WHEN id % 23 <> 0 THEN cents END AS cents,
    CASE WHEN id % 7 <> 0 THEN balance + CASE WHEN id % 31 = 0 THEN 100 ELSE 0 END END AS printed
  FROM ledger
)"""
)
#: The balance walk row by row, as a loop would do it.
WALK = (
    DAMAGED.replace("ledger AS (", "RECURSIVE ledger AS (", 1)
    + """, walk AS (
  SELECT doc, seq, cents, printed, CAST(NULL AS BIGINT) AS expected, printed AS running FROM damaged WHERE seq = 1
  UNION ALL
  SELECT d.doc, d.seq, d.cents, d.printed, w.running + d.cents,
    CASE WHEN d.printed IS NOT NULL THEN d.printed WHEN d.cents IS NULL THEN NULL ELSE w.running + d.cents END
  FROM walk w JOIN damaged d ON d.doc = w.doc AND d.seq = w.seq + 1
)"""
)
READS = (
    LEDGER
    + """, reads AS (
  SELECT doc, 'r' || k AS reader, k AS reader_ord, seq * 2 + c - 1 AS idx, CAST((seq - 1) // 25 + 1 AS INTEGER) AS page,
    strftime(CAST(day AS DATE), '%m/%d/%Y') AS date_raw, day AS date_iso,
    CASE WHEN k = 3 AND id % 5 = 0 THEN '0RDER ref. ' || id ELSE 'ORDER REF ' || id END AS description,
    cents + CASE WHEN k = 3 AND id % 13 = 0 THEN 1000 ELSE 0 END AS amount, balance
  FROM ledger, generate_series(1, 3) AS r(k), generate_series(1, 2) AS s(c)
  WHERE NOT (k = 2 AND id % 11 = 0) AND (c = 1 OR (k = 3 AND id % 17 = 0))
), keyed AS (
  SELECT *, date_iso || '|' || amount || '|' || substr(trim(regexp_replace(upper(description), '[^A-Z0-9]+', ' ', 'g')), 1, 24) AS key,
    date_iso || '|' || amount AS loose
  FROM reads
)"""
)
#: The row vote: counts of all three readers, zeros included, then the smallest count that two of them share.
VOTE = (
    READS
    + """, grid AS (
  SELECT d.doc, d.key, r.k, count(x.idx) AS n
  FROM (SELECT DISTINCT doc, key FROM keyed) d CROSS JOIN generate_series(1, 3) AS r(k)
  LEFT JOIN keyed x ON x.doc = d.doc AND x.key = d.key AND x.reader_ord = r.k GROUP BY ALL
), strict AS (
  SELECT doc, key, coalesce((SELECT min(n) FROM (SELECT n FROM grid h WHERE h.doc = g.doc AND h.key = g.key GROUP BY n HAVING count(*) >= 2)), 0) AS agreed
  FROM (SELECT DISTINCT doc, key FROM grid) g
), placed AS (
  SELECT x.*, s.agreed, row_number() OVER (PARTITION BY x.doc, x.key, reader_ord ORDER BY idx) AS occ,
    min(reader_ord * 1000000 + idx) OVER (PARTITION BY x.doc, x.key) AS first
  FROM keyed x JOIN strict s ON s.doc = x.doc AND s.key = x.key
), rest AS (SELECT * FROM placed WHERE agreed = 0
), grid2 AS (
  SELECT d.doc, d.loose, r.k, count(x.idx) AS n
  FROM (SELECT DISTINCT doc, loose FROM rest) d CROSS JOIN generate_series(1, 3) AS r(k)
  LEFT JOIN rest x ON x.doc = d.doc AND x.loose = d.loose AND x.reader_ord = r.k GROUP BY ALL
), loosely AS (
  SELECT doc, loose, min(n) AS agreed FROM (SELECT doc, loose, n FROM grid2 GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL
), again AS (
  SELECT r.* EXCLUDE (agreed, occ), coalesce(l.agreed, 0) AS agreed,
    row_number() OVER (PARTITION BY r.doc, r.loose, reader_ord ORDER BY first, idx) AS occ
  FROM rest r LEFT JOIN loosely l ON l.doc = r.doc AND l.loose = r.loose
), taken AS (
  SELECT doc, key AS k, occ, 'exact' AS matched_by, reader, reader_ord, page, date_iso, date_raw, description, amount, balance FROM placed WHERE occ <= agreed
  UNION ALL
  SELECT doc, loose, occ, 'amount+date', reader, reader_ord, page, date_iso, date_raw, description, amount, balance FROM again WHERE occ <= agreed
), said AS (
  SELECT doc, k, occ, matched_by, trim(regexp_replace(upper(description), '[^A-Z0-9]+', ' ', 'g')) AS d, count(*) AS n, min(reader_ord) AS f, arg_min(description, reader_ord) AS description
  FROM taken GROUP BY ALL
), won AS (
  SELECT doc, k, occ, matched_by, arg_min(description, f - 10 * n) AS description, max(n) AS most, CAST(sum(n) AS BIGINT) AS all_n FROM said GROUP BY ALL
), money AS (
  SELECT doc, k, occ, matched_by, min(page) AS page, min(date_iso) AS date_iso, min(amount) AS amount, min(balance) AS balance, CAST(count(*) AS INTEGER) AS readers
  FROM taken GROUP BY ALL
), accepted AS (
  SELECT m.*, CASE WHEN most >= least(2, all_n) THEN description END AS description, most >= least(2, all_n) AS agreed
  FROM money m JOIN won USING (doc, k, occ, matched_by)
)"""
)
TOTALS = """
totals AS (
  SELECT doc, count(*) AS n, CAST(sum(CASE WHEN cents > 0 THEN cents ELSE 0 END) AS BIGINT) AS credits,
    CAST(sum(CASE WHEN cents < 0 THEN -cents ELSE 0 END) AS BIGINT) AS debits,
    arg_min(balance - cents, seq) AS opening, arg_max(balance, seq) AS closing
  FROM ledger GROUP BY doc
)"""
EVENTS = """
log AS (
  SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS type, ts AS sent_at, value, event_id FROM events
), sent AS (
  SELECT job, seq, type, sent_at, value FROM log UNION ALL SELECT job, seq, type, sent_at, value FROM log WHERE event_id % 10 = 0
)"""
