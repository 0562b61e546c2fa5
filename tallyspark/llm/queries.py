"""Driver queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, kdtree, langid, merkle, mixing, pii, quality, rpforest, sentencepieces, simhash, substrings, tokenalign, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "quality_score", "quality_keep")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids' number and hash, and whether they decode to the text again."""
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check_col="round_trip")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


#: (verdict, domain, start of the path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    proof = merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256")
    return made.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op12_tokenalign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align(table(spark, sf_dir, "documents"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_htmltext": op1_htmltext,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_topk": op5_topk,
    "op6_urls": op6_urls,
    "op7_ann": op7_ann,
    "op8_mixing": op8_mixing,
    "op9_langid": op9_langid,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_tokenalign": op12_tokenalign,
    "op13_substrings": op13_substrings,
}
#: Exact, so any right method gives these rows.
OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
#: The models of op6 are grouped sums, so SQL gives the same verdicts.
OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM h
), u AS (
  SELECT url, any_value(rule) AS rule, count(*) AS n,
    CASE any_value(rule) WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'com/de/' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' END AS by_rule,
    translate(lower(url), '123456789', '000000000') AS folded
  FROM r GROUP BY url
), c AS (
  SELECT url, n, by_rule, i, CASE WHEN i < 1 OR i > length(folded) THEN 0
    ELSE coalesce(nullif(strpos('abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%~+', substr(folded, CAST(i AS INTEGER), 1)), 0), 40) END AS k
  FROM u, generate_series(-1, length(folded) + 1) AS t(i)
), g AS (
  SELECT url, n, by_rule, k AS k3, k2, k1 FROM (
    SELECT *, lag(k, 1) OVER w AS k2, lag(k, 2) OVER w AS k1 FROM c WINDOW w AS (PARTITION BY url ORDER BY i)
  ) WHERE i >= 1
), n3 AS (
  SELECT k1, k2, k3, CAST(sum(CASE WHEN by_rule = 'allow' THEN n ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN by_rule = 'block' THEN n ELSE 0 END) AS DOUBLE) AS b
  FROM g GROUP BY ALL
), n2 AS (SELECT k2, k3, sum(a) AS a, sum(b) AS b FROM n3 GROUP BY ALL
), n1 AS (SELECT k3, sum(a) AS a, sum(b) AS b FROM n3 GROUP BY ALL
), t3 AS (SELECT k1, k2, sum(a) AS a, sum(b) AS b, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM n3 GROUP BY ALL
), t2 AS (SELECT k2, sum(a) AS a, sum(b) AS b, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM n2 GROUP BY ALL
), t1 AS (SELECT sum(a) AS a, sum(b) AS b, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM n1
), q1 AS (
  SELECT k3, CASE WHEN t1.a > 0 THEN (n1.a + ta / 41.0) / (t1.a + ta) ELSE 1 / 41.0 END AS pa,
    CASE WHEN t1.b > 0 THEN (n1.b + tb / 41.0) / (t1.b + tb) ELSE 1 / 41.0 END AS pb
  FROM n1, t1
), q2 AS (
  SELECT k2, k3, CASE WHEN t2.a > 0 THEN (n2.a + ta * pa) / (t2.a + ta) ELSE pa END AS pa,
    CASE WHEN t2.b > 0 THEN (n2.b + tb * pb) / (t2.b + tb) ELSE pb END AS pb
  FROM n2 JOIN t2 USING (k2) JOIN q1 USING (k3)
), q3 AS (
  SELECT k1, k2, k3, CASE WHEN t3.a > 0 THEN (n3.a + ta * pa) / (t3.a + ta) ELSE pa END AS pa,
    CASE WHEN t3.b > 0 THEN (n3.b + tb * pb) / (t3.b + tb) ELSE pb END AS pb
  FROM n3 JOIN t3 USING (k1, k2) JOIN q2 USING (k2, k3)
), s AS (
  SELECT url, avg(ln(pa) - ln(pb)) AS score FROM g JOIN q3 USING (k1, k2, k3) GROUP BY url
), m AS (
  SELECT sum(n) FILTER (by_rule = 'allow') AS na, sum(n) FILTER (by_rule = 'block') AS nb,
    sum(n * score) FILTER (by_rule = 'allow') AS sa, sum(n * score) FILTER (by_rule = 'block') AS sb,
    sum(n * score * score) FILTER (by_rule = 'allow') AS qa, sum(n * score * score) FILTER (by_rule = 'block') AS qb
  FROM s JOIN u USING (url)
), d AS (
  SELECT na, nb, sa / na AS ma, sb / nb AS mb, sqrt(greatest(qa / na - (sa / na) ** 2, 1e-12)) AS da, sqrt(greatest(qb / nb - (sb / nb) ** 2, 1e-12)) AS db
  FROM m
)
SELECT page_id, host, path, r.rule AS rule, coalesce(by_rule, CASE WHEN nb IS NULL THEN 'allow' WHEN na IS NULL THEN 'block'
  WHEN score < (ma * db + mb * da) / (da + db) THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN u USING (url) JOIN s USING (url), d
"""
#: Two trees of hashes, each built upwards and folded by recursion; the CRC-32 is spelt out bit by bit.
OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, text,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS fields,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
      list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
  FROM documents
), l AS (
  SELECT id, doc_id, tree, sha256(fields || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(fields || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-'))
      ELSE sha256(fields || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS found
  FROM d
), n AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM l
), up AS (
  SELECT 0 AS level, tree, place, size, leaf AS node FROM n
  UNION ALL
  SELECT any_value(level) + 1, tree, place // 3, (any_value(size) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM up WHERE size > 1 GROUP BY tree, place // 3
), runs AS (
  SELECT level, tree, place // 3 AS parent, list(node ORDER BY place) AS kids FROM up WHERE size > 1 GROUP BY ALL
), fold AS (
  SELECT 0 AS level, id, tree, place, found AS back, '' AS proof FROM n
  UNION ALL
  SELECT level + 1, id, tree, place // 3, sha256(array_to_string(kids[:place % 3], '') || back || array_to_string(kids[place % 3 + 2:], '')),
    proof || array_to_string(kids[:place % 3], '') || array_to_string(kids[place % 3 + 2:], '')
  FROM fold JOIN runs USING (level, tree) WHERE parent = place // 3
), s AS (
  SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM up WHERE size = 1
), up2 AS (
  SELECT 0 AS level, place, size, subroot AS node FROM s
  UNION ALL
  SELECT any_value(level) + 1, place // 3, (any_value(size) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM up2 WHERE size > 1 GROUP BY place // 3
), runs2 AS (
  SELECT level, place // 3 AS parent, list(node ORDER BY place) AS kids FROM up2 WHERE size > 1 GROUP BY ALL
), last AS (
  SELECT id, tree, back, proof FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1
), fold2 AS (
  SELECT 0 AS level, id, place, back, proof FROM last JOIN s USING (tree)
  UNION ALL
  SELECT level + 1, id, place // 3, sha256(array_to_string(kids[:place % 3], '') || back || array_to_string(kids[place % 3 + 2:], '')),
    proof || array_to_string(kids[:place % 3], '') || array_to_string(kids[place % 3 + 2:], '')
  FROM fold2 JOIN runs2 USING (level) WHERE parent = place // 3
), done AS (
  SELECT id, back, proof FROM fold2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1
), r AS (SELECT node AS root FROM up2 WHERE size = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, back AS folded_root, back = root AS verified
FROM n JOIN done USING (id) JOIN s USING (tree), r
"""
#: Every window spelt out and counted.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)
), again AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN again USING (h)
), each AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM each ANTI JOIN gone USING (r, j) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
ORACLES: dict[str, str] = {"op5_topk": OP5_SQL, "op6_urls": OP6_SQL, "op11_merkle": OP11_SQL, "op13_substrings": OP13_SQL}
