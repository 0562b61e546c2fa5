"""Personal data: pattern spans, and terms that disclose them by information-theoretic sanitisation.

A protected entity is one value of a pattern kind. For a term in documents that
hold it, the corpus gives the pointwise mutual information of term and entity;
divided by the entity's own information it says how much of the entity the term
gives away.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, of_text, slices

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
NAMES = (*KINDS, "term")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
#: What a disclosing term is generalised to if it is written as a name.
NAME = "[NAME]"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")

#: Bits of a set of candidates that every task gets: 512 KB whatever the corpus.
BITS = 1 << 22
#: Distinct terms or pairs that a task counts before it passes the counts on.
FLUSH = 500_000


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all kinds, sorted. Each kind is matched leftmost and apart from the others."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 40 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]+", "", text)


def entity_of(text: str, span: tuple[int, int, int]) -> int:
    """The entity that a span mentions, as a 64-bit hash."""
    start, kind, end = span
    value = text[start:end].lower() if kind < 2 else digits_of(text[start:end])
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) - (1 << 63)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """All terms (word, start, end) of a text that touch no span."""
    at, last = 0, 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            last = max(last, spans[at][2])
            at += 1
        if a >= last:
            yield m[0].lower(), a, b


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
SPOT = pa.struct([("entity", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
FOUND = "spans array<struct<start:int,kind:int,end:int>>, entities array<bigint>"
SPOTS = "tkey long, spots array<struct<entity:bigint,term:string,start:int,end:int>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        spans, entities = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            own = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            entities.append(list(dict.fromkeys(entity_of(text, x) for x in own)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tkey"), pa.array(spans, pa.list_(SPAN)), pa.array(entities, pa.list_(pa.int64()))],
            names=["id", "tkey", "spans", "entities"],
        )


def text_key(text):
    """What stands for a text where rows of the same text shall meet; spans depend on the text alone."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def spread_key(may_match):
    """Zero for rows that may have a partner in a join by text, else one of many numbers, so that texts that repeat and have none do not meet."""
    return F.when(may_match, F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 14))).cast("int")


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kept = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    kind = dict(kept.dtypes)["id"]
    return kept.mapInArrow(_find, f"id {kind}, tkey long, {FOUND}")


def bit_set(rows: DataFrame, bit):
    """The broadcast set of the values of ``bit``, below BITS, of all rows; its size is fixed."""
    parts = (
        rows.groupBy(F.shiftright(bit, 15).alias("part"))
        .agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
        .collect()
    )
    size = (1 << 15) // 8
    bits = bytearray(BITS // 8)
    for r in parts:
        bits[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return rows.sparkSession.sparkContext.broadcast(bytes(bits))


def pair_counts(docs: DataFrame, text_col: str, entities: DataFrame) -> DataFrame:
    """``(entity, term, both)``: in how many whole documents a term stands with each of ``entities``; pairs of others may come along."""
    shared = bit_set(entities, F.col("entity").bitwiseAND(F.lit(BITS - 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, counts = shared.value, Counter()

        def out() -> pa.RecordBatch:
            e, t = zip(*counts, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(e, pa.int64()), pa.array(t, pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["entity", "term", "both"],
            )

        for batch in slices(batches, text_col):
            for text in batch.column(0):
                text = text.as_py() or ""
                spans = base_spans(text)
                own = {e for x in spans if have[((e := entity_of(text, x)) & (BITS - 1)) >> 3] >> (e & 7) & 1}
                terms = {w for w, _, _ in terms_of(text, spans)} if own else ()
                for e in own:
                    counts.update((e, w) for w in terms)
                    if len(counts) >= FLUSH:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    found = docs.select(text_col).mapInArrow(count, "entity long, term string, both long")
    return found.groupBy("entity", "term").agg(F.sum("both").alias("both"))


def term_spots(docs: DataFrame, text_col: str, flagged: DataFrame) -> DataFrame:
    """``(tkey, spots)``: every occurrence of a flagged term in the texts that hold its entity; other spots may come along."""
    pair = F.concat_ws(":", F.col("entity").cast("string"), "term")
    shared = bit_set(flagged, F.crc32(pair).bitwiseAND(F.lit(BITS - 1)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        have = shared.value

        def wanted(entity: int, word: str) -> bool:
            at = crc32(f"{entity}:{word}".encode("utf-8", "surrogatepass")) & (BITS - 1)
            return bool(have[at >> 3] >> (at & 7) & 1)

        for batch in slices(batches, "text"):
            keys, spots = [], []
            for key, text in zip(batch.column("tkey"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                spans = base_spans(text)
                if not spans:
                    continue
                own, where = {entity_of(text, x) for x in spans}, {}
                for w, a, b in terms_of(text, spans):
                    where.setdefault(w, []).append((a, b))
                hits = [
                    {"entity": e, "term": w, "start": a, "end": b} for w, at in where.items() for e in own if wanted(e, w) for a, b in at
                ]
                if hits:
                    keys.append(key.as_py())
                    spots.append(hits)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spots, pa.list_(SPOT))], names=["tkey", "spots"])

    return docs.select(text_key(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text")).mapInArrow(look, SPOTS)


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(term, n)``: in how many documents each term stands. Tasks pass on sums, at most FLUSH terms at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
            )

        for batch in slices(batches, text_col):
            for text in batch.column(0):
                counts.update(set(WORD.findall((text.as_py() or "").lower())))
            if len(counts) >= FLUSH:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_spans(
    docs: DataFrame, found: DataFrame, text_col: str, disclosure: float, min_documents: int
) -> DataFrame:
    """``(tkey, terms array<struct<start, kind, end>>)`` of the texts that hold disclosing terms.

    A term discloses an entity if they stand together in at least
    ``min_documents`` documents and their mutual information
    log(N n(t,e) / (n(t) n(e))) is at least ``disclosure`` times the entity's
    information log(N / n(e)). N and all n count whole documents, over the whole
    table, and every occurrence in a text that holds the entity is a span.
    An entity that stands everywhere has no information to give away.
    """
    rows = found.count()
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    entities = materialise(entities.filter(F.col("n_entity") >= min_documents), "entities")  # no other has such a term
    pairs = materialise(pair_counts(docs, text_col, entities).filter(F.col("both") >= min_documents), "term-pairs")
    terms = term_counts(docs, text_col).withColumnRenamed("n", "n_term")
    whole = F.lit(float(rows))
    told = F.log(whole * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    own = F.log(whole / F.col("n_entity"))
    flagged = materialise(
        pairs.join(terms, "term").join(entities, "entity").filter((own > 0) & (told >= disclosure * own)).select("entity", "term"),
        "disclosing",
    )
    texts = term_spots(docs, text_col, flagged).groupBy("tkey").agg(F.first("spots").alias("spots"))
    spots = texts.select("tkey", F.explode("spots").alias("c")).select("tkey", "c.*")
    span = F.struct("start", F.lit(TERM).alias("kind"), "end")
    return materialise(
        spots.join(flagged, ["entity", "term"]).groupBy("tkey").agg(F.array_sort(F.collect_set(span)).alias("terms")),
        "disclosing-spans",
    )


def detect(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.8, min_documents: int = 2
) -> DataFrame:
    """``(id_col, spans)`` for every row: structs (start, kind, end) by start, then kind, in code points.

    Kinds 0 to 3 are the patterns, 4 the disclosing terms. Null and empty texts
    have no spans. Rows that repeat stay, and count as documents. Other columns are
    ignored.
    """
    found = materialise(find(docs, id_col, text_col), "pii")
    terms = disclosing_spans(docs, found, text_col, disclosure, min_documents)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    both = found.withColumn("salt", spread_key(F.size("entities") > 0)).join(terms.withColumn("salt", F.lit(0)), ["tkey", "salt"], "left")
    return both.select(
        F.col("id").alias(id_col),
        "spans",
        F.array_sort(F.concat("spans", F.coalesce("terms", none))).alias("all_spans"),
    )


def span_text(spans: str):
    kind = F.array(*map(F.lit, NAMES))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row of ``docs``."""
    found = detect(docs, id_col, text_col, **options)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        id_col, *counts, F.sha2(span_text("spans").cast("binary"), 256).alias("base_sha256"), span_text("all_spans").alias("spans")
    )


def clean(text: str | None, terms) -> str | None:
    """``text`` with pattern spans replaced by their kind's mark; overlapping spans are one.

    Disclosing terms are generalised to what kind of word they are: [NAME] with a capital, else [TERM].
    """
    if not text:
        return text
    spans = base_spans(text)
    spans = sorted(spans + [(t["start"], TERM, t["end"]) for t in terms]) if terms is not None else spans
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], NAME if kind == TERM and text[start].isupper() else MARKS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.8, min_documents: int = 2
) -> DataFrame:
    """``docs`` with its own columns and rows, ``text_col`` cleaned; see :func:`clean` and :func:`detect`."""
    found = materialise(find(docs, id_col, text_col), "pii")
    terms = disclosing_spans(docs, found, text_col, disclosure, min_documents)

    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    # every entity has an @ or a digit
    salt = spread_key(F.coalesce(docs[text_col].rlike("[@0-9]"), F.lit(False))).alias("salt")
    both = docs.select(row, text_key(docs[text_col]).alias("tkey"), salt).join(terms.withColumn("salt", F.lit(0)), ["tkey", "salt"], "left")
    columns = [
        of_text("string", pa.string(), clean, F.col(f"row.{c}"), F.col("terms")).alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns
    ]
    return both.select(*columns)
