"""The corpus pipeline: rejected and near-duplicate documents go, personal data is masked, sources are mixed, texts become piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of
``documents``. Stages work on all rows of their own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import mixing, nearcopies, pii, quality, sentencepieces
from tallyspark.llm.shared import forget, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null, empty and blank texts score 0 and go; rows that repeat are judged alike; an
    empty table gives none.
    """
    return quality.classify(docs).filter("quality_keep").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (see :mod:`nearcopies`) one row: that of the smallest id, then of the smallest text hash.

    Null ids come last. Null, empty and blank texts are one group. Rows equal in id and
    text are one; of an id with several texts each text is a row of its own. Texts move
    once, to meet the names of the rows that stay.
    """
    h, own = nearcopies.text_hash(F.col("text")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    labels = nearcopies.components(docs)
    names = docs.select(F.col("doc_id").isNull().alias("bare"), "doc_id", h.alias("h"), own.alias("own"))
    names = names.groupBy("bare", "doc_id", "h", "own").agg(F.count(F.lit(1)).alias("n"))
    first = (
        names.join(labels, "h", "left")
        .groupBy(F.coalesce("label", "h").alias("label"))
        .agg(F.min(F.struct("bare", "doc_id", "h", "own", "n")).alias("first"))
    )
    kept = materialise(first.select("first.h", "first.own", "first.n"), "kept")
    named = docs.select(*COLUMNS, h.alias("h"), own.alias("own"))
    alone, more = (named.join(kept.filter(c).drop("n"), ["h", "own"], "left_semi") for c in ("n = 1", "n > 1"))
    if not kept.filter("n > 1").isEmpty():  # rows equal in id and text, the only ones whose texts are grouped
        alone = alone.union(more.dropDuplicates(["h", "own"]))
    return alone.select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text with marks for personal data and for terms that disclose it, and ``n_chars`` of that text.

    Null texts stay null with ``n_chars`` 0; rows that repeat stay, and count as documents.
    """
    return with_sizes(pii.sanitise(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: not at all, once or twice.

    A null source is a source. Rows with texts without words have size 0 and are taken
    as often as their source's whole repeats. Of rows equal in id, text and source as
    many are taken twice as the cut leaves.
    """
    return mixing.mixed_rows(docs).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it; a null text has null ids, n_tokens null, and round_trip true."""
    encoded = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), check_col="round_trip")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Trained scorers, seeded hashes and Viterbi paths have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
