"""Extra columns whose names the operators use themselves change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import merkle, mixing, nearcopies, pii, simhash, substrings, tokenalign

NAMES = {
    "op3": "id h k text_key key entity term kind start end spans found n n_e n_t both salt rows pairs own base own_key entities terms spots".split(),
    "op8": "id h k key size source_size target taken n weight cap total cut rest copies order own copy label".split(),
    "op10": "id h fp fingerprint label component_id u v node near was up mask bucket part a b rep n".split(),
    "op11": "tree node found copy part row place size kids at kid proof rest leaf root subroot source_ height left right own first start".split(),
    "op12": "id block pair pairs held ends words sizes links times found best a documents most n_a digests ids".split(),
    "op13": "id k1 k2 own rid n n_words digest anchor high low first windows twice spans g at body asked kept mixed".split(),
    "near": "h fp bands band rep label u v set a b n order own bare first".split(),
}
RUN = {
    "op3": pii.digest,
    "op8": mixing.mix,
    "op10": simhash.near_duplicates,
    "op11": lambda d: merkle.manifest(d).drop("proof"),
    "op12": tokenalign.align,
    "op13": substrings.dedup,
    "near": nearcopies.components,
}


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"w{i % 50}" for i in range(70))
    rows = [(i, f"{passage} {i % 7}" if i % 2 else f"Ann ann{i}@x.org lives {i} +49 170 1234567 {passage}", "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, None, None, None), (None, "", "en", "s1"), (101, passage, "en", None), (102, passage, "en", "s2")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.withColumn("n_chars", F.length("text").cast("long"))


def same(frame):
    return sorted((str(tuple(r[c] for c in sorted(frame.columns))) for r in frame.collect()))


@pytest.mark.parametrize("op", RUN)
def test_same_with_clashing_columns(docs, op):
    extra = {n: F.lit(n) if k % 2 else F.lit(k) for k, n in enumerate(NAMES[op]) if n not in docs.columns}
    assert same(RUN[op](docs.withColumns(extra))) == same(RUN[op](docs))


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_clashing_columns(spark, docs, stage):
    function = corpus_pipeline.STAGES[stage][1]
    extra = {n: F.lit(k) for k, n in enumerate({n for own in NAMES.values() for n in own} | {"quality_keep", "quality_score", "round_trip", "n_tokens"}) if n not in docs.columns}
    assert same(function(spark, docs.withColumns(extra), "")) == same(function(spark, docs, ""))
