from collections import Counter

import corpus_pipeline
from tallyspark.llm import mixing, pii, quality
from tallyspark.llm.shared import materialise
from test_nearcopies import groups


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}

    good = materialise(corpus_pipeline.keep_good(spark, docs, sf_dir), "t")
    scorer = quality.train(docs, "doc_id", "text")
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {i for i, r in before.items() if scorer.score(r.text) >= 0.5}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert len(clean & {r.doc_id for r in good.collect()}) >= 0.97 * len(clean)

    one = materialise(corpus_pipeline.keep_one_of_each_group(spark, good, sf_dir), "t")
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in one.collect()} == {rows[g].doc_id for g in groups([r.text for r in rows])}

    masked = materialise(corpus_pipeline.mask_personal_data(spark, one, sf_dir), "t")
    assert masked.columns == columns and masked.count() == one.count()
    for r in masked.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text

    mixed = materialise(corpus_pipeline.mix_sources(spark, masked, sf_dir), "t")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns
    assert all(copies[r.doc_id] * r.size == r.taken for r in mixing.mix(masked).collect())

    last = corpus_pipeline.to_pieces(spark, mixed, sf_dir).collect()
    assert len(last) == mixed.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_run_equals_the_stages_and_survives_odd_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "Some plain words, and a few more of them.", "en", "a", 41)]
    rows += [(3, "Some plain words, and a few more of them.", "en", "a", 41), (None, "Other plain words are in here.", "en", None, 30)]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} == {3, None} and all(r.round_trip for r in got)
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
