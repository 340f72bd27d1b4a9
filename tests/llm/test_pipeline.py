from helpers import components, shingles

import corpus_pipeline
from siltbed.llm import language_id, piece_sampling, private_data
from siltbed.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-pipeline")
        steps.append(docs)
    language, near, clean, masked, coded = steps
    assert all(x.columns == cols for x in steps[:4])
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    fine = {r.doc_id for r in language_id.identify(language_id.document_rows(whole)).collect() if r.accepted}
    assert {r.doc_id for r in language.collect()} == fine
    rows = [(r.doc_id, r.text) for r in language.collect()]
    kept = {c if n else i for i, n, c in components(rows, 5, 80)}
    assert {r.doc_id for r in near.collect()} == kept and near.count() == len(kept)
    words = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    items = [shingles(r.text.lower(), 5, words) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in near.collect() if any(100 * len(s & shingles(r.text.lower(), 5, words)) >= 80 * len(s) for s in items)}
    assert held and {r.doc_id for r in clean.collect()} == kept - held
    spans = {r.doc_id: r.spans for r in private_data.find_spans(clean).collect()}
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: private_data.mask(r.text, spans[r.doc_id]) for r in clean.collect()}
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert all(r.text == texts[r.doc_id] for r in piece_sampling.decode(coded).collect())
    assert {r.doc_id for r in coded.collect()} == set(texts)


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0
