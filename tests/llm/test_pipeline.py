"""The pipeline against its stages by brute force."""

import corpus_pipeline
from quantloom.llm import pieces, private

DATA = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark):
    docs = corpus_pipeline.documents(spark, DATA)
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == columns
        seen[name] = {r.doc_id: r for r in after.collect()}
        assert seen[name].keys() <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(texts[i].split()) >= 10 for i in seen["quality_rules"])
    for i, r in seen["private_data"].items():
        assert not private.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == texts[i] or private.base_spans(texts[i])
    codec = pieces.Codec(pieces.load(pieces.default_model()))
    last = corpus_pipeline.STAGES[4][1](spark, before, DATA).collect()
    assert len(last) == len(seen["source_mixing"]) > 0
    import numpy as np

    for r in last:
        assert codec.decode(np.array(r.ids, dtype="<i4").tobytes()) == seen["source_mixing"][r.doc_id].text and r.n_pieces == len(r.ids)


def test_run_over_odd_tables(spark, tmp_path):
    from tests.llm.test_operators import SCHEMA, odd_rows, words

    schema = SCHEMA.replace(", kept string", "")
    more = [(20, words(80, 30), "en", "s0", 1, "s", "b", "p"), (20, words(80, 30), "en", "s0", 1, "s", "b", "p"), (20, words(80, 31), "en", "s0", 1, "s", "b", "p"), (None, words(80, 30), None, None, None, "s", "b", "p")]
    rows = [(*r[:5], *r[6:]) for r in odd_rows()] + more
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs = corpus_pipeline.documents(spark, str(tmp_path / "odd"))
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sum(r.doc_id == 20 for r in kept) == 2 and not any(r.doc_id is None and r.text == words(80, 30) for r in kept)
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns == ["doc_id", "lang", "source", "n_pieces", "ids"]
    assert all(r.n_pieces == len(r.ids) for r in out.collect())
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
