"""The pipeline, stage by stage, against its operators' plain meaning on the smallest tables."""

import re

import corpus_pipeline
from chatstream.llm import pieces
from chatstream.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
NAMES = ["quality classifier", "near-duplicates", "benchmark decontamination", "personal data", "sentencepiece"]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, bench = documents, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        assert docs.columns == documents.columns and {r.doc_id for r in rows} <= before
        if name == "near-duplicates":
            assert len({r.text for r in rows}) == len(rows)
        if name == "benchmark decontamination":
            assert {r.doc_id for r in rows} == before - {d.doc_id for d in documents.collect() if any(f" {words(b)} " in f" {words(d.text)} " for b in bench)}
        if name == "personal data":
            assert {r.doc_id for r in rows} == before and not any(re.search(r"[\w.]@\w+\.\w", r.text) for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = pieces.Pieces(pieces.read_model(tokenizer_path())).library
    for r in last[:40]:
        assert r.n_tokens == len(library.encode(r.text, add_eos=True))
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}


def test_stages_take_empty_and_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a", "en", "s", 1), (2, "", "x", None, 0), (2, "", "x", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= 3
