"""The stages one after another, each held against a plain version on its own input."""

import importlib

import pytest

import corpus_pipeline
from pagewright.llm import decontaminate, packing, pii, quality, tokens
from test_jaccard import plain_kept

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    forest = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    scores = {r.doc_id: r.score for r in quality.score(docs, forest).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= quality.THRESHOLD}

    single = corpus_pipeline.near_duplicate_stage(spark, good, SF).cache()
    assert {r.doc_id for r in single.collect()} == plain_kept([(r.doc_id, r.text) for r in good.collect()])

    clean = corpus_pipeline.decontamination_stage(spark, single, SF).cache()
    leaking = {r.doc_id for r in decontaminate.find_leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaking

    private = corpus_pipeline.pii_stage(spark, clean, SF)
    assert private.count() == clean.count() and all(x.columns == columns for x in (good, single, clean, private))
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (clean, pii.pseudonymise(clean)))
    assert any(before[d] != after[d] for d in before)

    coder = tokens.Encoder(tokens.vocabulary_path())
    packed = packing.pack(private).collect()
    assert sum(r.length for r in packed) == sum(len(coder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in after.values())


def test_run_goes_through_all_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_chat_rejects_a_broken_output():
    from pagewright.llm import chat

    with pytest.raises(ValueError):
        list(chat.parse_chunk("### User: no end"))
