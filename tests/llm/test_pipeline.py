from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from evalstrata.llm import frames
from evalstrata.llm.registry import MODEL_FILE

from . import cases


def docs_of(spark):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in cases.documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.skipif(not Path(MODEL_FILE).exists(), reason="no public vocabulary here")
@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_stages_keep_what_brute_force_keeps(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", broadcast)
    docs, rows = docs_of(spark), cases.documents()
    items = [(1, rows[11][1]), (2, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    gone = {i for i, _, c in cases.linked(rows) if i is not None and c != i}
    assert near.columns == list(corpus_pipeline.COLUMNS)
    assert cases.ordered((r.doc_id, r.text) for r in near.collect()) == cases.ordered(x for x in rows if x[0] not in gone)
    clean = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    hit = {i for i, t in rows if cases.hits(t, items)[1]}
    assert hit and cases.ordered((r.doc_id, r.text) for r in clean.collect()) == cases.ordered(x for x in rows if x[0] not in hit)
    assert corpus_pipeline.personal_data(spark, docs, "").count() == corpus_pipeline.tokens(spark, docs, "").count() == len(rows)


@pytest.mark.skipif(not Path(MODEL_FILE).exists(), reason="no public vocabulary here")
@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_benchmark_stage_drops_contaminated_rows_only(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", broadcast)
    rows = [(None, "it quotes needle here"), (None, "clean"), (None, None), (1, "needle"), (1, "clean too"), (1, "clean too"), (2, "also clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "needle")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    assert cases.ordered((r.doc_id, r.text) for r in clean.collect()) == cases.ordered(x for x in rows if "needle" not in (x[1] or ""))


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"]
