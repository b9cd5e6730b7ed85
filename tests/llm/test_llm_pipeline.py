"""The stages one after another, on documents that planted cases run through."""

import random

import corpus_pipeline
import pytest
from test_llm_operators import LONG, SF, docs  # noqa: F401

from labelproof.llm.common import stored


def test_stages_on_odd_documents(spark, docs):  # noqa: F811
    """Nulls, repeats, long texts and clashing names pass all stages; each but the last returns the columns of its input."""
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, rows, SF), name)
        assert out.columns == docs.columns, name
        rows = out
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert last.count() == rows.count() and last.where("doc_id = 7").first()["n_ids"] > 0
    text = rows.where("doc_id = 7").first()["text"]
    assert "<EMAIL>" in text and "@" not in text and rows.where("doc_id = 7").first()["n_chars"] == len(text)
    assert rows.where(f"doc_id = {2**40}").first()["n_chars"] == len(LONG)


def test_empty_documents(spark, docs):  # noqa: F811
    rows = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        assert out.count() == 0
        rows = out if out.columns == docs.columns else rows


def test_benchmark_passages_are_cut(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()
    rng = random.Random(2)
    filler = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30))
    rows = [(k, f"{filler} {i['text']} {filler}", "en", "s", 1) for k, i in enumerate(items)] + [(9, filler, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_benchmark(spark, df, SF).collect()}
    assert got[9] == filler
    for k, item in enumerate(items):
        words = item["text"].split()
        assert " ".join(words[:8]) not in got[k] and got[k].startswith(filler)


@pytest.mark.parametrize("name", ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"])
def test_stage_names(name):
    assert name in dict(corpus_pipeline.STAGES)
