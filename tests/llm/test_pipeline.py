"""The pipeline's stages, each against what its operator's brute force says, on a small corpus with planted cases."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronoweave.llm import quality_divergence, secret_scan
from tests.llm.conftest import DOCS
from tests.llm.test_quality import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    path = tmp_path_factory.mktemp("sf")
    item = prose(r, "en", 30)
    texts = [prose(r, "en", 200) for _ in range(20)]
    near = texts[0].split()
    near[5] = "changed"
    rows = [(i, t) for i, t in enumerate(texts)] + [(30, texts[3]), (31, " ".join(near)), (32, f"{prose(r, 'en', 60)} {item} {prose(r, 'en', 60)}"), (33, f"{prose(r, 'en', 100)} token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" {prose(r, 'en', 40)}"), (34, "too short"), (35, None), (36, "#$% & | * " * 100)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        ids[name] = {r.doc_id for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == columns
        if name == "secret scan":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert "[assign]" in texts[33] and secret_scan.find(texts[33]) == []
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    clean = set(range(20))
    assert ids["quality rules"] == clean | {30, 31, 32, 33}
    assert ids["near duplicates"] == clean | {32, 33}
    assert ids["decontamination"] == ids["secret scan"] == ids["encoding"] == ids["near duplicates"] - {32}


def test_run(spark, folder):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got[4].n_tokens == len(library.encode(docs[4].text, add_special_tokens=False).ids)
    assert {4, 33} <= set(got) and not {30, 31, 32, 34, 35, 36} & set(got)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert quality_divergence.COUNTS
