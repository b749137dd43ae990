"""The stages of the pipeline, each judged on its own input."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import brute_classes, brute_contamination, brute_substrings, documents, edge_rows  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, SF).write.parquet(path)
        results[name] = (before, spark.read.parquet(path))
        before = results[name][1]
        if name != "packing":
            assert before.columns == columns
            assert before.schema["n_chars"].dataType == docs.schema["n_chars"].dataType

    given, kept = results["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {r.doc_id for r in kept.collect()}
    judged = [(r.quality, r.doc_id in ids) for r in labels.collect()]
    assert sum(q == 1 and not k for q, k in judged) <= 0.03 * len(judged)
    assert sum(q == 0 and k for q, k in judged) <= 0.05 * len(judged)

    given, kept = results["minhash_near_dedup"]
    classes = brute_classes([(r.doc_id, r.text) for r in given.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(c) for c in classes)

    given, kept = results["substring_dedup"]
    want = {i: t for i, n, gone, t in brute_substrings([(r.doc_id, r.text) for r in given.collect()]) if gone == 0 or gone < n}
    assert {r.doc_id: " ".join(w.decode() for w in r.text.encode().split()) for r in kept.collect()} == want
    assert kept.where(F.length("text") != F.col("n_chars")).count() == 0

    given, kept = results["benchmark_decontamination"]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in given.collect()], bench) if r[5]}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in given.collect()} - dirty

    given, pieces = results["packing"]
    lengths = collections.Counter()
    tokens = {}
    for p in pieces.collect():
        lengths[p.doc_id] += p.length
        tokens[p.doc_id] = p.doc_tokens
    assert dict(lengths) == tokens and set(tokens) == {r.doc_id for r in given.collect()}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and corpus_pipeline._WRITTEN == []


def test_stages_on_edge_rows(spark, edge_rows, tmp_path):
    docs = documents(spark, edge_rows)
    for rows in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, SF)
            if name != "packing":
                assert out.columns == docs.columns
            path = str(tmp_path / f"{name}-{rows is docs}")
            out.write.parquet(path)
            n = spark.read.parquet(path).count()
            assert n <= 2 * len(edge_rows) + 200 and (rows is docs or n == 0)
