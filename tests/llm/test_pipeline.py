"""The pipeline against a brute-force version of its stages, on given and awkward tables."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tamarack.llm import exact_dedup, quality, shingle_join
from tests.llm.frames import write_documents
from tests.llm.test_jvm_operators import size_of, water_levels
from tests.llm.test_shingle_join import brute

SPACE = re.compile("[\x20\x09-\x0d]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_stages(spark, tmp_path, which):
    folder = "/root/testdata/sf0.001"
    if which == "awkward":
        folder = write_documents(tmp_path)
        spark.createDataFrame([(1, 1), (9, 1), (7, 1), (12, 0), (4, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs.createOrReplaceTempView("input")
        found = stage(spark, docs, folder)
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        found.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = docs
        if name != "best-fit packing":
            assert docs.columns == columns, name
        if name == "quality classifier":
            model = quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
            want = Counter(r["doc_id"] for r in rows_of(before) if model.scores([(r["text"] or "").encode()])[0] >= quality.THRESHOLD)
            assert Counter(r["doc_id"] for r in rows_of(docs)) == want
        if name == "exact dedup":
            groups = defaultdict(list)
            for r in rows_of(before):
                text = r["text"] or ""
                groups[SPACE.sub("", text)].append((-len(text), r["doc_id"] is None, r["doc_id"] or 0))
            assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in rows_of(docs)) == Counter(min(g)[1:] for g in groups.values())
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in rows_of(before)]
            want = {c for _, n, c in brute(rows) if n} | {d for (d, _), (_, n, _) in zip(rows, brute(rows), strict=True) if not n}
            assert {r["doc_id"] for r in rows_of(docs)} == want and docs.count() == len(want)
        if name == "mixing sources to target weights":
            sizes, taken = Counter(), Counter()
            for r in rows_of(before):
                sizes[r["source"]] += size_of(r["text"])
            for r in rows_of(docs):
                taken[r["source"]] += size_of(r["text"])
            most = max(size_of(r["text"]) for r in rows_of(before))
            for source, target in water_levels(dict(sizes)).items():
                assert abs(taken[source] - target) <= max(0.1 * target, most)
            assert max(Counter((r["doc_id"], r["text"]) for r in rows_of(docs)).values(), default=0) <= 2
        if name == "best-fit packing":
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            tokenizer.encode_special_tokens = True
            tokens = Counter()
            for r in rows_of(before):
                tokens[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
            got, sequences = Counter(), Counter()
            for r in rows_of(docs):
                got[r["doc_id"]] += r["length"]
                sequences[r["sequence_id"]] += r["length"]
            assert got == tokens and max(sequences.values()) <= 2048
            assert len(sequences) <= np.ceil(sum(tokens.values()) / 2048) + 3


def test_run_is_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"
    ]
    found = __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    assert found.count() > 0


def test_empty_tables(spark, tmp_path):
    folder = write_documents(tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_the_classifier_learns_in_a_task(spark, tmp_path, monkeypatch):
    """The driver gets the model, not the features of the sample."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    whole = quality.fit(docs, labels)
    assert whole.weights.shape == (1 << quality.BITS,) and whole.weights.any()
    monkeypatch.setattr(quality, "train", lambda documents: quality.Model(np.arange(4.0), float(os.getpid())))
    model = quality.fit(docs, labels)
    assert model.weights.tolist() == [0, 1, 2, 3] and model.bias != os.getpid()


def test_the_driver_plans_shared_steps_once(spark, monkeypatch):
    """What two queries of a stage read is stored: neither plan holds its membership bits or its join of components again."""
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, None)], "doc_id long, text string")
    plans = {}

    def spy(kept):
        def stored(df, purpose):
            plans[purpose] = df._jdf.queryExecution().optimizedPlan().toString()
            return kept(df, purpose)

        return stored

    for module in (exact_dedup, shingle_join):
        monkeypatch.setattr(module, "stored", spy(module.stored))
    unique = exact_dedup.exact_unique(docs)
    assert "bit_or" not in plans["dedup-rows"] and "bit_or" not in unique._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["doc_id"] for r in unique.collect()) == [1, 3, 4]
    assert sorted(r["doc_id"] for r in shingle_join.one_per_component(docs).collect()) == [1, 2, 3, 4]
    assert "Join" not in plans["shingle-kept"]
