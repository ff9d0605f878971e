"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, per operator."""

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlens.llm import (
    decontamination,
    jaccard,
    licenses,
    line_dedup,
    mixing,
    pii,
    secret_scan,
    tokenids,
    topk,
    toxicity,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "TEXT string, doc_id long, text string, lang string, source string, n_chars long, score int, _0 int, copies int"
LONG = "gnu general public license " * 3000


def row(doc_id, text, source="s"):
    return ("x", doc_id, text, "en", source, None, 1, 2, 3)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "one two three four five six"),
        row(4, "one two three four five six"), row(5, "one two three four five six", None),
        row(None, "a b"), row(6, LONG), row(7, "é ß ñ 日本 \U0001f600 ok", "t"), row(4, "other words here"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, None), (7, 0, 0), (6, 1, 1), (99, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(0, None), (1, ""), (2, "one two"), (3, "one two three four five six"), (3, "gnu general public license " * 4)],
        "item_id long, text string",
    )


SCANS = {
    "licenses": licenses.scan,
    "pii": pii.scan,
    "secrets": secret_scan.scan,
    "mixture": mixing.mixture,
    "components": jaccard.components,
    "tokens": lambda d: tokenids.read(tokenids.write(d, TOKENIZER)),
}


@pytest.mark.parametrize("name", SCANS)
def test_one_row_per_document(odd, none, name):
    result = SCANS[name](odd)
    rows = result.collect()
    assert len(rows) == 10
    assert sum(r.doc_id is None for r in rows) == 1
    assert sum(r.doc_id == 4 for r in rows) == 3
    empty = SCANS[name](none)
    assert empty.columns == result.columns and empty.count() == 0


def test_toxicity(odd, none, labels):
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, labels).count() == 0
    nothing = labels.where("false")
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}
    assert toxicity.accepted(odd, nothing).columns == odd.columns
    assert toxicity.accepted(odd, nothing).count() == 10


def test_decontamination(odd, none, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(odd, benchmark).collect()}
    assert found == {(4, 3), (5, 3), (6, 3)}
    kept = decontamination.clean(odd, benchmark)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7]
    assert decontamination.overlaps(none, benchmark).count() == 0
    assert decontamination.overlaps(odd, benchmark.where("false")).count() == 0


def test_line_dedup(odd, none):
    kept = line_dedup.deduplicated(odd, 4)
    assert kept.columns == odd.columns and kept.count() == 10
    # The first of three equal texts (the smallest id, then row) stays.
    texts = [r.text for r in kept.where("doc_id in (4, 5)").collect()]
    assert sorted(texts) == ["", "", "one two three four five six", "other words here"]
    assert line_dedup.deletions(none).count() == 0


def test_near_duplicates_keep_one(odd):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4, 4, 6, 7]
    assert sum(r.text == "one two three four five six" for r in rows) == 1


def test_mix_repeats_rows(odd):
    taken = {}
    for r in mixing.mixture(odd).collect():
        key = (r.doc_id, r.size)
        taken[key] = taken.get(key, 0) + r.copies
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    counts = mixed.groupBy("doc_id").count().collect()
    for r in counts:
        assert r["count"] == sum(n for (doc, _), n in taken.items() if doc == r.doc_id)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, None], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1),
        (5, [1.0, 0.5], 1), (6, [1.0, 0.5], 1), (7, [1.0], 1), (8, [-1e300, 1e300], 1), (None, [1.0, 1.0], 1),
        (5, [1.0, 0.5], 1), (9, [], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, VEC_ID2 int")
    found = topk.top_k(vectors, F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(5, 1310720), (5, 1310720), (6, 1310720)]
    worst = topk.top_k(vectors, F.col("vec_id") == 0, 9).orderBy("rank").collect()
    assert [r.vec_id for r in worst] == [5, 5, 6, 8] and worst[-1].score == -(2**63)
    assert topk.top_k(vectors.where("false"), F.col("vec_id") == 0).count() == 0


def test_pipeline_leaves_only_its_result(spark, tmp_path):
    from orderlens.operators import settle

    folder = settle.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = {name for name in set(os.listdir(folder)) - before if os.listdir(f"{folder}/{name}")}
    assert len([name for name in new if name.startswith("staged-")]) == 1
    assert result.count() > 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for place, (_, function) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(function(spark, docs, folder))
        assert docs.columns == names or place == 4
        assert docs.count() > 0
    spans = sorted((r.start, r.n_tokens) for r in docs.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
