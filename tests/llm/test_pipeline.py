"""The pipeline's stages on nasty documents and on the smallest tables, against brute force where that is exact."""

import re

import pytest

import corpus_pipeline as pipeline
from kinetext.llm import decontaminate, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        sizes.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == COLUMNS and docs.schema == before.schema
        if name == "language":
            kept = {r.doc_id for r in docs.collect()}
            assert all(any(c.isalpha() for c in r.text) for r in docs.collect())
            assert len(kept) >= 0.98 * before.count()
        if name == "near_copies":
            rows = [" ".join(r.text.lower().split()) for r in docs.collect()]
            want = {" ".join(r.text.lower().split()) for r in before.collect()}
            assert len(rows) == len(set(rows)) and len(want) - 5 <= len(rows) <= len(want)
        if name == "passages":
            again = {r.doc_id: r for r in substrings.remove_repeats(before).collect()}
            for r in docs.collect():
                x = again[r.doc_id]
                assert r.text == (x.kept if x.n_removed else x.text) and r.n_chars == (len(r.text) if x.n_removed else r.n_chars)
        if name == "benchmarks":
            leaks = {r.doc_id for r in decontaminate.find_leaks(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - leaks
    assert dict(sizes)["packing"] > 0


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, sf, docs, empty):
    rows = docs.limit(0) if empty else docs.unionByName(docs.limit(3))
    for name, stage in pipeline.STAGES:
        out = stage(spark, rows, sf)
        if name == "packing":
            assert (out.count() == 0) == empty
        else:
            assert out.columns == rows.columns
            rows = out
            assert (rows.count() == 0) == empty


def test_null_ids_and_no_benchmark(spark, tmp_path):
    """Rows without an id, repeated rows and an empty benchmark: no clean text is lost, a copy is."""
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b = "one clean text about nothing much at all " * 3, "quite another text that says something else entirely here"
    rows = spark.createDataFrame([(None, a, "en", "s", 1), (None, b, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (6, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = rows.filter("text is not null")
    for name, stage in pipeline.STAGES[1:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert sorted((r.doc_id is None, r.text) for r in rows.collect()) == [(False, b), (True, a)], name
    assert pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() >= 2


def test_leaks_without_ids(spark, tmp_path):
    """A leak without an id goes, a clean text without one stays."""
    item = "what is the name of the river that runs through the old town and where does it end"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = "nothing of the kind is said in these few words about the weather"
    rows = spark.createDataFrame([(None, f"so {item} then", 1), (None, clean, 2), (None, None, 3), (4, item.upper(), 4), (4, clean, 5)], "doc_id bigint, text string, _key int")
    out = pipeline.benchmarks(spark, rows, str(tmp_path))
    assert out.columns == rows.columns and sorted(r._key for r in out.collect()) == [2, 3, 5]


def test_run_equals_stages(spark, sf):
    out = pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns)
    total = {}
    for r in out.collect():
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert total and all(a == b for a, b in total.values())


def test_names():
    names = [n for n, _ in pipeline.STAGES]
    assert 4 <= len(names) <= 5 and all(re.fullmatch(r"\w+", n) for n in names)


def test_batch_setting(spark):
    """Small Arrow batches where the application names no size; a size that is set stays; cleanup gives the setting back."""
    from kinetext.llm import common

    known = spark._jsparkSession.sessionState().conf()
    common.cleanup(spark)
    spark.conf.unset(common.BATCH)
    common.ship(spark)
    assert spark.conf.get(common.BATCH) == "1000"
    common.cleanup(spark)
    assert not known.contains(common.BATCH)
    spark.conf.set(common.BATCH, "10000")
    common.ship(spark)
    common.cleanup(spark)
    assert spark.conf.get(common.BATCH) == "10000"
    spark.conf.unset(common.BATCH)
