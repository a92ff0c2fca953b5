"""The pipeline against the same stages put together from brute-force versions."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.conftest import DATA
from tests.llm.test_duplicates import brute_near, brute_runs, brute_sentences
from tests.llm.test_tokens_and_packing import check_packing


@pytest.fixture(scope="module")
def stages(spark, docs):
    tables, own = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        own = stage(spark, own, DATA).persist()
        tables.append(own)
    return tables


def test_stages_take_effect(spark, stages):
    docs, good, told, single, cut, packed = stages
    assert all(t.columns == docs.columns and t.dtypes == docs.dtypes for t in (good, told, single, cut))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(q == 1 and d not in kept for d, q in labels.items()) <= 4 and sum(q == 0 and d in kept for d, q in labels.items()) <= 2
    assert told.count() == good.count()
    near = brute_near([(r.doc_id, r.text) for r in told.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {d for d, (_, _, first) in near.items() if first}
    rows = {r.doc_id: r for r in single.collect()}
    texts = [(d, r.text) for d, r in rows.items()]
    expect, runs = brute_sentences(texts, 2, 12), brute_runs(texts, 51)
    for r in cut.collect():
        assert (r.text == rows[r.doc_id].text) == (expect[r.doc_id][1] == 0 and runs[r.doc_id] == rows[r.doc_id].text.split()) and r.n_chars == len(r.text) and r.source == rows[r.doc_id].source
    assert set(check_packing(packed.collect(), 2048)) == set(rows)


def test_run_gives_the_last_stage(spark, stages):
    got = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in stages[-1].collect()}


def test_stages_at_the_edges(spark, odd, none):
    for table, n in ((none, 0), (odd, None)):
        own = table
        for _, stage in corpus_pipeline.STAGES:
            before = own.columns
            own = stage(spark, own, DATA)
            assert stage is corpus_pipeline.packing or own.columns == before
        assert n is None or own.count() == n


def test_substring_dedup_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{k}" for k in range(60)) + "."
    rows = [(1, text, "keep-me", 7, [1], 5), (2, text, "keep-me-too", 8, [2], 6), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, _n_removed int, removed array<int>, kept int")
    got = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, docs, DATA).collect()}
    assert [tuple(got[d])[2:] for d in (1, 2, 3)] == [r[2:] for r in rows]
    assert (got[1].text, got[2].text, got[3].text) == (text, "", None)


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)) and "pipeline" in names
