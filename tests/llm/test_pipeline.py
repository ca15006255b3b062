"""Stages of the pipeline: each against its operator's contract, on what its predecessor kept."""

import brute
import corpus_pipeline
import pytest
from lodestrata.llm.common import documents, written


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    docs, out = documents(spark, sf_dir), []
    for name, stage in corpus_pipeline.STAGES:
        found = written(stage(spark, docs, sf_dir), name)
        out.append((docs, found))
        docs = found
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(results, spark, sf_dir):
    assert all(found.columns == documents(spark, sf_dir).columns for _, found in results[:-1])


def test_quality(results):
    docs, found = results[0]
    assert set(ids(found)) < set(ids(docs))


def test_exact(results):
    docs, found = results[1]
    assert ids(found) == sorted(r[0] for r in brute.exact(pairs(docs)) if r[3])


def test_near(results):
    docs, found = results[2]
    assert ids(found) == sorted(r[0] for r in brute.near(pairs(docs)) if r[0] == r[2])


def test_contamination(results, spark, sf_dir):
    docs, found = results[3]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(found) == sorted(r[0] for r in brute.contaminated(pairs(docs), items) if not r[5])


def test_bpe(results):
    docs, found = results[4]
    assert sorted(map(tuple, found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(brute.bpe(pairs(docs)))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, sf_dir, k, edges, none):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, none, sf_dir).collect() == []
    assert 0 <= stage(spark, edges, sf_dir).count() <= edges.count()
