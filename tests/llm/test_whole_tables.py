"""Every query over empty tables, and over tables of odd rows."""

import pytest

import corpus_pipeline
from tidewright.llm.queries import QUERIES


def write(spark, folder, docs, labels, pages, vectors):
    for name, df in (("documents", docs), ("labels", labels), ("pages", pages), ("embeddings", vectors)):
        df.write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def empty_dir(spark, none, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write(spark, folder, none, labels.where("false"), pages, spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    return folder


@pytest.fixture(scope="module")
def odd_dir(spark, odd, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    pages = spark.createDataFrame([(1, "http://a.net/en/1", "x"), (1, "http://a.net/en/1", "x"), (None, None, None), (2, "", ""), (3, "https://www.example.com/en/?q#f", None)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (50, [1.0, 1.0], 1), (51, [1.0, 1.0], None), (52, None, 0), (None, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    write(spark, folder, odd, labels, pages, vectors)
    return folder


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty_dir, name):
    assert (corpus_pipeline.run if name == "pipeline" else QUERIES[name])(spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_odd_rows(spark, odd_dir, odd, name):
    got = (corpus_pipeline.run if name == "pipeline" else QUERIES[name])(spark, odd_dir)
    rows = got.collect()
    if name.startswith(("op1_", "op2_", "op3_", "op5_", "op6_", "op7_", "op10_", "op11_", "op13_")):
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    elif name.startswith("op4_"):
        assert len(rows) == 5
    elif name.startswith("op9_"):
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows) == [(0, 1, 50), (0, 2, 51), (50, 1, 51), (50, 2, 0)]
    else:
        assert rows
