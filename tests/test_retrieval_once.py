"""A search runs the embedder once, sends its terms to the postings, and passes on the rows that may be first; a text's runs are hashed only where a query's may begin."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from gneiss.operators import retrieval as R, stores
from gneiss.operators.sparse_index import build_sparse_index


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_embedder_runs_once_and_null_vectors_are_left_out(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None), (3, "b b")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = R.dense_scores(docs.select("doc_id", stores.hashing_embedder(F.col("text")).alias("vector")), docs.where("doc_id = 3").select(F.col("doc_id").alias("query_id"), stores.hashing_embedder(F.col("text")).alias("vector")), 3)
    assert _plan(found).count("ArrowEvalPython") == 1
    assert {(r["doc_id"], r["score"]) for r in found.collect()} == {(1, 0.707107), (2, 0.0), (3, 1.0)}
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, vector array<double>")
    assert [r["doc_id"] for r in R.dense_scores(some, some.where("doc_id = 1").withColumnRenamed("doc_id", "query_id"), 3).collect()] == [1]


def test_a_sparse_search_shuffles_no_postings_and_a_task_passes_on_what_may_be_first(spark, tmp_path):
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefghij", k=draw.randint(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:50] * 10)), "doc_id long, text string")
    index = build_sparse_index(docs, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "a b c"), (2, "d d"), (3, "zz"), (4, "j a")], "query_id long, query string")
    whole, cut = R.sparse_scores(index, queries), R.sparse_scores(index, queries, limit=5)
    assert "SortMergeJoin" not in _plan(cut) and "BroadcastHashJoin" in _plan(cut)
    rows = lambda hits: sorted(map(tuple, R.ranked(hits, 5, "doc_id").collect()))
    assert rows(cut) == rows(whole)
    assert cut.count() < whole.count()


def test_rows_that_may_be_first_after_rounding_stay(spark, monkeypatch):
    monkeypatch.setattr(R, "FOREMOST_AT_ONCE", 64)
    x = np.round(np.random.default_rng(5).normal(size=900) * 3e-6, 8)
    hits = spark.createDataFrame([(i % 3, i, float(v)) for i, v in enumerate(x)] + [(7, i, 0.5) for i in range(100)], "query_id long, doc_id long, score double").coalesce(1)
    final = lambda h: sorted(map(tuple, R.ranked(h.withColumn("score", F.round("score", 6)).where("score <> 0"), 4, "doc_id").collect()))
    cut = R.foremost(hits, 4)
    assert final(cut) == final(hits)
    assert cut.where("query_id = 7").count() == 4


def test_texts_that_contain_a_query_by_brute_force(spark, monkeypatch):
    draw = random.Random(9)
    words = ["a", "bb", "ccc", "aa", "é", "longest"]
    line = lambda n: draw.choice(["", " ", "\n"]) + draw.choice([" ", "  ", "\n"]).join(draw.choices(words, k=n)) + draw.choice(["", " "])
    docs = [(i, line(draw.randint(0, 40))) for i in range(60)] + [(99, None), (98, "")]
    queries = [(i, t[a : a + draw.randint(1, 60)]) for i in range(80) for t in [draw.choice(docs[:60])[1]] for a in [draw.randint(0, len(t))]] + [(98, " "), (99, None)]
    want = {(q, d) for q, query in queries for d, text in docs if query is not None and text is not None and query in text}
    for slots in (1, 1 << 16):
        monkeypatch.setattr(R, "START_SLOTS", slots, raising=False)
        made = R.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"))
        assert "posexplode" in _plan(made)
        assert set(map(tuple, made.collect())) == want
