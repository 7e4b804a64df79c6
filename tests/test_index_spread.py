"""The work of an index is spread: its fit over tasks, and what a search shuffles doesn't follow the lists."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gneiss.operators import vector_index as I
from gneiss.operators.retrieval import dense_scores, ranked


def _vectors(spark, n):
    x = np.random.default_rng(7).normal(size=(n, 8))
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "doc_id long, vector array<double>").coalesce(1)


def test_the_fit_is_spread_and_has_the_rows_of_least_hashes(spark, monkeypatch):
    seen = {}

    class Fit(I.KMeans):
        def fit(self, features):
            seen["parts"] = features.rdd.getNumPartitions()
            seen["rows"] = {tuple(r[0]) for r in features.collect()}
            return super().fit(features)

    monkeypatch.setattr(I, "KMeans", Fit)
    monkeypatch.setattr(I, "FIT_ROWS_A_TASK", 100, raising=False)
    vectors = _vectors(spark, 1000)
    I.fit_centroids(vectors, "euclid", lists=5, fit_rows=600)
    least = vectors.orderBy(F.xxhash64("doc_id", "vector")).limit(600).collect()
    assert seen == {"parts": math.ceil(600 / 100), "rows": {tuple(r["vector"]) for r in least}}


def test_a_task_of_an_indexed_search_passes_on_the_best_rows_of_a_query(spark, tmp_path):
    vectors = _vectors(spark, 2000)
    index = I.build_vector_index(vectors, str(tmp_path), "cosine", lists=20)
    whole = I.VectorIndex(index.rows.coalesce(1), index.centroids, index.metric, index.probed)
    asked = vectors.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    found = I.indexed_scores(whole, asked, 5, probed=20)
    assert {r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {5}
    rows = lambda hits: {(r["query_id"], r["doc_id"], r["score"]) for r in hits.collect()}
    assert rows(found) == rows(ranked(dense_scores(vectors, asked, 5), 5, "doc_id"))
