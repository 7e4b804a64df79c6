"""Dense search keeps each query's best rows within a task, whatever the batches."""

from __future__ import annotations

import numpy as np
import pytest

from gneiss.operators import retrieval as R

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("lane", [None, "lane"])
def test_a_task_sends_only_its_best_rows(spark, monkeypatch, metric, lane):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(700, 6)), 1)  # many ties
    v[::7] = v[0]
    v[5] = 0
    rows = spark.createDataFrame([(int(k), x.tolist(), f"l{k % 3}") for k, x in enumerate(v)], "doc_id long, vector array<double>, lane string").coalesce(1)
    asked = spark.createDataFrame([(int(k), v[k].tolist()) for k in range(0, 700, 10)], "query_id long, vector array<double>")
    before = spark.conf.get(KEY, None)
    try:
        spark.conf.set(KEY, "50")
        got = R.dense_scores(rows, asked, 5, metric, lane=lane).collect()
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)
    assert len(got) == 70 * 5 * (3 if lane else 1)
    score = R.scored(v[::10], v, metric)
    for at, q in enumerate(range(0, 700, 10)):
        for name in ("l0", "l1", "l2") if lane else (None,):
            own = [k for k in range(700) if name is None or f"l{k % 3}" == name]
            want = sorted(own, key=lambda k: (-score[at, k], k))[:5]
            assert sorted(((r.doc_id, r.score) for r in got if r.query_id == q and (name is None or r.lane == name)), key=lambda r: (-r[1], r[0])) == [(k, score[at, k]) for k in want]


def test_leaders_over_many_blocks():
    rng = np.random.default_rng(5)
    v, q = np.round(rng.normal(size=(5000, 4)), 1), np.round(rng.normal(size=(600, 4)), 1)
    own = R.Leaders(600, 10, None)
    for lo in range(0, 5000, 37):
        own.take(q, v[lo : lo + 37], np.arange(lo, min(lo + 37, 5000)), "cosine")
    k, j = R.best(R.scored(q, v, "cosine"), np.arange(5000), 10, None)
    assert own.k.tolist() == k.tolist() and own.keys.tolist() == j.tolist()
