"""Documents are profiled once, however many chunkers ask for the decisions."""

from __future__ import annotations

from gneiss.plans import corpus

SF = "/root/testdata/sf0.001"


def test_chunkers_read_decisions_that_are_written(spark):
    plan = corpus.routed_chunks(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "PART ONE" in plan  # the texts themselves are made
    assert "structure_confidence" not in plan and "heading_count" not in plan
