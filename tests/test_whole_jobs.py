"""Queries and operators that must leave nothing out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gneiss.operators import chunking, profiles as P
from gneiss.plans import corpus

SF = "/root/testdata/sf0.001"


def test_every_routed_decision_has_chunks(spark):
    found = corpus.routed_chunks(spark, SF).groupBy("doc_id", "strategy").count().collect()
    decided = P.route(P.profile(corpus._profiled(spark, SF).withColumn("filled", F.col("text").rlike(r"\S")))).where("filled")
    asked = {(r.doc_id, r.strategy) for r in decided.select("doc_id", F.explode("decisions.strategy").alias("strategy")).collect()}
    assert {s for _, s in asked} == {"recursive", "structure_aware", "json_aware", "table_aware", "page_aware"}
    assert asked <= {(r.doc_id, r.strategy) for r in found}


def test_a_decision_without_a_chunker_raises(spark):
    decisions = spark.createDataFrame([(1, "recursive"), (2, "odd")], "doc_id long, strategy string")
    chunks = spark.createDataFrame([(1, 0)], "doc_id long, chunk_index int")
    assert chunking.routed(decisions.where("doc_id = 1"), {"recursive": chunks}).collect() == [(1, 0, "recursive")]
    with pytest.raises(Exception, match="no chunker for strategy odd"):
        chunking.routed(decisions, {"recursive": chunks}).collect()
    with pytest.raises(Exception, match="no chunker for strategy odd"):
        chunking.routed(decisions, {"recursive": chunks}).count()
