"""SQL's chunker makes its rows where the text is: no text is shuffled or joined."""

from __future__ import annotations

from gneiss.plans import stored
from gneiss.functions import registry

SF = "/root/testdata/sf0.001"


def test_chunks_without_a_join(spark):
    plan = stored.sql_chunks(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Aggregate" not in plan


def test_short_blank_and_null_texts(spark):
    registry.register(spark)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, " a b\tc  d e "), (6, "a b c")]
    spark.createDataFrame(rows, "id long, t string").createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT id, c.* FROM odd_texts, LATERAL chunk(t, 3, 1) c ORDER BY id, chunk_index").collect()
    assert [tuple(r) for r in got] == [(4, 0, "a", 1), (5, 0, "a b\tc", 3), (5, 1, "c  d e", 3), (6, 0, "a b c", 3)]
