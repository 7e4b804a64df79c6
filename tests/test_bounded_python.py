"""What Python holds of a table at once doesn't grow with the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import chunking, sequential_chunks as S, sparse_index as I, stores

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize(
    "made",
    [
        I.postings_of,
        lambda d: chunking.fixed_size(d, chunking.ChunkConfig("fixed_size")),
        lambda d: S.chunk(d, chunking.ChunkConfig("recursive")),
        lambda d: d.select(stores.hashing_embedder(F.col("text"))),
        lambda d: d.select(T.clean(F.col("text"))),
        lambda d: d.select(T.clean_each(F.array("text"))),
    ],
)
def test_whole_texts_go_to_python_in_small_batches(spark, made):
    before = spark.conf.get(KEY, None)
    try:
        spark.conf.set(KEY, "10000")
        made(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
        assert int(spark.conf.get(KEY)) <= 256
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)
