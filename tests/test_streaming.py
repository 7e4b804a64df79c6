from __future__ import annotations

from gneiss.operators.chunking import ChunkConfig
from gneiss.streaming.ingest import DOCUMENT, ingest


def test_new_and_changed_documents_are_upserted(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "out", "mark"))
    config = ChunkConfig("fixed_size", size=3, overlap=0, least=1)
    for rows in ([(1, "t", "d", "a b c d"), (2, "t", "d", "x  y")], [(1, "t", "d", "new text")]):
        spark.createDataFrame(rows, DOCUMENT).write.mode("append").parquet(source)
        ingest(spark, source, store, checkpoint, config).awaitTermination(120)
    got = sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in spark.read.parquet(store).collect())
    assert got == [(1, 0, "new text"), (2, 0, "x y")]
