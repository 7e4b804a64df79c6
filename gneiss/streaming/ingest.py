"""An extension: documents that arrive as files are cleaned, chunked and upserted, batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.functions.text import clean
from gneiss.operators.chunking import ChunkConfig, fixed_size, with_chunk_ids
from gneiss.operators.stores import write_partitions
from gneiss.shared import written

#: Folders of the store.
BUCKETS = 64
DOCUMENT = "doc_id long, tenant_id string, department string, text string"


def chunk_stream(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """Cleaned fixed-size chunks with ids of a stream (or table) of documents."""
    cleaned = docs.withColumn("text", clean(F.col("text"))).withColumns({"document_id": F.col("doc_id").cast("string"), "content_hash": F.sha2("text", 256)})
    return with_chunk_ids(fixed_size(cleaned, config), "fixed_size").drop("text")


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, config: ChunkConfig) -> StreamingQuery:
    """Reads new Parquet files of DOCUMENT rows in source and puts their chunks in the place of the documents' former ones in store.

    The store has BUCKETS folders of documents by hash; a batch rewrites the buckets of its documents. One that is run again
    after a failure writes the same buckets, so each document's chunks are there once.
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh = written(batch.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")), "ingest")
        try:
            stored = spark.read.schema(fresh.schema).parquet(store)
        except AnalysisException:  # the first batch
            stored = fresh.limit(0)
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
        kept = stored.where(F.col("bucket").isin(touched)).join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
        write_partitions(written(kept.select(*fresh.columns).unionByName(fresh), "ingest"), store, "bucket")

    stream = spark.readStream.schema(DOCUMENT).parquet(source)
    return chunk_stream(stream, config).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of events (ts, event_type, value) in windows of event time; later ones than the watermark are left out of a stream."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "value")
