"""The chunk store: documents' chunks and manifests in buckets, written by stage, verify and swap."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DecimalType, StructType, TimestampType

from gneiss.operators.generations import Pointer, VerificationError, current, new_generation, publish
from gneiss.shared import written

#: Parts of a store: a batch rewrites those that hold its documents.
BUCKETS = 64
#: The versions that a manifest states, and the statuses of a persist.
ROUTER_VERSION, CHUNKING_VERSION = "1.0", "1.0"
SKIPPED, WRITTEN, REBUILT, REFUSED = "SKIPPED_UP_TO_DATE", "WRITTEN", "REBUILT", "REFUSED_ZERO_CHUNKS"
#: What must be equal for a stored document to be up to date.
COMPARED = ("document_id", "content_hash", "tenant_id", "department", "router_version", "chunking_version", "chunking_config", "strategy_counts", "chunk_type_counts", "total_chunks")
_COUNTS = ArrayType(StructType().add("value", "string").add("n", "long"))
MANIFEST = StructType()
for _name in ("document_id", "tenant_id", "department", "content_hash", "router_version", "chunking_version", "chunking_config"):
    MANIFEST = MANIFEST.add(_name, "string")
MANIFEST = MANIFEST.add("strategy_counts", _COUNTS).add("chunk_type_counts", _COUNTS).add("total_chunks", "long").add("digest", DecimalType(38, 0)).add("generated_at", TimestampType()).add("bucket", "integer")
CHUNK = StructType().add("document_id", "string").add("tenant_id", "string").add("chunk_id", "string").add("chunk_index", "integer").add("strategy", "string").add("chunk_type", "string")
CHUNK = CHUNK.add("chunk_text", "string").add("token_count", "long").add("bucket", "integer")


def _bucket():
    return F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def proofs(chunks: DataFrame) -> DataFrame:
    """What one aggregate says of each document's chunks: total, unique ids, first and last index, tenants, and a digest of ids at their places, whatever the order of rows."""
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("total"), F.count_distinct("chunk_id").alias("unique_ids"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"),
        F.min("tenant_id").alias("tenant"), F.max("tenant_id").alias("other_tenant"), F.sum(F.xxhash64("chunk_id", "chunk_index").cast("decimal(38,0)")).alias("digest"),
    )


def manifests(documents: DataFrame, chunks: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """A MANIFEST row for each of documents (document_id, tenant_id, department, content_hash) that has chunks (CHUNK without bucket)."""
    kinds = chunks.groupBy("document_id", "strategy", "chunk_type").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.collect_list(F.struct("strategy", "chunk_type", "n")).alias("kinds"))

    def counts(name: str):
        of = lambda v: F.aggregate(F.filter("kinds", lambda k: k[name].eqNullSafe(v)), F.lit(0).cast("long"), lambda n, k: n + k["n"])
        return F.array_sort(F.transform(F.array_distinct(F.transform("kinds", lambda k: k[name])), lambda v: F.struct(v.alias("value"), of(v).alias("n")))).cast(_COUNTS).alias(f"{name}_counts")

    own = documents.join(kinds, "document_id").join(proofs(chunks).select("document_id", F.col("total").alias("total_chunks"), "digest"), "document_id")
    return own.select(
        "document_id", "tenant_id", "department", "content_hash", F.lit(ROUTER_VERSION).alias("router_version"), F.lit(CHUNKING_VERSION).alias("chunking_version"),
        F.lit(json.dumps(dict(config), sort_keys=True)).alias("chunking_config"), counts("strategy"), counts("chunk_type"), "total_chunks", "digest", F.current_timestamp().alias("generated_at"), _bucket(),
    )


def _read(spark: SparkSession, root: str, pointer: Pointer, what: str, schema: StructType, buckets: set[str] | None = None) -> DataFrame:
    paths = [f"{root}/{g}/{what}/bucket={b}" for b, g in sorted(pointer.parts.items()) if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], schema)
    plain = StructType([f for f in schema if f.name != "bucket"])
    return spark.read.schema(plain).parquet(*paths).withColumn("bucket", _bucket()).select(*schema.names)


def load_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of the published generation; no rows where nothing is published."""
    return _read(spark, root, current(spark, root), "chunks", CHUNK)


def load_manifests(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, current(spark, root), "manifests", MANIFEST)


def statuses(documents: DataFrame, fresh: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(document_id, status) of each of documents, from its fresh manifest and the stored one: one without chunks is refused; generated_at and digest don't count."""
    now, was = (m.select("document_id", F.struct(*COMPARED).alias(name)) for m, name in ((fresh, "now"), (stored, "was")))
    found = documents.select("document_id").distinct().join(now, "document_id", "left").join(was, "document_id", "left")
    same = F.lit(not force) & F.col("now").eqNullSafe(F.col("was"))
    return found.select("document_id", F.when(F.col("now").isNull(), REFUSED).when(F.col("was").isNull(), WRITTEN).when(same, SKIPPED).otherwise(REBUILT).alias("status"))


def verify(expected: DataFrame, staged: DataFrame) -> None:
    """Holds staged chunks against their manifests: counts, ids and their order, uniqueness, and whose they are. Raises VerificationError with some of what differs."""
    want = expected.select("document_id", "tenant_id", "total_chunks", F.col("digest").alias("wanted"))
    both = want.join(proofs(staged), "document_id", "full")
    wrong = F.concat_ws(
        ", ",
        F.when(F.col("total").isNull() | F.col("total_chunks").isNull() | (F.col("total") != F.col("total_chunks")), "count"),
        F.when((F.col("first") != 0) | (F.col("last") != F.col("total") - 1) | (F.col("digest") != F.col("wanted")), "ids or their order"),
        F.when(F.col("unique_ids") != F.col("total"), "repeated ids"),
        F.when((F.col("tenant") != F.col("tenant_id")) | (F.col("other_tenant") != F.col("tenant_id")), "tenant"),
    )
    bad = both.select("document_id", wrong.alias("wrong")).where("wrong <> ''").limit(5).collect()
    if bad:
        raise VerificationError("; ".join(f"{r['document_id']}: {r['wrong']}" for r in bad))


def delete_documents(gone: DataFrame, root: str) -> None:
    """Takes the documents of gone (tenant_id, document_id) out of the store, with their manifests, as one generation."""
    spark = gone.sparkSession
    begun, generation = current(spark, root), new_generation()
    keys = ["tenant_id", "document_id"]
    there = load_manifests(spark, root).join(gone.select(*keys).distinct(), keys, "left_semi").select(*keys, "bucket")
    touched = {str(r[0]) for r in there.select("bucket").distinct().collect()}  # BUCKETS at most
    if not touched:
        return
    left = set()
    for what, schema in (("manifests", MANIFEST), ("chunks", CHUNK)):
        kept = written(_read(spark, root, begun, what, schema, touched).join(gone.select(*keys).distinct(), keys, "left_anti").select(*schema.names), what)
        kept.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "document_id").write.partitionBy("bucket").parquet(f"{root}/{generation}/{what}")
        left = {str(r[0]) for r in kept.select("bucket").distinct().collect()}  # BUCKETS at most
    own = Pointer(parts=dict.fromkeys(left, generation))
    verify(_read(spark, root, own, "manifests", MANIFEST), _read(spark, root, own, "chunks", CHUNK))
    publish(spark, root, begun, Pointer(generation=generation, parts={b: g for b, g in begun.parts.items() if b not in touched} | own.parts))


def persist(documents: DataFrame, chunks: DataFrame, root: str, config: Mapping[str, Any], force: bool = False) -> DataFrame:
    """(document_id, status): stores the chunks of documents whose manifest has changed (all, with force) in place of their former ones.

    The buckets of changed documents are staged as a new generation: kept documents' chunks and the new ones, with their manifests. They are read back and verified, and one
    pointer row puts them in the place of the former buckets; readers see all of the batch or nothing of it. A document without chunks is refused and keeps what is stored.
    Chunks of no document of the batch, or of another tenant than their document's, raise ValueError before anything is staged. With nothing to write there is no new generation.
    """
    spark = documents.sparkSession
    tenants = documents.select("document_id", F.col("tenant_id").alias("own"))
    foreign = chunks.select("document_id", "tenant_id").join(tenants, "document_id", "left").where(~F.col("tenant_id").eqNullSafe(F.col("own")) | F.col("own").isNull())
    if not foreign.isEmpty():
        raise ValueError("chunks of unknown documents or of another tenant")
    begun, generation = current(spark, root), new_generation()
    fresh = written(manifests(documents, chunks, config), "manifests")
    found = written(statuses(documents, fresh, _read(spark, root, begun, "manifests", MANIFEST), force), "statuses")
    changed = found.where(F.col("status").isin(WRITTEN, REBUILT)).select("document_id")
    touched = {str(r[0]) for r in changed.select(_bucket()).distinct().collect()}  # BUCKETS at most
    if not touched:
        return found
    for what, schema, given in (("manifests", MANIFEST, fresh), ("chunks", CHUNK, chunks.withColumn("bucket", _bucket()))):
        kept = _read(spark, root, begun, what, schema, touched).join(changed, "document_id", "left_anti")
        staged = kept.select(*schema.names).unionByName(given.join(changed, "document_id", "left_semi").select(*schema.names))
        staged.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "document_id").write.partitionBy("bucket").parquet(f"{root}/{generation}/{what}")
    own = Pointer(parts=dict.fromkeys(touched, generation))
    verify(_read(spark, root, own, "manifests", MANIFEST), _read(spark, root, own, "chunks", CHUNK))
    publish(spark, root, begun, Pointer(generation=generation, parts=begun.parts | own.parts))
    return found
