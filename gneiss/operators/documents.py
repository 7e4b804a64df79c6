"""The document catalog: records and their life cycle, files as objects, and deletes that take a document's vectors, chunks and file along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gneiss.operators import chunk_store, collection
from gneiss.operators.keyed_store import KeyedStore, store
from gneiss.operators.tables import ADMIN_ROLES
from gneiss.shared import written

RECORD = StructType()
for _name in ("document_id", "tenant_id", "department", "filename", "file_type", "content_hash", "s3_key", "status"):
    RECORD = RECORD.add(_name, "string")
RECORD = RECORD.add("file_size", "long").add("version", "integer")
OBJECT = StructType().add("key", "string").add("content", "binary")
# The states of a document's life, and the outcomes of a delete.
PROCESSING, READY, FAILED = "PROCESSING", "READY", "FAILED"
DELETED, DENIED, NOT_FOUND = "DELETED", "DENIED", "NOT_FOUND"


class DocumentNotFoundError(ValueError):
    """A document that the catalog doesn't have."""


def catalog(root: str) -> KeyedStore:
    return store(root, RECORD, ["document_id"])


def objects(root: str) -> KeyedStore:
    """Files as rows of key and content: put, read and remove them by key."""
    return store(root, OBJECT, ["key"])


def held_objects(spark: SparkSession, files: KeyedStore, keys: DataFrame) -> DataFrame:
    """keys (key) with held: whether there is an object of that key. No content is read."""
    there = files.read(spark).select("key", F.lit(True).alias("held"))
    return keys.join(there, "key", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def local_documents(spark: SparkSession, root: str, tenant_id: str, department: str | None = None) -> DataFrame:
    """RECORD rows of the files below root, of which department names one folder only: the id is the SHA-256 of the path relative to root, the department the name of the file's folder. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    relative = F.substring_index("path", f"{root.rstrip('/').removeprefix('file://')}/", -1)
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    folder = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(root.rstrip("/").rsplit("/", 1)[-1]))
    found = files.select(
        F.sha2(relative, 256).alias("document_id"), F.lit(tenant_id).alias("tenant_id"), folder.alias("department"), name.alias("filename"), F.regexp_extract(name, r"[^.](\.[^.]+)$", 1).alias("file_type"),
        F.lit(None).cast("string").alias("content_hash"), "path", F.lit(READY).alias("status"), F.col("length").alias("file_size"), F.lit(1).alias("version"),
    )
    found = found.withColumnRenamed("path", "s3_key").select(*RECORD.names)
    return found if department is None else found.where(F.col("department") == department)


def create(documents: KeyedStore, rows: DataFrame) -> None:
    """New records in state PROCESSING; ids that the catalog has raise ValueError."""
    spark = rows.sparkSession
    if not rows.join(documents.read(spark).select("document_id"), "document_id", "left_semi").isEmpty():
        raise ValueError("documents that are there already")
    documents.put(rows.withColumn("status", F.lit(PROCESSING)))


def update(documents: KeyedStore, changes: DataFrame) -> None:
    """Sets what changes (document_id and further columns of RECORD) say of their documents; other columns stay, and so does a value whose change is null. Unknown documents raise DocumentNotFoundError, before anything is changed."""
    spark = changes.sparkSession
    fields = [c for c in RECORD.names if c in changes.columns and c != "document_id"]
    new = changes.select("document_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    both = written(new.join(documents.read(spark).withColumn("known", F.lit(True)), "document_id", "left"), "updates")
    if not both.where("known IS NULL").isEmpty():
        raise DocumentNotFoundError(f"{both.where('known IS NULL').count()} unknown documents")
    documents.put(both.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in RECORD.names]))


def settle(documents: KeyedStore, results: DataFrame) -> None:
    """The end of processing: results (document_id, error) make documents READY where error is null, and FAILED where not; of several results of a document one failure decides."""
    each = results.groupBy("document_id").agg(F.count("error").alias("errors"))
    update(documents, each.select("document_id", F.when(F.col("errors") > 0, FAILED).otherwise(READY).alias("status")))


def outcomes(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, document_id, tenant_id, s3_key, outcome) of delete requests (request_id, role, tenant_id, document_id), in the order of these rules: only admin roles may delete; the document must be there; it must be of the requester's tenant."""
    own = records.select("document_id", F.col("tenant_id").alias("own_tenant"), "s3_key")
    found = requests.withColumnRenamed("tenant_id", "asking").join(own, "document_id", "left")
    outcome = F.when(~F.coalesce(F.col("role").isin(*ADMIN_ROLES), F.lit(False)), DENIED).when(F.col("own_tenant").isNull(), NOT_FOUND).when(~F.col("asking").eqNullSafe(F.col("own_tenant")), DENIED).otherwise(DELETED)
    return found.select("request_id", "document_id", F.col("own_tenant").alias("tenant_id"), "s3_key", outcome.alias("outcome"))


def delete_documents(requests: DataFrame, documents: KeyedStore, points: str | None = None, chunks: str | None = None, files: KeyedStore | None = None) -> DataFrame:
    """outcomes of the requests, after what they delete is gone: the points of the collection, the chunks of the store, the objects, and last the records.

    Each store is published by itself, in this order, so a run that ends in between leaves the records, and the same requests can be made again.
    """
    spark = requests.sparkSession
    found = written(outcomes(requests, documents.read(spark)), "deletes")
    gone = found.where(F.col("outcome") == DELETED).select("document_id", "tenant_id", "s3_key").distinct()
    if gone.isEmpty():
        return found
    if points is not None:
        collection.delete_documents(gone, points)
    if chunks is not None:
        chunk_store.delete_documents(gone, chunks)
    if files is not None:
        files.remove(gone.where("s3_key IS NOT NULL").select(F.col("s3_key").alias("key")))
    documents.remove(gone)
    return found
