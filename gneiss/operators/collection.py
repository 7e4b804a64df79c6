"""Vector collections: points in folders by tenant and department with Bloom filters of their documents, so that a filtered search reads only what it may find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from gneiss.operators.generations import Pointer, current, new_generation, publish
from gneiss.operators.retrieval import dense_scores, ranked
from gneiss.operators.tables import stale

#: The distances of a collection.
DISTANCES = ("cosine", "dot", "euclid")
POINT = StructType().add("doc_id", "long").add("chunk_id", "string").add("document_id", "string").add("tenant_id", "string").add("department", "string").add("vector", ArrayType(DoubleType()))
#: Bytes of a row group: what a Bloom filter or a range of ids can leave out of a scan.
ROW_GROUP = 16 << 20


class CollectionNotFoundError(ValueError):
    """A collection that doesn't exist."""


@dataclass(frozen=True)
class Collection:
    root: str
    size: int
    distance: str
    pointer: Pointer


def exists(spark: SparkSession, root: str) -> bool:
    return current(spark, root).generation is not None


def create(spark: SparkSession, root: str, size: int, distance: str = "cosine") -> bool:
    """Whether an empty collection was made; False where there is one. size: entries of its vectors."""
    if distance.lower() not in DISTANCES:
        raise ValueError(f"unsupported distance: {distance}")
    if exists(spark, root):
        return False
    _replace(spark, root, current(spark, root), None, {"size": str(size), "distance": distance.lower(), "points": "0"})
    return True


def recreate(spark: SparkSession, root: str, size: int, distance: str = "cosine") -> None:
    """An empty collection in the place of any there is; points that a reader has open stay readable."""
    if distance.lower() not in DISTANCES:
        raise ValueError(f"unsupported distance: {distance}")
    _replace(spark, root, current(spark, root), None, {"size": str(size), "distance": distance.lower(), "points": "0"})


def info(spark: SparkSession, root: str) -> Collection:
    found = current(spark, root)
    if found.generation is None:
        raise CollectionNotFoundError(f"{root} holds no collection")
    return Collection(root, int(found.facts["size"]), found.facts["distance"], found)


def _replace(spark: SparkSession, root: str, begun: Pointer, points: DataFrame | None, facts: dict[str, str], row_group: int = ROW_GROUP) -> None:
    generation = new_generation()
    if points is not None:
        dealt = points.hint("rebalance", F.col("tenant_id"), F.col("department")).sortWithinPartitions("tenant_id", "department", "document_id", "doc_id")
        writer = dealt.write.partitionBy("tenant_id", "department").option("parquet.bloom.filter.enabled#document_id", "true").option("parquet.block.size", row_group)
        writer.parquet(f"{root}/{generation}")
    kept = {} if points is None else {"points": generation}
    publish(spark, root, begun, Pointer(generation=generation, parts=kept, facts=facts))


def points(spark: SparkSession, root: str) -> DataFrame:
    """All points of a collection. A null tenant or department is kept as such."""
    found = info(spark, root)
    if "points" not in found.pointer.parts:
        return spark.createDataFrame([], POINT)
    return spark.read.schema(POINT).parquet(f"{root}/{found.pointer.parts['points']}").select(*POINT.names)


def upsert_points(fresh: DataFrame, root: str, replace: bool = False, row_group: int = ROW_GROUP) -> int:
    """Puts the fresh points (POINT) in the place of those of equal doc_id, and returns how many the collection then has. With replace, points of the
    fresh points' documents that aren't among them are left out too (stale ones). Vectors of another length than the collection's raise ValueError; of fresh points of one id, the one with the greatest chunk_id stays.
    """
    spark = fresh.sparkSession
    found = info(spark, root)
    given = fresh.select(*POINT.names).groupBy("doc_id").agg(*[F.max_by(c, F.struct(F.coalesce("chunk_id", F.lit("")), F.xxhash64("vector"))).alias(c) for c in POINT.names[1:]])
    wrong = F.count_if(F.size("vector") != found.size)
    n, bad = given.agg(F.count("*"), F.coalesce(wrong, F.lit(0))).first()
    if bad:
        raise ValueError(f"{bad} of {n} vectors aren't of {found.size} entries")
    kept = stale(points(spark, root), given, "doc_id")
    if replace:
        kept = kept.join(given.select("document_id").distinct(), "document_id", "left_anti").select(*POINT.names)
    every = kept.select(*POINT.names).unionByName(given)
    total = every.count()
    _replace(spark, root, found.pointer, every, found.pointer.facts | {"points": str(total)}, row_group)
    return total


def delete_points(spark: SparkSession, root: str, tenant_id: str, document_id: str, row_group: int = ROW_GROUP) -> int:
    """Deletes the points of a tenant's document, and returns how many the collection then has."""
    found = info(spark, root)
    gone = F.col("tenant_id").eqNullSafe(F.lit(tenant_id)) & F.col("document_id").eqNullSafe(F.lit(document_id))
    kept = points(spark, root).where(~gone)
    total = kept.count()
    _replace(spark, root, found.pointer, kept, found.pointer.facts | {"points": str(total)}, row_group)
    return total


def delete_documents(gone: DataFrame, root: str, row_group: int = ROW_GROUP) -> int:
    """Deletes the points of all the documents of gone (tenant_id, document_id), and returns how many the collection then has."""
    spark = gone.sparkSession
    found = info(spark, root)
    kept = points(spark, root).join(gone.select("tenant_id", "document_id").distinct(), ["tenant_id", "document_id"], "left_anti").select(*POINT.names)
    total = kept.count()
    _replace(spark, root, found.pointer, kept, found.pointer.facts | {"points": str(total)}, row_group)
    return total


def count(spark: SparkSession, root: str) -> int:
    """Points, from the pointer: no point is read."""
    return int(info(spark, root).pointer.facts["points"])


def filtered(spark: SparkSession, root: str, tenant_id: str | None = None, department: str | None = None, document_id: str | None = None) -> DataFrame:
    """The points that the given filters leave: folders of other tenants and departments aren't read, and row groups without the document neither."""
    out = points(spark, root)
    for name, value in (("tenant_id", tenant_id), ("department", department), ("document_id", document_id)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def search(queries: DataFrame, root: str, limit: int = 5, tenant_id: str | None = None, department: str | None = None, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best limit points for each of queries (query_id, vector), of at least the score if any is given, by the collection's distance.

    No collection raises CollectionNotFoundError, a limit of 0 or less and query vectors of another length ValueError.
    """
    spark = queries.sparkSession
    found = info(spark, root)
    if limit <= 0:
        raise ValueError("limit must be over zero")
    if not queries.where(F.size("vector") != found.size).isEmpty():
        raise ValueError(f"query vectors must have {found.size} entries")
    return ranked(dense_scores(filtered(spark, root, tenant_id, department), queries, limit, found.distance, least=least), limit, "doc_id")
