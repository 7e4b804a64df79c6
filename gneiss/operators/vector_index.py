"""An inverted-file index of vectors: every row is filed under its nearest centroid, a search reads only the lists it probes and scores their rows exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gneiss.operators.generations import Pointer, current, new_generation, publish
from gneiss.operators.retrieval import VECTORS_AT_ONCE, Leaders, dense_scores, gathered, ranked
from gneiss.shared import shared_dir

INDEX_VERSION = "2"
#: Rows that centroids are fitted on at most, those with the least hashes of their ids and vectors; and the most lists.
FIT_ROWS, MOST_LISTS = 100_000, 4096
FIT_ROUNDS = 12
#: Rows of the sample that one task of the fit has, and rows that are held against all centroids at once.
FIT_ROWS_A_TASK, FILED_AT_ONCE = 2048, 1024
#: How many rows are searched for exactly when an index is built, for their first so many neighbours; a search probes as many lists as find this share of those.
CALIBRATED, NEIGHBOURS, RECALL = 200, 10, 0.95
#: Query vectors of one pass.
QUERY_BLOCK = 4096


@dataclass(frozen=True)
class VectorIndex:
    """rows (doc_id, vector, carried columns, list) of all lists, in folders by list; centroids by list; the metric they were filed by; how many lists a search probes."""

    rows: DataFrame
    centroids: np.ndarray
    metric: str
    probed: int

    @property
    def size(self) -> int:
        return self.centroids.shape[1]


def fingerprint(vectors: DataFrame) -> str:
    """Of rows, whatever their order: their number and the sum of their hashes, in one partial aggregate."""
    n, total = vectors.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in vectors.columns]).cast("decimal(38,0)"))).first()
    return f"{n}-{int(total or 0)}"


def _usable(vectors: DataFrame) -> DataFrame:
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.withColumn("vector", F.col("vector").cast("array<double>")).where(F.coalesce(whole, F.lit(False)) & (F.size("vector") > 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _places(matrix: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as they are filed: of length one for the cosine."""
    return _unit(matrix) if metric == "cosine" else matrix


def _nearness(q: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """How near each centroid (columns) is to each vector (rows): the larger the nearer, by the distance that rows are filed by."""
    q = _places(q, metric)
    return 2 * (q @ centroids.T) - (centroids * centroids).sum(axis=1)[None]


def fit_centroids(vectors: DataFrame, metric: str, lists: int | None = None, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Centroids by k-means over at most fit_rows rows; as many as the root of the number of rows, but at most MOST_LISTS and one for each eight rows of the sample."""
    n = vectors.count()
    # The sample's own number is bounded, so the fit's work is too, however many rows there are. Only hashes meet in one task: the sample is dealt out again, or one task would fit alone.
    rows = min(n, fit_rows)
    sample = vectors.select("vector", F.xxhash64("doc_id", "vector").alias("own"))
    if n > rows:
        last = sample.select("own").orderBy("own").limit(rows).agg(F.max("own")).first()[0]
        sample = sample.where(F.col("own") <= last)  # rows of the same hash as the last come along
    sample = sample.repartition(-(-rows // FIT_ROWS_A_TASK), "own").sortWithinPartitions("own").select("vector")
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        sample = sample.select(F.when(norm > 0, F.transform("vector", lambda x: x / norm)).otherwise(F.col("vector")).alias("vector"))
    k = lists or max(1, min(MOST_LISTS, round(n**0.5), min(n, fit_rows) // 8))
    if k < 2:
        return np.array([np.mean(np.array([r["vector"] for r in sample.limit(1).collect()]), axis=0)])
    features = sample.select(array_to_vector("vector").alias("features")).cache()
    found = KMeans(k=k, seed=1, maxIter=FIT_ROUNDS, featuresCol="features").fit(features)
    features.unpersist()
    return np.array(found.clusterCenters())


def filed(vectors: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """vectors with list, the number of the nearest centroid. Every row is filed; one product a batch."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS rows at most
    at = vectors.columns.index("vector")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            own = batch.column(at)
            flat = own.flatten().to_numpy(zero_copy_only=False)
            if len(flat) != len(own) * shared.value.shape[1] or len(own) and (own.value_lengths().to_numpy() != shared.value.shape[1]).any():
                raise ValueError("the vectors have different lengths")
            matrix, nearest = flat.reshape(len(own), shared.value.shape[1]), np.zeros(len(own), np.int32)
            for lo in range(0, len(own), FILED_AT_ONCE):
                nearest[lo : lo + FILED_AT_ONCE] = _nearness(matrix[lo : lo + FILED_AT_ONCE], shared.value, metric).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], [*batch.schema.names, "list"])

    return vectors.mapInArrow(batches, StructType([*vectors.schema.fields, StructField("list", IntegerType())]))


def build_vector_index(vectors: DataFrame, root: str, metric: str = "cosine", lists: int | None = None, fit_rows: int = FIT_ROWS, corpus: str | None = None) -> VectorIndex:
    """Writes the index of rows (doc_id, vector, further columns that a search may filter by) to a fresh folder under root, and publishes it.

    How many lists have to be probed is measured on it, over CALIBRATED of its rows, and is part of what is published.

    Rows without a vector, or with null or non-finite entries, are left out; vectors of different lengths raise ValueError. A list that holds much of the rows is written by several tasks.
    """
    if metric not in ("cosine", "dot", "euclid"):
        raise ValueError("metric must be cosine, dot or euclid")
    spark, begun, generation = vectors.sparkSession, current(vectors.sparkSession, root), new_generation()
    corpus = corpus or fingerprint(vectors)
    given = _usable(vectors)
    if given.isEmpty():
        raise ValueError("there is no vector to index")
    centroids = fit_centroids(given, metric, lists, fit_rows)
    path = f"{root}/{generation}"
    filed(given, centroids, metric).hint("rebalance", F.col("list")).sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    made = VectorIndex(spark.read.parquet(f"{path}/rows"), centroids, metric, len(centroids))
    publish(spark, root, begun, Pointer(generation=generation, facts={"version": INDEX_VERSION, "corpus": corpus, "metric": metric, "probed": str(calibrated(made))}))
    return load_vector_index(spark, root)


def load_vector_index(spark: SparkSession, root: str) -> VectorIndex:
    """The published index in root; ValueError where there is none of this version."""
    found = current(spark, root)
    if found.facts.get("version") != INDEX_VERSION:
        raise ValueError(f"{root} holds no vector index of this version")
    path = f"{root}/{found.generation}"
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])  # MOST_LISTS at most
    return VectorIndex(spark.read.parquet(f"{path}/rows"), centroids, found.facts["metric"], int(found.facts["probed"]))


def vector_index(vectors: DataFrame, metric: str = "cosine", folder: str | None = None) -> VectorIndex:
    """The index of the vectors, kept in folder (by default the shared one) under their fingerprint: loaded where it's there, else built."""
    spark, corpus = vectors.sparkSession, fingerprint(vectors)
    root = f"{folder or shared_dir(spark)}/vector-index-{INDEX_VERSION}-{metric}-{corpus}"
    found = current(spark, root).facts
    if found.get("version") == INDEX_VERSION and found.get("corpus") == corpus:
        return load_vector_index(spark, root)
    return build_vector_index(vectors, root, metric, corpus=corpus)


def calibrated(index: VectorIndex, queries: int = CALIBRATED, neighbours: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """The least number of lists whose probing finds that share of the neighbours of sampled rows, each row itself apart: the rows with the least hashes are searched for exactly, in one scan."""
    sample = index.rows.orderBy(F.xxhash64("doc_id", F.lit("sample"))).limit(queries).select(F.col("doc_id").alias("query_id"), "vector").collect()
    asked = index.rows.sparkSession.createDataFrame([(r["query_id"], r["vector"]) for r in sample], "query_id long, vector array<double>")
    exact = ranked(dense_scores(index.rows.select("doc_id", "vector"), asked, neighbours + 1, index.metric).where("query_id <> doc_id"), neighbours, "doc_id")
    met = exact.join(index.rows.select("doc_id", "list"), "doc_id").select("query_id", "list").collect()  # queries * neighbours at most
    if not met:
        return len(index.centroids)
    order = np.argsort(-_nearness(np.array([r["vector"] for r in sample]), index.centroids, index.metric), axis=1)
    place = {r["query_id"]: np.argsort(o) for r, o in zip(sample, order, strict=True)}
    needed = np.sort([place[r["query_id"]][r["list"]] + 1 for r in met])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def probes(index: VectorIndex, matrix: np.ndarray, probed: int | None = None) -> np.ndarray:
    """Of each query vector (rows), the lists to probe: those of the nearest centroids, as many as the index was calibrated to unless probed says otherwise."""
    n = min(len(index.centroids), probed or index.probed)
    return np.argpartition(-_nearness(matrix, index.centroids, index.metric), n - 1, axis=1)[:, :n]


def indexed_scores(index: VectorIndex, queries: DataFrame, limit: int, probed: int | None = None, where: str | None = None, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the best limit rows in the lists that each query (query_id, vector) probes, by exact scores rounded to 6 places; at most limit a query and task, so rank them.

    The queries are taken in blocks. Only lists that some query of the block probes are read (they are partitions of the table), a list's rows are scored with
    the queries that probe it, and where, an expression of the carried columns, filters rows as they are read. A task keeps the best limit rows of each query over all its lists.
    """
    if limit <= 0:
        raise ValueError("limit must be over zero")
    spark, out, asked, metric = index.rows.sparkSession, None, [], index.metric

    def block(asked: list) -> DataFrame:
        ids, matrix = np.array([r[0] for r in asked], np.int64), np.array([r[1] for r in asked])
        if matrix.ndim != 2 or matrix.shape[1] != index.size:
            raise ValueError(f"the query vectors aren't of {index.size} entries")
        chosen = probes(index, matrix, probed)
        by_list = {int(k): np.flatnonzero((chosen == k).any(axis=1)) for k in np.unique(chosen)}
        shared = spark.sparkContext.broadcast((ids, matrix, by_list))  # QUERY_BLOCK vectors at most
        rows = index.rows.where(F.col("list").isin(sorted(by_list)))
        rows = (rows.where(where) if where else rows).select("doc_id", "vector", "list")

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, by_list = shared.value
            leaders = Leaders(len(ids), limit, least)
            for batch in gathered(found, VECTORS_AT_ONCE):
                lists, keys = batch.column(2).to_numpy(), np.array(batch.column(0).to_pylist(), np.int64)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                parts = []
                for k in np.unique(lists):
                    at = np.flatnonzero(lists == k)
                    parts += leaders.near(q, v[at], keys[at], metric, by_list[int(k)])
                leaders.merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[leaders.k]), pa.array(leaders.keys), pa.array(leaders.scores)], ["query_id", "doc_id", "score"])

        return rows.mapInArrow(batches, "query_id long, doc_id long, score double")

    for row in queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>")).toLocalIterator():
        asked.append(row)
        if len(asked) == QUERY_BLOCK:
            out, asked = block(asked) if out is None else out.union(block(asked)), []
    if asked:
        out = block(asked) if out is None else out.union(block(asked))
    return out if out is not None else spark.createDataFrame([], "query_id long, doc_id long, score double")


def indexed_search(index: VectorIndex, queries: DataFrame, limit: int, probed: int | None = None, where: str | None = None, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of each query's best limit rows, ties by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return indexed_scores(index, queries, limit, probed, where, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def recall_at(found: DataFrame, exact: DataFrame, limit: int) -> DataFrame:
    """One row (queries, recall): the mean share of each query's exact first limit rows (query_id, doc_id, rank) that found has among its first limit."""
    want = exact.where(F.col("rank") <= limit).select("query_id", "doc_id")
    met = want.join(found.where(F.col("rank") <= limit).select("query_id", "doc_id", F.lit(1).alias("met")), ["query_id", "doc_id"], "left")
    each = met.groupBy("query_id").agg((F.count("met") / F.count("*")).alias("share"))
    return each.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))
