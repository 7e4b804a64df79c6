"""Sinks: chunk and embedding stores with manifests, up-to-date tests and corpus hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gneiss.functions.text import word_tokens
from gneiss.shared import small_batches

#: Records whose digests one group of a corpus hash joins.
HASH_GROUP = 4096


def ordered_hash(rows: DataFrame, by: str, order: str, *parts: str) -> DataFrame:
    """(by, sha256): over the concatenated parts of each document's rows in order, as one stream; corpus_hash is the form for whole corpora."""
    joined = F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), joined.alias("s"))))
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(gathered, lambda r: r["s"]), ""), 256).alias("sha256"))


def corpus_hash(rows: DataFrame, key: str, *parts: str) -> DataFrame:
    """One row sha256, whatever the order of rows: hashes of 65,536 groups by the keys' first four digest digits, each over its rows sorted by key.

    A two-level hash, so no task gathers more than a group's digests.
    """
    joined = F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    each = rows.select(F.col(key).cast("string").alias("k"), F.sha2(joined, 256).alias("d")).withColumn("g", F.substring(F.sha2("k", 256), 1, 4))
    groups = each.groupBy("g").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda r: r["d"]), ""), 256).alias("d"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda r: r["d"]), ""), 256).alias("sha256"))


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """(document_id, strategy, chunks, tokens, characters) of chunks (document_id, strategy, token_count, chunk_text)."""
    return chunks.groupBy("document_id", "strategy").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("long").alias("tokens"), F.sum(F.char_length("chunk_text")).cast("long").alias("characters"))


def persist_status(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: SKIPPED_UP_TO_DATE where all other columns are equal, REBUILT where they differ, WRITTEN where nothing is stored."""
    others = [c for c in expected.columns if c not in keys and c != "generated_at"]
    was = stored.select(*keys, F.struct(*others).alias("was"))
    now = expected.select(*keys, F.struct(*others).alias("now"))
    return now.join(was, keys, "left").select(*keys, F.when(F.col("was").isNull(), "WRITTEN").when(F.col("was") == F.col("now"), "SKIPPED_UP_TO_DATE").otherwise("REBUILT").alias("status"))


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that df has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a line that isn't JSON of the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Fixed value: the name space of URLs, of which point ids are UUIDs of version 5.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(chunk_id: Column) -> Column:
    """The chunk's UUID of version 5 in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(chunk_id, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), part(18, 3), F.lit("-"), part(21, 12))


def points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks joined with their vectors one to one, with point_id; unequal counts raise ValueError."""
    out = chunks.join(vectors, "chunk_id")
    n, m, k = chunks.count(), vectors.count(), out.count()
    if not n == m == k:
        raise ValueError(f"{n} chunks, {m} vectors, {k} pairs")
    return out.withColumn("point_id", point_id(F.col("chunk_id")))


def up_to_date(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """One row current: whether the vectors are those of the chunks, once each, of the dimension and finite."""
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("vector") == dimension)
    both = chunks.select("chunk_id", F.lit(1).alias("c")).join(vectors.select(F.col("chunk_id").alias("v"), finite.alias("ok")), F.col("chunk_id") == F.col("v"), "full")
    return both.agg(F.coalesce(F.bool_and(F.col("c").isNotNull() & F.coalesce("ok", F.lit(False))), F.lit(True)).alias("good"), F.count("*").alias("n"), F.count_distinct("chunk_id").alias("d")).select((F.col("good") & (F.col("n") == F.col("d"))).alias("current"))


def hashing_embedder(text: Column, dimension: int = 64) -> Column:
    """The stand-in model: counts of words by their MD5 (its first 32 bits, modulo dimension), of length one; a text without words is all zeros."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def counted(words: pa.Array) -> pa.Array:
        length = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = words.flatten().dictionary_encode()  # each word is hashed once a batch, and none becomes an object of its own
        raw = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        places = np.frombuffer(b"".join(hashlib.md5(w).digest()[:4] for w in raw), ">u4").astype(np.int64) % dimension
        own = np.repeat(np.arange(len(words), dtype=np.int64), length) * dimension + places[flat.indices.to_numpy(zero_copy_only=False)]
        matrix = np.bincount(own, minlength=len(words) * dimension).reshape(len(words), dimension).astype(np.float64)
        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        np.divide(matrix, norm, out=matrix, where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dimension), pa.array(matrix.ravel()))

    small_batches(SparkSession.active())
    return counted(word_tokens(text))
