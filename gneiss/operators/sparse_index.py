"""The sparse index as tables: postings, term weights and a manifest, built once for a corpus and loaded by every search."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.functions.text import word_tokens
from gneiss.operators.generations import Pointer, PublishConflictError, current, new_generation, publish
from gneiss.operators.validation import issue, issues
from gneiss.shared import shared_dir, small_batches

EPSILON = 0.25
#: Of the tokenizer and of the tables' layout: an index of another version isn't loaded.
TOKENIZER_VERSION, INDEX_VERSION = "1.0", "1"
MANIFEST = "documents long, average_length double, corpus string, tokenizer_version string, index_version string, epsilon double"


@dataclass
class SparseIndex:
    """postings (doc_id, dl, term, tf), idf (term, df, idf) and the counts behind them; the counts are of the whole corpus, whatever a search filters."""

    postings: DataFrame
    idf: DataFrame
    documents: int
    average_length: float


@dataclass(frozen=True)
class Manifest:
    documents: int
    average_length: float
    corpus: str
    tokenizer_version: str = TOKENIZER_VERSION
    index_version: str = INDEX_VERSION
    epsilon: float = EPSILON


def corpus_fingerprint(docs: DataFrame) -> str:
    """Of rows (doc_id, text), whatever their order: their number and the sum of their hashes, in one partial aggregate."""
    n, total = docs.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first()
    return f"{n}-{int(total or 0)}"


def postings_of(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf): the words of each text, counted where the text is, without a shuffle."""
    small_batches(docs.sparkSession)
    worded = docs.select("doc_id", word_tokens(F.col("text")).alias("ts"))
    schema = worded.select("doc_id").schema.add("dl", "long").add("term", "string").add("tf", "long")

    def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            lists = batch.column(1)
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().dictionary_encode()
            known = max(1, len(flat.dictionary))
            keys, tf = np.unique(np.repeat(np.arange(len(length), dtype=np.int64), length) * known + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            rows = pa.array(keys // known)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(length.astype(np.int64)).take(rows), flat.dictionary.take(pa.array(keys % known)).cast(pa.string()), pa.array(tf.astype(np.int64))], schema.names)

    return worded.mapInArrow(counted, schema)


def build_sparse_index(docs: DataFrame, path: str, epsilon: float = EPSILON, corpus: str | None = None) -> SparseIndex:
    """Writes the index of rows (doc_id, text) to path, its manifest last, and loads it.

    idf is ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes epsilon times the mean of all terms' idfs.
    """
    spark = docs.sparkSession
    postings_of(docs).write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    n, texts = docs.agg(F.count("*"), F.count("text")).first()
    raw = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw.write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    mean, words = terms.agg(F.avg("raw"), F.sum("tf")).first()
    idf = terms.select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon * (mean or 0.0))).otherwise(F.col("raw")).alias("idf"))
    idf.write.mode("overwrite").parquet(f"{path}/idf")
    made = Manifest(n, float((words or 0) / texts) if texts else 0.0, corpus or corpus_fingerprint(docs), epsilon=epsilon)
    spark.createDataFrame([tuple(asdict(made).values())], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return load_sparse_index(spark, path)


def load_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest of the index in path; None where there is none, or not one whole row."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").limit(2).collect()
    except AnalysisException:
        return None
    return Manifest(**rows[0].asDict()) if len(rows) == 1 else None


def load_sparse_index(spark: SparkSession, path: str) -> SparseIndex:
    found = load_manifest(spark, path)
    if found is None or (found.tokenizer_version, found.index_version) != (TOKENIZER_VERSION, INDEX_VERSION):
        raise ValueError(f"{path} holds no sparse index of this version")
    return SparseIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/idf"), found.documents, found.average_length)


def sparse_index(docs: DataFrame, folder: str | None = None, epsilon: float = EPSILON) -> SparseIndex:
    """The index of rows (doc_id, text), kept in folder (by default the shared one) under the corpus's fingerprint: loaded where it's there, else built."""
    spark, corpus = docs.sparkSession, corpus_fingerprint(docs)
    root = f"{folder or shared_dir(spark)}/sparse-index-{INDEX_VERSION}-{epsilon}-{corpus}"
    begun = current(spark, root)
    found = load_manifest(spark, f"{root}/{begun.generation}") if begun.generation else None
    if found is not None and found == Manifest(found.documents, found.average_length, corpus, epsilon=epsilon):
        return load_sparse_index(spark, f"{root}/{begun.generation}")
    generation = new_generation()  # a folder of its own, so that two sessions that build the same index don't touch each other's files
    made = build_sparse_index(docs, f"{root}/{generation}", epsilon, corpus)
    with contextlib.suppress(PublishConflictError):  # another session's index of this corpus will be loaded next time
        publish(spark, root, begun, Pointer(generation=generation))
    return made


def sparse_index_issues(docs: DataFrame, path: str) -> DataFrame:
    """Issues of the index in path against its corpus of rows (doc_id, text): what is missing, unknown, or counted otherwise; subject is a document, a term or the manifest."""
    spark = docs.sparkSession
    found = load_manifest(spark, path)
    whole = spark.createDataFrame([("manifest", found is None, found is not None and found.corpus != corpus_fingerprint(docs), found is not None and (found.tokenizer_version, found.index_version) != (TOKENIZER_VERSION, INDEX_VERSION))], "subject string, lost boolean, other boolean, old boolean")
    out = issues(whole, "subject", issue(F.col("lost"), "ERROR", "MISSING_MANIFEST"), issue(F.col("other"), "ERROR", "CORPUS_HASH_MISMATCH"), issue(F.col("old"), "ERROR", "VERSION_MISMATCH"))
    if found is None:
        return out
    index = spark.read.parquet(f"{path}/postings")
    own = index.groupBy("doc_id").agg(F.sum("tf").alias("words"), F.min("dl").alias("low"), F.max("dl").alias("high"))
    there = docs.select("doc_id", F.size(word_tokens(F.col("text"))).cast("long").alias("n")).where("n > 0")
    both = there.join(own, "doc_id", "full").withColumn("subject", F.col("doc_id").cast("string"))
    n = docs.count()
    counted = index.groupBy("term").agg(F.count("*").alias("n")).join(spark.read.parquet(f"{path}/idf").select("term", "df"), "term", "full")
    out = out.unionByName(issues(spark.createDataFrame([("manifest", n != found.documents)], "subject string, wrong boolean"), "subject", issue(F.col("wrong"), "ERROR", "DOCUMENT_COUNT_MISMATCH")))
    out = out.unionByName(issues(both, "subject", issue(F.col("words").isNull(), "ERROR", "MISSING_DOCUMENT"), issue(F.col("n").isNull(), "ERROR", "UNKNOWN_DOCUMENT"), issue((F.col("words") != F.col("n")) | (F.col("low") != F.col("n")) | (F.col("high") != F.col("n")), "ERROR", "LENGTH_MISMATCH")))
    return out.unionByName(issues(counted, "term", issue(~F.col("n").eqNullSafe(F.col("df")), "ERROR", "TERM_COUNT_MISMATCH")))
