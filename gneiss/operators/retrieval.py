"""Sparse and dense retrieval for a batch of queries, fusion, reranking and their ranking rules.

Queries are rows (query_id, query, ...); they are the small, stated side and are matched by term or in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.functions.text import terms, word_tokens
from gneiss.operators.sparse_index import SparseIndex
from gneiss.shared import written

K1, B = 1.5, 0.75
RRF_K = 60
#: Query vectors that are scored in one pass.
QUERY_BLOCK = 4096


def ranked(hits: DataFrame, limit: int, *tie: str, by: str = "score", within: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first limit rows of each group by falling score, then tie, with their rank from 1."""
    order = Window.partitionBy(*within).orderBy(F.col(by).desc(), *tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def sparse_scores(index: SparseIndex, queries: DataFrame, k1: float = K1, b: float = B, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term: a query's repeated terms count as often; scores are rounded to 6 places and zero ones are left out, negative ones kept.

    The queries' weighted terms are written, so that Spark knows their size: where they are few, it sends them to the postings, which then aren't shuffled.
    With limit, only rows leave a task that may be among a query's first limit, so rank them.
    """
    asked = queries.select("query_id", F.explode(word_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = written(asked.join(index.idf, "term"), "weighted")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.average_length)))
    summed = index.postings.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    if limit is not None:
        summed = foremost(summed, limit)
    return summed.withColumn("score", F.round("score", 6)).where("score <> 0")


#: Rows that a task compares with the foremost so far at once.
FOREMOST_AT_ONCE = 1 << 18


def foremost(hits: DataFrame, limit: int) -> DataFrame:
    """The rows (query_id, doc_id, score) that may be among their query's first limit once scores are rounded to 6 places and zero ones left out: of each task those within a millionth of its limit-th best score that isn't zero, and of equal scores the limit least ids."""
    if limit <= 0:
        raise ValueError("limit must be over zero")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in gathered(found, FOREMOST_AT_ONCE):
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            score, k = rows["score"].to_numpy(), rows["query_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            # Scores that may round to zero don't count; a millionth is twice what rounding moves a score.
            counts = np.flatnonzero(np.abs(score) > 1e-6)
            order = counts[np.lexsort((-score[counts], k[counts]))]
            own = k[order]
            last = order[np.arange(len(own)) - np.searchsorted(own, own) == limit - 1]
            floor = np.full(k.max() + 1, -np.inf)
            floor[k[last]] = score[last] - 1e-6 - 1e-12 * np.abs(score[last])
            kept = np.flatnonzero(~(score < floor[k]))
            if pa.types.is_integer(rows.schema.field("doc_id").type):  # copies of a text have one score: the first limit of them are enough
                kept = kept[np.lexsort((rows["doc_id"].to_numpy()[kept], -score[kept], k[kept]))]
                new = np.flatnonzero(np.append(True, (np.diff(k[kept]) != 0) | (np.diff(score[kept]) != 0)))[: len(kept)]
                kept = kept[np.arange(len(kept)) - np.repeat(new, np.diff(np.append(new, len(kept)))) < limit]
            held = rows.take(pa.array(kept))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return hits.select("query_id", "doc_id", "score").mapInArrow(batches, hits.select("query_id", "doc_id", "score").schema)


def in_scope(departments: Column, department: Column) -> Column:
    return F.array_contains(departments, "*") | F.array_contains(departments, department)


def scoped(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, score) within each query's tenant_id and departments, with department; null tenants match all."""
    own = queries.select("query_id", F.col("tenant_id").alias("asked_tenant"), "departments")
    found = hits.join(docs.select("doc_id", "tenant_id", "department"), "doc_id").join(own, "query_id")
    return found.where((F.col("asked_tenant").isNull() | (F.col("asked_tenant") == F.col("tenant_id"))) & in_scope(F.col("departments"), F.col("department")))


def per_department(hits: DataFrame, limit: int, truncate: bool) -> DataFrame:
    """The first limit of each of a query's departments, or of all together where it may see all; with truncate, the first limit of those."""
    lane = F.when(F.array_contains("departments", "*"), "*").otherwise(F.col("department"))
    found = ranked(hits.withColumn("lane", lane), limit, "doc_id", within=("query_id", "lane")).drop("rank", "lane")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    found = found.withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= limit) if truncate else found


#: Query vectors that are scored against a batch at once, so that the scores fit beside it.
SCORED_AT_ONCE = 256


def compared(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """The scores of each query vector (rows) and vector (columns)."""
    if metric == "euclid":
        score = -np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - 2 * (q @ v.T) + (v * v).sum(axis=1)[None], 0))
    else:
        score = q @ v.T
        if metric == "cosine":
            norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
            score = np.divide(score, norm, out=np.zeros_like(score), where=norm > 0)
    return score


def scored(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """The scores, to 6 places, of each query vector (rows) and vector (columns)."""
    return np.round(compared(q, v, metric), 6) + 0.0


def best(score: np.ndarray, keys: np.ndarray, limit: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of score: of each row those of least or more, and of these the first limit by score and then by key.

    A row's limit-th best score is found without sorting it, so only what reaches that is sorted.
    """
    keep = np.ones(score.shape, bool) if least is None else score >= least
    if limit is None:
        return np.nonzero(keep)
    n = min(limit, score.shape[1])
    keep &= ~(score < -np.partition(-score, n - 1, axis=1)[:, n - 1 : n])
    k, j = np.nonzero(keep)
    order = np.lexsort((keys[j], -score[k, j], k))
    k, j = k[order], j[order]
    place = np.arange(len(k)) - np.searchsorted(k, k)
    return k[place < n], j[place < n]


class Leaders:
    """Of each query the best limit rows (key, score) of all that a task has seen, by score and then by key."""

    def __init__(self, queries: int, limit: int, least: float | None) -> None:
        self.limit, self.least = limit, least
        self.k, self.keys, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: The score that a row has to reach to be among the best; without limit rows yet, any.
        self.floor = np.full(queries, -np.inf)

    def take(self, q: np.ndarray, v: np.ndarray, keys: np.ndarray, metric: str) -> None:
        self.merge(self.near(q, v, keys, metric))

    def near(self, q: np.ndarray, v: np.ndarray, keys: np.ndarray, metric: str, asked: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, key, score) of the vectors that may be among the best of the queries, or of those asked (their places in q), for merge."""
        asked, found = np.arange(len(q)) if asked is None else asked, []
        for lo in range(0, len(asked), SCORED_AT_ONCE):
            own = asked[lo : lo + SCORED_AT_ONCE]
            floor = self.floor[own]
            score = compared(q[own], v, metric)
            if np.isneginf(floor).any():
                score = np.round(score, 6) + 0.0
                k, j = best(score, keys, self.limit, self.least)
                found.append((own[k], keys[j], score[k, j]))
            else:  # rounding moves a score by half of a millionth at most
                k, j = np.nonzero(score >= (floor - 1e-6 - 1e-12 * np.abs(floor))[:, None])
                found.append((own[k], keys[j], np.round(score[k, j], 6) + 0.0))
        return found

    def merge(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        ks, own_keys, scores = zip((self.k, self.keys, self.scores), *found)
        k, own, score = np.concatenate(ks), np.concatenate(own_keys), np.concatenate(scores)
        order = np.lexsort((own, -score, k))
        k, own, score = k[order], own[order], score[order]
        place = np.arange(len(k)) - np.searchsorted(k, k)
        kept = place < self.limit
        self.k, self.keys, self.scores, place = k[kept], own[kept], score[kept], place[kept]
        last = place == self.limit - 1
        self.floor[self.k[last]] = np.where(np.isfinite(self.scores[last]), self.scores[last], -np.inf)


def gathered(found: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of so many, the last of fewer."""
    held, n = [], 0
    for batch in found:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Vectors that a task compares with the queries at once.
VECTORS_AT_ONCE = 2048


def dense_scores(vectors: DataFrame, queries: DataFrame, limit: int | None = None, metric: str = "cosine", lane: str | None = None, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score[, lane]) of rows (doc_id, vector) for query rows (query_id, vector), scores rounded to 6 places.

    The query vectors are taken in blocks; VECTORS_AT_ONCE vectors are scored by one matrix product, and with limit only
    a task's best limit rows of each query (and lane) leave it, so a shuffle carries limit rows a query and task; with least only
    rows of that score or more. Vectors of
    another length than the queries' raise ValueError; a zero vector's cosine is 0; null vectors are left out.
    """
    if metric not in ("cosine", "dot", "euclid"):
        raise ValueError("metric must be cosine, dot or euclid")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be over zero")
    out = None
    asked, size = [], None
    rows = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>")).toLocalIterator()

    def block(asked: list) -> DataFrame:
        ids, matrix = np.array([r[0] for r in asked], np.int64), np.array([r[1] for r in asked])
        shared = vectors.sparkSession.sparkContext.broadcast(matrix)  # at most QUERY_BLOCK vectors

        names = ["query_id", "doc_id", "score", *([lane] if lane else [])]

        def rows(k: np.ndarray, keys: np.ndarray, scores: np.ndarray, name: str) -> pa.RecordBatch:
            columns = [pa.array(ids[k]), pa.array(keys), pa.array(scores)]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array([name] * len(k), pa.string())] if lane else [])], names)

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            leaders: dict[str, Leaders] = {}
            for batch in gathered((b.filter(b.column(1).is_valid()) for b in found), VECTORS_AT_ONCE):
                own = batch.column(1)
                v = own.flatten().to_numpy(zero_copy_only=False)
                if len(v) != len(own) * q.shape[1] or (own.value_lengths().to_numpy() != q.shape[1]).any():
                    raise ValueError("the vectors have different lengths")
                v, keys = v.reshape(len(own), -1), np.array(batch.column(0).to_pylist(), np.int64)
                lanes = np.array([str(x) for x in batch.column(2).to_pylist()]) if lane else np.full(len(own), "")
                for name in map(str, np.unique(lanes)):
                    at = np.flatnonzero(lanes == name)
                    if limit is not None:
                        leaders.setdefault(name, Leaders(len(ids), limit, least)).take(q, v[at], keys[at], metric)
                        continue
                    for lo in range(0, len(ids), SCORED_AT_ONCE):
                        score = scored(q[lo : lo + SCORED_AT_ONCE], v[at], metric)
                        k, j = best(score, keys[at], None, least)
                        yield rows(lo + k, keys[at[j]], score[k, j], name)
            for name, own in leaders.items():
                yield rows(own.k, own.keys, own.scores, name)

        # Null vectors are left out above: a filter here would run a model that makes them once more.
        given = vectors.select("doc_id", F.col("vector").cast("array<double>"), *([F.col(lane).cast("string")] if lane else []))
        return given.mapInArrow(batches, "query_id long, doc_id long, score double" + (f", {lane} string" if lane else ""))

    for row in rows:
        asked.append(row)
        if len(asked) == QUERY_BLOCK:
            out = block(asked) if out is None else out.union(block(asked))
            asked = []
    if asked:
        out = block(asked) if out is None else out.union(block(asked))
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double" + (f", {lane} string" if lane else ""))
    return out


def fuse(lists: list[DataFrame], limit: int = 5, k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (query_id, doc_id, rank): the sum of weight / (k + rank), ties by the first list and rank that has the document."""
    weights = [1.0] * len(lists) if weights is None else weights
    if limit <= 0 or k <= 0:
        raise ValueError("limit and k must be over zero")
    if len(weights) != len(lists):
        raise ValueError("there must be a weight for each list")
    parts = [found.select("query_id", "doc_id", "rank", F.lit(n).alias("list"), F.lit(float(w)).alias("weight")) for n, (found, w) in enumerate(zip(lists, weights))]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first.list", "first.rank")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("first")


def overlap_score(query: Column, text: Column) -> Column:
    """The stand-in reranker: the share of the query's terms that the text has, to 6 places."""
    asked = terms(query)
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, terms(text))) / F.size(asked), 6)).otherwise(0.0)


def rerank(hits: DataFrame, score: Column, top: int = 5, relative: float = 0.1) -> DataFrame:
    """hits (query_id, doc_id, rank, ...) by a new score, ties by the old rank: the rows of at least relative times the query's best, then the first top. A negative best keeps nothing."""
    if top <= 0:
        raise ValueError("top must be over zero")
    scored = hits.withColumn("rerank_score", score)
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    kept = scored.withColumn("best", best).where(F.col("rerank_score") >= relative * F.col("best")).drop("best")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return kept.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top)


def document_ranks(hits: DataFrame, name: str = "filename") -> DataFrame:
    """(query_id, name, rank): each name at its first occurrence, ranked anew; null names are left out."""
    first = hits.where(F.col(name).isNotNull()).groupBy("query_id", name).agg(F.min("rank").alias("first"))
    return first.select("query_id", name, F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("rank"))


#: Whole words of a query that find the texts that may contain it.
KEY_WORDS = 8
#: Slots of the words that such runs begin with.
START_SLOTS = 1 << 16


def containing(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the docs (doc_id, text) whose text contains the query's, character for character.

    A query's words but the first and the last are whole words of any text that contains it: KEY_WORDS of them, from its longest that
    has as many behind it, are looked up among each text's runs of as many words by their hashes, and what is found is compared. Only runs whose first word
    may be such a longest one, by START_SLOTS slots of hashes, are hashed. Queries of fewer than three words
    have none; they are compared with every text, in blocks, within the texts' rows. Null texts contain nothing.
    """
    asked = queries.where("query is not null").select("query_id", "query", F.split("query", r"\s+").alias("w"))
    run = lambda k, n: F.xxhash64(F.array_join(F.slice("w", k, n), " "))
    slot = lambda word: F.pmod(F.xxhash64(word), F.lit(START_SLOTS))
    long = asked.where(F.size("w") > 2).withColumn("n", F.least(F.size("w") - 2, F.lit(KEY_WORDS)))
    starts = F.transform(F.sequence(F.lit(2), F.size("w") - F.col("n")), lambda k: F.struct(F.char_length(F.get("w", k - 1)).alias("size"), k.alias("k")))
    keyed = long.withColumn("k", F.array_max(starts)["k"]).select("query_id", "n", slot(F.get("w", F.col("k") - 1)).alias("slot"), run(F.col("k"), F.col("n")).alias("key"))
    worded = docs.where("text is not null").select("doc_id", F.split("text", r"\s+").alias("w"))
    # One pass over the texts for all lengths; the slots are KEY_WORDS * START_SLOTS at most, and where the queries' keys are few, Spark sends them too and no run is shuffled.
    each = worded.select("doc_id", "w", F.posexplode("w").alias("at", "word")).select("doc_id", "w", (F.col("at") + 1).alias("k"), slot(F.col("word")).alias("slot"))
    begun = each.join(F.broadcast(keyed.select("slot", "n").distinct()), "slot").where(F.col("k") + F.col("n") - 1 <= F.size("w"))
    runs = begun.select("doc_id", "n", run(F.col("k"), F.col("n")).alias("key"))
    pairs = runs.join(keyed.select("query_id", "n", "key"), ["n", "key"]).select("query_id", "doc_id").distinct().join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    out = _containing_short(docs, asked.where(F.size("w") <= 2)).union(pairs.where(F.contains("text", F.col("query"))).select("query_id", "doc_id"))
    return out.distinct()


def _containing_short(docs: DataFrame, queries: DataFrame) -> DataFrame:
    given = docs.where("text is not null").select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], queries.select("query_id").schema.add("doc_id", given.schema["doc_id"].dataType))
    block: list[tuple] = []

    def compared(block: list[tuple]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in block])
        own = given.select("doc_id", F.explode(F.filter(rows, lambda r: F.contains(F.col("text"), r["query"]))).alias("r"))
        return own.select("r.query_id", "doc_id")

    for row in queries.select("query_id", "query").toLocalIterator():
        block.append(tuple(row))
        if len(block) == 256:
            out, block = out.union(compared(block)), []
    return out.union(compared(block)) if block else out
