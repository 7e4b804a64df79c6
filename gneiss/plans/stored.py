"""Queries of the vector index, collections, the chunk store, SQL's functions, keyed state and checked lines, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from gneiss.functions import registry
from gneiss.functions.text import token_count
from gneiss.operators import chunk_store as S, collection as V, documents as D, observed, validation as X, vector_index as I
from gneiss.operators.chunking import ChunkConfig, fixed_size, with_chunk_ids
from gneiss.operators.readonly import select_only
from gneiss.plans import corpus as K, retrieval as P
from gneiss.shared import shared_dir, written
from gneiss.sources.lines import bad_lines, read_checked_lines, write_lines
from gneiss.streaming import state

_t = P._t


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _index(spark, sf) -> I.VectorIndex:
    return I.vector_index(P._vectors(spark, sf))


def indexed_topk(spark, sf):
    """The first rows of each query by the index; approximate, so it has no SQL: indexed_recall holds it against the exact search."""
    return I.indexed_search(_index(spark, sf), P._asked(spark, sf), P.LIMIT)


def indexed_recall(spark, sf):
    """Whether the index finds nine tenths of the exact first rows."""
    return I.recall_at(indexed_topk(spark, sf), P.dense_topk(spark, sf), P.LIMIT).select("queries", (F.col("recall") >= 0.9).alias("reached"))


def indexed_whole(spark, sf):
    """A search that probes every list and filters by the carried lane: exact, so all rows must have been filed."""
    index = _index(spark, sf)
    return I.indexed_search(index, P._asked(spark, sf), P.LIMIT, probed=len(index.centroids), where="lane = 1")


def indexed_lists(spark, sf):
    """What the lists hold together."""
    return _index(spark, sf).rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum("doc_id").alias("total"))


def _points(spark, sf) -> DataFrame:
    """Embeddings as points: their labels are documents, of three tenants and two departments."""
    label = F.coalesce(F.col("label"), F.lit(-1))
    return _t(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.concat(F.lit("c"), "vec_id").alias("chunk_id"), label.cast("string").alias("document_id"), F.concat(F.lit("t"), label % 3).alias("tenant_id"),
        F.when(label % 2 == 0, "hr").otherwise("it").alias("department"), F.col("embedding").cast("array<double>").alias("vector"),
    )


def _collection(spark, sf) -> str:
    root = _root(spark, "collection")
    V.create(spark, root, 64)
    V.upsert_points(_points(spark, sf), root)
    return root


def collection_search(spark, sf):
    """The first points of one tenant's department for each query."""
    return V.search(P._asked(spark, sf), _collection(spark, sf), P.LIMIT, "t1", "it")


def collection_counts(spark, sf):
    """Points after the create, a second create (which changes nothing), the upsert, the same upsert again, a delete and a recreate, as pointers count them."""
    root, found = _root(spark, "collection"), []
    for step in ("create", "create again", "upsert", "upsert again", "delete", "recreate"):
        if step.startswith("create"):
            V.create(spark, root, 64)
        elif step.startswith("upsert"):
            V.upsert_points(_points(spark, sf), root)
        elif step == "delete":
            V.delete_points(spark, root, "t1", "7")
        else:
            V.recreate(spark, root, 64)
        found.append((step, V.count(spark, root)))
    return spark.createDataFrame(found, "step string, n long")


def collection_document(spark, sf):
    """The points that are left of each tenant's document after one is deleted."""
    root = _collection(spark, sf)
    V.delete_points(spark, root, "t1", "7")
    return V.points(spark, root).groupBy("tenant_id", "department", "document_id").agg(F.count("*").alias("n"))


STORED = ChunkConfig("fixed_size", size=40, overlap=10, least=5)


def _documents(spark, sf):
    return _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("tenant_id"), F.col("lang").alias("department"), "text")


def _persist(docs: DataFrame, root: str) -> DataFrame:
    docs = docs.withColumn("content_hash", F.sha2("text", 256))
    chunks = with_chunk_ids(fixed_size(docs, STORED), "fixed_size").withColumn("chunk_type", F.lit("text")).withColumn("token_count", F.col("token_count").cast("long"))
    return S.persist(docs.drop("text"), written(chunks.select(*[f.name for f in S.CHUNK if f.name != "bucket"]), "chunks"), root, {"size": STORED.size, "overlap": STORED.overlap})


def _two_batches(spark, sf) -> tuple[str, DataFrame]:
    """A store of the labelled documents, those of low quality in upper case; then of all documents as they are. Its root, and the second batch's statuses."""
    docs, labels = _documents(spark, sf), _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"), "quality")
    first = docs.join(labels, "document_id").withColumn("text", F.when(F.col("quality") == 0, F.upper("text")).otherwise(F.col("text"))).drop("quality")
    root = _root(spark, "chunk-store")
    _persist(first, root)
    return root, _persist(docs, root)


def chunk_store_statuses(spark, sf):
    return _two_batches(spark, sf)[1].groupBy("status").agg(F.count("*").alias("n"))


def chunk_store_chunks(spark, sf):
    """What the store holds of each document after both batches."""
    root = _two_batches(spark, sf)[0]
    own = S.load_chunks(spark, root).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    return own.join(S.load_manifests(spark, root).select("document_id", "total_chunks", F.col("strategy_counts")[0]["n"].alias("fixed")), "document_id")


def _catalog(spark, sf):
    """Every document as a record and its text as an object."""
    docs = _documents(spark, sf)
    records = D.catalog(_root(spark, "catalog"))
    none = F.lit(None).cast("string")
    D.create(records, docs.select("document_id", "tenant_id", "department", F.concat("document_id", F.lit(".txt")).alias("filename"), F.lit(".txt").alias("file_type"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("o/"), "document_id").alias("s3_key"), none.alias("status"), F.length("text").cast("long").alias("file_size"), F.lit(1).alias("version")))
    return records, docs


def catalog_states(spark, sf):
    """Documents whose processing gives chunks become ready, the others fail."""
    records, docs = _catalog(spark, sf)
    chunked = fixed_size(docs, STORED).select("document_id").distinct().withColumn("done", F.lit(True))
    D.settle(records, docs.join(chunked, "document_id", "left").select("document_id", F.when(F.col("done").isNull(), "no chunks").alias("error")))
    return records.read(spark).groupBy("department", "status").agg(F.count("*").alias("n"), F.sum("file_size").alias("size"))


def cascade_delete(spark, sf):
    """Admins ask for toxic documents of their tenant and, as another tenant's, for those of low quality; employees for all other labelled ones. What comes of it, and what is left."""
    records, docs = _catalog(spark, sf)
    files = D.objects(_root(spark, "objects"))
    files.put(docs.select(F.concat(F.lit("o/"), "document_id").alias("key"), F.encode("text", "UTF-8").alias("content")))
    owners = docs.select("document_id", "tenant_id")
    labels = _t(spark, sf, "labels").withColumn("document_id", F.col("doc_id").cast("string")).join(owners, "document_id")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    asked = labels.select(F.col("doc_id").alias("request_id"), F.when(bad, "admin").otherwise("employee").alias("role"), F.when(F.col("toxic") == 1, F.col("tenant_id")).otherwise("elsewhere").alias("tenant_id"), "document_id")
    found = D.delete_documents(asked, records, files=files).groupBy("outcome").agg(F.count("*").alias("n"))
    left = records.read(spark).agg(F.lit("records left").alias("outcome"), F.count("*").alias("n"))
    return found.union(left).union(files.read(spark).agg(F.lit("objects left"), F.count("*")))


def embedding_owner_issues(spark, sf):
    """Chunks of which equal texts have one id: whose vectors claim the least tenant and department of their id's chunks, and which repeat."""
    chunks = fixed_size(_documents(spark, sf), STORED).select("document_id", F.col("chunk_index").alias("position"), F.md5("chunk_text").alias("chunk_id"), "tenant_id", "department")
    chunks = written(chunks, "chunks")
    claimed = chunks.groupBy("chunk_id").agg(F.min("tenant_id").alias("tenant_id"), F.min("department").alias("department"))
    return X.counts(X.embedding_identity_issues(chunks, chunks.select("document_id", "position", "chunk_id").join(claimed, "chunk_id")))


def sql_chunks(spark, sf):
    """Chunks by SQL alone: a cleaner and a chunker in a SELECT."""
    registry.register(spark)
    _t(spark, sf, "documents").createOrReplaceTempView("documents")
    return select_only(spark, "SELECT d.doc_id, c.chunk_index, c.token_count, md5(c.chunk_text) AS digest FROM documents d, LATERAL chunk(d.text, 40, 10) c WHERE c.token_count >= 5")


def sql_cleaned(spark, sf):
    registry.register(spark)
    K._docs(spark, sf).withColumn("text", F.expr(K.NOISY)).createOrReplaceTempView("noisy")
    return select_only(spark, "SELECT doc_id, clean_text(text) AS clean_text FROM noisy")


def sql_packed(spark, sf):
    """Each document's lines packed to chunks of at most 60 tokens, by a table function over partitions."""
    registry.register(spark)
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit_id", "text"))
    lines.select("doc_id", F.col("unit_id").cast("long"), "text").createOrReplaceTempView("lines")
    found = select_only(spark, "SELECT * FROM pack_units(TABLE(SELECT * FROM lines) PARTITION BY (doc_id) ORDER BY (unit_id), 60)")
    # The function gives no key of its own, and a text is the same wherever it stands.
    return found.groupBy(F.md5("chunk_text").alias("digest"), "chunk_index", "first_unit", "last_unit", "token_count").agg(F.count("*").alias("n"))


def remembered_turns(spark, sf):
    """What each conversation remembers at each of its turns."""
    turns = _t(spark, sf, "conversations").select(F.lit("t").alias("tenant_id"), "conv_id", "turn", "role", "text")
    found = state.remember(turns)
    return found.select("conv_id", "turn", "remembered", F.md5(F.array_join(F.transform("history", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "|")).alias("digest"))


def cached_requests(spark, sf):
    """Events as requests of a cache by user: purchases and errors set a user's value, views ask for it."""
    kind = F.when(F.col("event_type").isin("purchase", "error"), "set").when(F.col("event_type") == "view", "get")
    asked = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("value")).where("kind is not null")
    return state.cache_answers(asked).groupBy("key").agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits"), F.count_if(F.col("value") == "error").alias("errors"))


def bad_json_lines(spark, sf):
    """Labels as JSON lines in one file, of which those of toxic documents are cut off and those of low quality are followed by a blank line: the places of the cut ones."""
    path = _root(spark, "lines")
    line = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, F.lit(', "qual')).otherwise(F.concat(F.lit(', "quality":'), "quality", F.lit("}"))), F.when(F.col("quality") == 0, F.lit("\n")).otherwise(F.lit("")))
    _t(spark, sf, "labels").repartition(1).sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return bad_lines(spark, path, "doc_id long, quality int").select("line", "value")


def line_round_trip(spark, sf):
    """Chunk rows written as JSON lines and read back with every line checked."""
    path = _root(spark, "lines")
    docs = _t(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("kind"))
    write_lines(docs, path)
    return read_checked_lines(spark, path, "doc_id long, kind string, text string").select("doc_id", "kind", F.md5("text").alias("digest"), token_count(F.col("text")).alias("tokens"))


def counted_write(spark, sf):
    """Orders written in folders by status, and what the writing tasks counted."""
    orders = _t(spark, sf, "orders")
    got = observed.write_counted(orders, _root(spark, "orders"), {"keys": F.sum("o_orderkey")}, {"o_orderstatus": ["F", "O"]}, ["o_orderstatus"])
    return spark.createDataFrame([(name, int(n)) for name, n in got.items()], "figure string, n long")


QUERIES = {
    f.__name__: f
    for f in (indexed_topk, indexed_recall, indexed_whole, indexed_lists, collection_search, collection_counts, collection_document, chunk_store_statuses, chunk_store_chunks, catalog_states, cascade_delete, embedding_owner_issues, sql_chunks, sql_cleaned, sql_packed, remembered_turns, cached_requests, bad_json_lines, line_round_trip, counted_write)
}

_POINTS = "p AS (SELECT vec_id AS doc_id, coalesce(label, -1)::VARCHAR AS document_id, 't' || (coalesce(label, -1) % 3) AS tenant_id, CASE WHEN coalesce(label, -1) % 2 = 0 THEN 'hr' ELSE 'it' END AS department, embedding::DOUBLE[] AS vector FROM embeddings)"
_SMALL = f"{K._DOCS}, {K._windows('d', 40, 10, 5)}"
ORACLE = {
    "indexed_recall": f"SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % {P.ASKED} = 0",
    "indexed_whole": f"WITH {P._DENSE} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds WHERE lane = '1') WHERE rank <= 10",
    "indexed_lists": "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, sum(vec_id)::BIGINT AS total FROM embeddings",
    "collection_search": f"WITH {P._DENSE}, {_POINTS} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds JOIN p USING (doc_id) WHERE tenant_id = 't1' AND department = 'it') WHERE rank <= 10",
    "collection_counts": f"WITH {_POINTS}, n AS (SELECT count(*) AS n, count(*) FILTER (NOT (tenant_id = 't1' AND document_id = '7')) AS kept FROM p) SELECT 'create' AS step, 0::BIGINT AS n UNION ALL SELECT 'create again', 0 UNION ALL SELECT 'upsert', n FROM n UNION ALL SELECT 'upsert again', n FROM n UNION ALL SELECT 'delete', kept FROM n UNION ALL SELECT 'recreate', 0",
    "collection_document": f"WITH {_POINTS} SELECT tenant_id, department, document_id, count(*) AS n FROM p WHERE NOT (tenant_id = 't1' AND document_id = '7') GROUP BY ALL",
    "chunk_store_statuses": f"WITH {_SMALL}, has AS (SELECT DISTINCT doc_id FROM w) SELECT CASE WHEN has.doc_id IS NULL THEN 'REFUSED_ZERO_CHUNKS' WHEN l.doc_id IS NULL THEN 'WRITTEN' WHEN quality = 0 AND upper(text) <> text THEN 'REBUILT' ELSE 'SKIPPED_UP_TO_DATE' END AS status, count(*) AS n FROM documents LEFT JOIN has USING (doc_id) LEFT JOIN labels l USING (doc_id) GROUP BY ALL",
    "chunk_store_chunks": f"WITH {_SMALL} SELECT doc_id::VARCHAR AS document_id, count(*) AS chunks, sum(units)::BIGINT AS tokens, count(*) AS total_chunks, count(*) AS fixed FROM w GROUP BY doc_id",
    "catalog_states": f"WITH {_SMALL}, has AS (SELECT DISTINCT doc_id, true AS done FROM w) SELECT lang AS department, CASE WHEN done THEN 'READY' ELSE 'FAILED' END AS status, count(*) AS n, sum(length(text))::BIGINT AS size FROM documents LEFT JOIN has USING (doc_id) GROUP BY ALL",
    "cascade_delete": """WITH o AS (SELECT CASE WHEN toxic = 1 THEN 'DELETED' ELSE 'DENIED' END AS outcome FROM labels JOIN documents USING (doc_id)), k AS (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
      SELECT outcome, count(*) AS n FROM o GROUP BY outcome UNION ALL SELECT 'records left', n FROM k UNION ALL SELECT 'objects left', n FROM k""",
    "embedding_owner_issues": f"""WITH {_SMALL}, {K._INDEXED}, e AS (SELECT doc_id::VARCHAR AS document_id, chunk_index AS position, md5(chunk_text) AS chunk_id, source AS tenant_id, lang AS department FROM c JOIN documents USING (doc_id)),
      g AS (SELECT *, min(tenant_id) OVER g AS t, min(department) OVER g AS d, min(document_id) OVER g AS f, min(position) OVER (PARTITION BY chunk_id, document_id) AS p FROM e WINDOW g AS (PARTITION BY chunk_id)),
      i AS (SELECT unnest([CASE WHEN t <> tenant_id THEN 'TENANT_MISMATCH' END, CASE WHEN d <> department THEN 'DEPARTMENT_MISMATCH' END, CASE WHEN position > p THEN 'DUPLICATE_LOCAL_EMBEDDING' END, CASE WHEN position > p OR document_id > f THEN 'DUPLICATE_GLOBAL_EMBEDDING' END]) AS code FROM g)
      SELECT 'ERROR' AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY code""",
    "sql_chunks": f"WITH {_SMALL}, {K._INDEXED} SELECT doc_id, chunk_index, units AS token_count, md5(chunk_text) AS digest FROM c",
    "sql_cleaned": K.ORACLE["clean_text"],
    "sql_packed": r"""WITH RECURSIVE u AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, k - 1 AS unit_id, line, len(regexp_extract_all(line, '\S+')) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents) WHERE regexp_matches(line, '\S')
    ), pack AS (
      SELECT doc_id, i, n AS tokens, 0 AS chunk_index FROM u WHERE i = 1
      UNION ALL SELECT u.doc_id, u.i, CASE WHEN pack.tokens + u.n > 60 THEN u.n ELSE pack.tokens + u.n END, pack.chunk_index + CASE WHEN pack.tokens + u.n > 60 THEN 1 ELSE 0 END
      FROM pack JOIN u ON u.doc_id = pack.doc_id AND u.i = pack.i + 1
    ), c AS (
      SELECT doc_id, chunk_index, min(unit_id) AS first_unit, max(unit_id) AS last_unit, sum(n)::INT AS token_count, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM pack JOIN u USING (doc_id, i) GROUP BY doc_id, chunk_index
    ) SELECT digest, chunk_index, first_unit, last_unit, token_count, count(*) AS n FROM c GROUP BY ALL""",
    "remembered_turns": "SELECT conv_id, turn, count(*) OVER w AS remembered, md5(string_agg(role || ':' || text, '|') OVER w) AS digest FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "cached_requests": "WITH r AS (SELECT user_id::VARCHAR AS key, event_type, last_value(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS had FROM events WHERE event_type IN ('purchase', 'error', 'view')) SELECT key, count(*) AS asked, count(had) AS hits, count(*) FILTER (had = 'error') AS errors FROM r WHERE event_type = 'view' GROUP BY key",
    "bad_json_lines": """WITH l AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) + coalesce(sum((quality = 0)::INT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line FROM labels)
      SELECT line, '{"doc_id":' || doc_id || ', "qual' AS value FROM l WHERE toxic = 1""",
    "line_round_trip": f"SELECT doc_id, lang AS kind, md5(text) AS digest, {P._TOKENS} AS tokens FROM documents",
    "counted_write": "SELECT 'rows' AS figure, count(*) AS n FROM orders UNION ALL SELECT 'keys', sum(o_orderkey)::BIGINT FROM orders UNION ALL SELECT 'o_orderstatus=F', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o_orderstatus=O', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'o_orderstatus=other', count(*) FROM orders WHERE coalesce(o_orderstatus, '') NOT IN ('F', 'O')",
}
