"""Retrieval, fusion, reranking and context queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gneiss.functions.text import STOP_WORDS
from gneiss.operators import context as C, evaluation as E, retrieval as R, stores
from gneiss.operators.sparse_index import sparse_index
from gneiss.shared import written

LIMIT = 10
#: The stated set of query vectors: the rows of embeddings whose id this divides, against all rows.
ASKED = 50
GRID = [(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (3.0, 1.0), (1.0, 3.0), (1.0, 0.0), (0.0, 1.0), (1.0, 0.5)]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("tenant_id"), F.col("lang").alias("department"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Every third query may see all departments, the others two; every second is of one tenant."""
    wide = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("en"), F.lit("fr")))
    return _queries(spark, sf).withColumns({"departments": wide, "tenant_id": F.when(F.col("query_id") % 2 == 0, F.lit("src0"))})


def bm25_idf(spark, sf):
    """Document frequency and weight of all terms."""
    index = sparse_index(_docs(spark, sf))
    return index.idf.select("term", "df", F.round("idf", 6).alias("idf"))


def _sparse(spark, sf, queries=None, limit=None) -> DataFrame:
    return R.sparse_scores(sparse_index(_docs(spark, sf)), _queries(spark, sf) if queries is None else queries, limit=limit)


def bm25_topk(spark, sf):
    return R.ranked(_sparse(spark, sf, limit=LIMIT), LIMIT, "doc_id")


def bm25_scoped(spark, sf):
    queries = _scopes(spark, sf)
    hits = R.scoped(_sparse(spark, sf), _docs(spark, sf), queries)
    return R.per_department(hits, LIMIT, True).select("query_id", "doc_id", "department", "score", "rank")


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), (F.col("label") % 4).alias("lane"))


def _asked(spark, sf):
    return _vectors(spark, sf).where(F.col("doc_id") % ASKED == 0).select(F.col("doc_id").alias("query_id"), "vector")


def dense_topk(spark, sf):
    return R.ranked(R.dense_scores(_vectors(spark, sf), _asked(spark, sf), LIMIT), LIMIT, "doc_id")


def dense_dot(spark, sf):
    return R.ranked(R.dense_scores(_vectors(spark, sf), _asked(spark, sf), LIMIT, "dot"), LIMIT, "doc_id")


def dense_euclid(spark, sf):
    return R.ranked(R.dense_scores(_vectors(spark, sf), _asked(spark, sf), LIMIT, "euclid"), LIMIT, "doc_id")


def dense_scoped(spark, sf):
    """Of each query's two departments the first rows each, together and not cut again."""
    hits = R.dense_scores(_vectors(spark, sf), _asked(spark, sf), 5, lane="lane")
    hits = hits.where(F.col("lane").isin("0", "1")).withColumn("departments", F.array(F.lit("0"), F.lit("1")))
    return R.per_department(hits.withColumnRenamed("lane", "department"), 5, False).select("query_id", "doc_id", "department", "score", "rank")


def score_threshold(spark, sf):
    return R.dense_scores(_vectors(spark, sf), _asked(spark, sf), least=0.5)


def _dense(spark, sf):
    """The documents by the stand-in embedder, ranked for each item."""
    vectors = _docs(spark, sf).select("doc_id", stores.hashing_embedder(F.col("text")).alias("vector"))
    asked = _queries(spark, sf).select("query_id", stores.hashing_embedder(F.col("query")).alias("vector"))
    return R.ranked(R.dense_scores(vectors, asked, LIMIT), LIMIT, "doc_id")


def _two_lists(spark, sf):
    """The dense and the sparse ranking of the documents, each with candidates of its own; written, since many queries read them more than once."""
    return tuple(written(hits.select("query_id", "doc_id", "rank"), "ranked") for hits in (_dense(spark, sf), bm25_topk(spark, sf)))


def rrf_fusion(spark, sf):
    return R.fuse(list(_two_lists(spark, sf)), LIMIT)


def fusion_grid(spark, sf):
    """Mean reciprocal rank and recall of each pair of weights; relevant are the documents that contain the item."""
    lists, relevant = _two_lists(spark, sf), _relevant(spark, sf)
    out = None
    for dense, sparse in GRID:
        found = R.fuse(list(lists), LIMIT, weights=[dense, sparse])
        first = relevant.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
        row = first.agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("first").alias("hit")).select(F.lit(dense).alias("dense_weight"), F.lit(sparse).alias("sparse_weight"), "mrr", "hit")
        out = row if out is None else out.union(row)
    return out


def _relevant(spark, sf) -> DataFrame:
    """(query_id, doc_id) of documents that hold the item's text."""
    return written(R.containing(_docs(spark, sf), _queries(spark, sf)), "relevant")


def recall_mrr(spark, sf):
    hits, relevant = bm25_topk(spark, sf), _relevant(spark, sf)
    found = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("found"))
    own = relevant.groupBy("query_id").agg(F.collect_list("doc_id").alias("own"))
    both = own.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    return both.select("query_id", *[F.round(E.recall_at(F.col("found"), F.col("own"), k), 6).alias(f"recall_{k}") for k in (1, 3, 5)], F.round(E.reciprocal_rank(F.col("found"), F.col("own")), 6).alias("rr"))


def retriever_means(spark, sf):
    each = recall_mrr(spark, sf)
    return each.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_3", "recall_5")], F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("queries"))


def failure_taxonomy(spark, sf):
    other, sparse = _two_lists(spark, sf)
    relevant, hybrid = _relevant(spark, sf), R.fuse([other, sparse], 3)
    first = lambda hits, name: relevant.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias(name))
    every = _queries(spark, sf).select("query_id")
    for hits, name in ((other.where("rank <= 5"), "dense"), (sparse.where("rank <= 5"), "sparse"), (hybrid, "hybrid")):
        every = every.join(first(hits, name), "query_id", "left")
    return every.select("query_id", E.failure(F.col("dense"), F.col("sparse"), F.col("hybrid")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def _hit_texts(spark, sf) -> DataFrame:
    return bm25_topk(spark, sf).join(_docs(spark, sf), "doc_id").join(_queries(spark, sf), "query_id")


def rerank_overlap(spark, sf):
    hits = R.rerank(_hit_texts(spark, sf), R.overlap_score(F.col("query"), F.col("text")))
    return hits.select("query_id", "doc_id", "rerank_score", "new_rank")


def document_ranks(spark, sf):
    """Hits ranked by tenant instead of document: each at its first place."""
    return R.document_ranks(_hit_texts(spark, sf), "tenant_id")


def sources_list(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("rank", "tenant_id")))
    return _hit_texts(spark, sf).groupBy("query_id").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["tenant_id"])), ",").alias("sources"))


def context_budget(spark, sf):
    return C.build_context(_hit_texts(spark, sf).select("query_id", "rank", "doc_id", "text"), 1500).select("query_id", "position", "doc_id", "tokens")


def context_totals(spark, sf):
    return context_budget(spark, sf).groupBy("query_id").agg(F.count("*").alias("chunks"), F.sum("tokens").cast("long").alias("tokens"))


def prompt_blocks(spark, sf):
    hits = _hit_texts(spark, sf).where("rank <= 3")
    rows = F.sort_array(F.collect_list(F.struct("rank", F.col("tenant_id").alias("source"), "text")))
    made = hits.groupBy("query_id", "query").agg(rows.alias("rows"))
    return made.select("query_id", F.sha2(C.prompt(F.col("query"), F.col("rows")), 256).alias("prompt_sha256"), F.char_length(C.prompt(F.col("query"), F.col("rows"))).alias("chars"))


def term_overlap_select(spark, sf):
    """The three lines of each first hit that share most terms with its query; lines are made paragraphs."""
    hits = _hit_texts(spark, sf).where("rank = 1").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return hits.select("query_id", C.select_units(F.col("query"), F.col("text")).alias("content"))


def memory_window(spark, sf):
    turns = C.paired_turns(_t(spark, sf, "conversations")).withColumnsRenamed({"conv_id": "conversation_id"}).withColumn("tenant_id", F.lit("t"))
    return C.memory(turns, 5, 1500).select("conversation_id", "position", "turn_no", F.sha2(F.concat("user_message", "assistant_message"), 256).alias("digest"))


def query_terms(spark, sf):
    from gneiss.functions.text import terms

    return _queries(spark, sf).select("query_id", F.array_join(terms(F.col("query")), ",").alias("terms"))


QUERIES = {f.__name__: f for f in (bm25_idf, bm25_topk, bm25_scoped, dense_topk, dense_dot, dense_euclid, dense_scoped, score_threshold, rrf_fusion, fusion_grid, recall_mrr, retriever_means, failure_taxonomy, rerank_overlap, document_ranks, sources_list, context_budget, context_totals, prompt_blocks, term_overlap_select, memory_window, query_terms)}

_BM25 = r"""d AS MATERIALIZED (SELECT doc_id, text, source AS tenant_id, lang AS department, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM d),
post AS MATERIALIZED (SELECT doc_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
mean AS (SELECT avg(raw) AS m FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mean),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM q) GROUP BY ALL),
scores AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN qt USING (term) JOIN idf USING (term), stats GROUP BY ALL) WHERE score <> 0),
top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10)"""
#: Counts of words by their MD5, modulo 64, of the rows of a table; and the dense ranking by their cosine beside the sparse one.
_EMBEDDED = lambda t, key, x="": f"""{x}wb AS (SELECT {key} AS doc_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS b FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {t})),
  {x}v AS (SELECT doc_id, b, count(*)::DOUBLE AS n FROM {x}wb GROUP BY ALL), {x}vn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM {x}v GROUP BY doc_id)"""  # noqa: E731
_TWO = f"""{_EMBEDDED('documents', 'doc_id')}, {_EMBEDDED('benchmark', 'item_id', 'q')}, vs AS (SELECT v.doc_id, qv.doc_id AS query_id, sum(v.n * qv.n) AS dot FROM v JOIN qv USING (b) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(dot / (vn.norm * qvn.norm), 6) AS score FROM vs JOIN vn USING (doc_id) JOIN qvn ON qvn.doc_id = query_id),
other AS MATERIALIZED (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10),
sparse AS (SELECT query_id, doc_id, rank FROM top)"""
_RELEVANT = "rel AS (SELECT DISTINCT query_id, doc_id FROM q, d WHERE contains(d.text, q.query))"


def _fused(name: str, limit: int, w: tuple[float, float] = (1.0, 1.0)) -> str:
    return f"""{name}_s AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS first FROM (SELECT *, 0 AS l, {w[0]}::DOUBLE AS w FROM other UNION ALL SELECT *, 1, {w[1]}::DOUBLE FROM sparse) GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM {name}_s) WHERE rank <= {limit})"""


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
_DENSE = f"""v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vector, (label % 4)::VARCHAR AS lane FROM embeddings), a AS (SELECT doc_id AS query_id, vector AS asked FROM v WHERE doc_id % {ASKED} = 0),
ds AS (SELECT query_id, doc_id, lane, round(list_cosine_similarity(asked, vector), 6) AS score, round(list_dot_product(asked, vector), 6) AS dot FROM v, a)"""
_HITS = "hits AS (SELECT top.query_id, top.doc_id, rank, score, d.text, d.tenant_id, q.query FROM top JOIN d USING (doc_id) JOIN q USING (query_id))"
_RECALL = lambda k: f"round(count(*) FILTER (rank <= {k}) / max(n), 6) AS recall_{k}"
_EACH = f"""each AS (SELECT query_id, {_RECALL(1)}, {_RECALL(3)}, {_RECALL(5)}, round(coalesce(1 / min(rank), 0), 6) AS rr
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM rel) LEFT JOIN top USING (query_id, doc_id) GROUP BY query_id)"""
_TOKENS = r"len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
_NORM = r"trim(regexp_replace(lower(text), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
_CONTEXT = f"""rows AS (SELECT query_id, rank, doc_id, {_TOKENS} AS tokens, {_NORM} AS norm FROM hits),
fold AS (
  SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS total, 0 AS n, []::VARCHAR[] AS seen, NULL::BIGINT AS doc_id, NULL::BIGINT AS tokens, false AS taken FROM (SELECT DISTINCT query_id FROM rows)
  UNION ALL
  SELECT f.query_id, r.rank, CASE WHEN NOT list_contains(f.seen, r.norm) AND r.tokens > 0 AND f.total + r.tokens <= 1500 THEN f.total + r.tokens ELSE f.total END,
    CASE WHEN NOT list_contains(f.seen, r.norm) AND r.tokens > 0 AND f.total + r.tokens <= 1500 THEN f.n + 1 ELSE f.n END,
    CASE WHEN list_contains(f.seen, r.norm) THEN f.seen ELSE list_append(f.seen, r.norm) END, r.doc_id, r.tokens,
    NOT list_contains(f.seen, r.norm) AND r.tokens > 0 AND f.total + r.tokens <= 1500
  FROM fold f JOIN rows r ON r.query_id = f.query_id AND r.rank = f.rank + 1
), ctx AS (SELECT query_id, n - 1 AS position, doc_id, tokens FROM fold WHERE taken)"""
ORACLE = {
    "bm25_idf": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM top",
    "bm25_scoped": f"""WITH {_BM25}, s AS (SELECT query_id, doc_id, department, score, CASE WHEN query_id % 3 = 0 THEN '*' ELSE department END AS lane FROM scores JOIN d USING (doc_id)
      WHERE (query_id % 2 = 1 OR tenant_id = 'src0') AND (query_id % 3 = 0 OR department IN ('en', 'fr'))),
      l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, doc_id) AS p FROM s) WHERE p <= 10)
      SELECT * FROM (SELECT query_id, doc_id, department, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM l) WHERE rank <= 10""",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 10",
    "dense_euclid": f"WITH {_DENSE}, de AS (SELECT a.query_id, v.doc_id, round(-list_distance(asked, vector), 6) + 0.0 AS score FROM v, a) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM de) WHERE rank <= 10",
    "dense_dot": f"WITH {_DENSE} SELECT * FROM (SELECT query_id, doc_id, dot AS score, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, doc_id) AS rank FROM ds) WHERE rank <= 10",
    "dense_scoped": f"""WITH {_DENSE}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, doc_id) AS p FROM ds WHERE lane IN ('0', '1')) WHERE p <= 5)
      SELECT query_id, doc_id, lane AS department, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM l""",
    "score_threshold": f"WITH {_DENSE} SELECT query_id, doc_id, score FROM ds WHERE score >= 0.5",
    "rrf_fusion": f"WITH {_BM25}, {_TWO}, {_fused('f', 10)} SELECT * FROM f",
    "fusion_grid": f"WITH {_BM25}, {_TWO}, {_RELEVANT}, {', '.join(_fused(f'f{k}', 10, w) for k, w in enumerate(GRID))} "
    + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS dense_weight, {b}::DOUBLE AS sparse_weight, round(avg(coalesce(1 / first, 0)), 6) AS mrr, count(first) AS hit FROM (SELECT query_id, min(rank) AS first FROM rel LEFT JOIN f{k} USING (query_id, doc_id) GROUP BY query_id)" for k, (a, b) in enumerate(GRID)),
    "recall_mrr": f"WITH {_BM25}, {_RELEVANT}, {_EACH} SELECT * FROM each",
    "retriever_means": f"WITH {_BM25}, {_RELEVANT}, {_EACH} SELECT round(avg(recall_1), 6) AS recall_1, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(avg(rr), 6) AS mrr, count(*) AS queries FROM each",
    "failure_taxonomy": f"""WITH {_BM25}, {_TWO}, {_RELEVANT}, {_fused('f', 3)},
      r AS (SELECT query_id, (SELECT min(rank) FROM rel JOIN other USING (query_id, doc_id) WHERE rel.query_id = q.query_id AND rank <= 5) AS de, (SELECT min(rank) FROM rel JOIN sparse USING (query_id, doc_id) WHERE rel.query_id = q.query_id AND rank <= 5) AS sp,
        (SELECT min(rank) FROM rel JOIN f USING (query_id, doc_id) WHERE rel.query_id = q.query_id) AS hy FROM q)
      SELECT CASE WHEN hy = 1 THEN 'success_rank_1' WHEN hy IS NOT NULL THEN 'success_low_rank' WHEN de IS NULL AND sp IS NULL THEN 'both_retrievers_miss' WHEN de IS NULL THEN 'dense_miss_fusion_failure'
        WHEN sp IS NULL THEN 'sparse_miss_fusion_failure' ELSE 'fusion_ranking_failure' END AS category, count(*) AS n FROM r GROUP BY ALL""",
    "rerank_overlap": f"""WITH {_BM25}, {_HITS}, s AS (SELECT query_id, doc_id, rank, CASE WHEN len({_TERMS('query')}) > 0 THEN round(len(list_intersect(list_distinct({_TERMS('query')}), list_distinct({_TERMS('text')}))) / len(list_distinct({_TERMS('query')})), 6) ELSE 0.0 END AS rerank_score FROM hits),
      k AS (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best FROM s)
      SELECT * FROM (SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM k WHERE rerank_score >= 0.1 * best) WHERE new_rank <= 5""",
    "document_ranks": f"WITH {_BM25}, {_HITS} SELECT query_id, tenant_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM (SELECT query_id, tenant_id, min(rank) AS first FROM hits GROUP BY ALL)",
    "sources_list": f"WITH {_BM25}, {_HITS} SELECT query_id, string_agg(tenant_id, ',' ORDER BY first) AS sources FROM (SELECT query_id, tenant_id, min(rank) AS first FROM hits GROUP BY ALL) GROUP BY query_id",
    "context_budget": f"WITH RECURSIVE {_BM25}, {_HITS}, {_CONTEXT} SELECT * FROM ctx",
    "context_totals": f"WITH RECURSIVE {_BM25}, {_HITS}, {_CONTEXT} SELECT query_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM ctx GROUP BY query_id",
    "prompt_blocks": f"""WITH {_BM25}, {_HITS}, p AS (SELECT query_id, 'Answer from the documents only and cite their sources in brackets.' || chr(10) || chr(10) || 'Documents:' || chr(10) ||
      string_agg('<document id="' || rank || '" source="' || tenant_id || '">' || chr(10) || text || chr(10) || '</document>', chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM hits WHERE rank <= 3 GROUP BY query_id, query)
      SELECT query_id, sha256(prompt) AS prompt_sha256, length(prompt) AS chars FROM p""",
    "term_overlap_select": f"""WITH {_BM25}, {_HITS}, u AS (SELECT query_id, query, trim(u, ' ') AS u, k FROM (SELECT query_id, query, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM hits WHERE rank = 1) WHERE trim(u, ' ') <> ''),
      s AS (SELECT *, len(list_intersect(list_distinct({_TERMS('query')}), list_distinct({_TERMS('u')}))) AS n FROM u), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, k) AS place, max(n) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY k) AS first FROM s)
      SELECT query_id, string_agg(u, chr(10) || chr(10) ORDER BY k) AS content FROM b WHERE (top > 0 AND n > 0 AND place <= 3) OR (top = 0 AND first <= 3) GROUP BY query_id""",
    "memory_window": """WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      t AS (SELECT conv_id, turn, text || nt AS bth, length(text) + length(nt) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM m WHERE role = 'user' AND nr = 'assistant'),
      f AS (SELECT conv_id, 0::BIGINT AS age, 0::BIGINT AS total, NULL::BIGINT AS turn, NULL::VARCHAR AS bth, false AS taken FROM (SELECT DISTINCT conv_id FROM t)
        UNION ALL SELECT f.conv_id, t.age, CASE WHEN t.size > 0 AND total + t.size <= 1500 THEN total + t.size ELSE total END, t.turn, t.bth, t.size > 0 AND total + t.size <= 1500 FROM f JOIN t ON t.conv_id = f.conv_id AND t.age = f.age + 1 AND t.age <= 5)
      SELECT conv_id AS conversation_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position, turn AS turn_no, sha256(bth) AS digest FROM f WHERE taken""",
    "query_terms": f"SELECT query_id, string_agg(t, ',' ORDER BY k) AS terms FROM (SELECT query_id, t, min(k) AS k FROM (SELECT item_id AS query_id, unnest({_TERMS('text')}) AS t, generate_subscripts({_TERMS('text')}, 1) AS k FROM benchmark) GROUP BY ALL) GROUP BY query_id",
}
