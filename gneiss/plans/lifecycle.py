"""Queries of cleaning, deletes, appends, filters, round trips and parsers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import context as C, evaluation as E, lifecycle as L, retrieval as R, sparse_index as X, validation as V
from gneiss.operators.answers import contextualised
from gneiss.plans import corpus as K, retrieval as P, tables as Q
from gneiss.shared import shared_dir, written
from gneiss.sources.files import html_columns, parse_files

_CELL = "concat(' ', chr(9), {}, chr(1), '  x ')"


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def document_clean(spark, sf):
    """Documents of which each second has its lines as pages, and each third a table with white space in its cells."""
    n = F.col("doc_id")
    lines = F.transform(F.split(F.expr(K.NOISY), "\n"), lambda x, k: F.struct((k + 1).alias("page_number"), x.alias("text")))
    none = F.slice(lines, 1, 0)
    row = F.array(F.expr(_CELL.format("lang")), F.lit(None).cast("string"))
    table = F.array(F.struct(F.lit("t").alias("table_id"), F.array(F.expr(_CELL.format("source")), F.lit("b")).alias("headers"), F.array(row, row).alias("rows")))
    docs = _t(spark, sf, "documents").select("doc_id", F.expr(K.NOISY).alias("raw_text"), F.when(n % 2 == 0, lines).otherwise(none).alias("pages"), F.when(n % 3 == 0, table).otherwise(F.slice(table, 1, 0)).alias("tables"))
    found = L.clean_documents(docs)
    return found.select("doc_id", F.md5("clean_text").alias("digest"), F.size("pages").alias("pages"), F.array_join(F.get("tables", F.lit(0))["headers"], "|").alias("headers"), F.array_join(F.get("tables", F.lit(0))["rows"][1], "|", "null").alias("row"), F.array_join("cleaning_steps", ",").alias("steps"))


def _points(spark, sf):
    return _t(spark, sf, "documents").select((F.col("doc_id") % 50).cast("string").alias("document_id"), F.col("source").alias("tenant_id"), "doc_id")


def deleted_document(spark, sf):
    """What is left of points after one tenant's document is deleted."""
    return L.delete_document(_points(spark, sf), F.lit("7"), F.lit("src0"))


def cacheable_answers(spark, sf):
    answers = Q._answers(spark, sf)
    return answers.groupBy(L.cacheable(F.col("answer"), E.citations(F.col("answer")), F.col("doc_id") % 3 > 0).alias("cacheable")).agg(F.count("*").alias("n"))


def cache_store(spark, sf):
    """Labelled documents as cached answers, and documents of three kinds of departments put over them."""
    n = F.col("doc_id")
    stored = _t(spark, sf, "labels").select(n.alias("entry_id"), F.array(F.lit("old")).alias("answer_departments"))
    fresh = _t(spark, sf, "documents").select(n.alias("entry_id"), F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array("lang")).alias("answer_departments"))
    return L.cache_insert(stored, fresh).select("entry_id", F.array_join("answer_departments", ",").alias("departments"))


def ocr_failures(spark, sf):
    warnings = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("x"), F.lit("OCR failed: no engine"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("OCR returned no text"))).otherwise(F.array(F.lit("ocr failed")))
    pages = F.array(F.struct(F.lit(1).alias("page_number"), warnings.alias("warnings")), F.struct(F.lit(2).alias("page_number"), F.when(F.col("doc_id") % 8 == 0, warnings).otherwise(F.array().cast("array<string>")).alias("warnings")))
    return L.failed_pages(_t(spark, sf, "documents").select("doc_id", pages.alias("pages"))).select("doc_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def missed_chunks(spark, sf):
    """The chunks of documents that some item should have found."""
    chunks = K._chunk_rows(spark, sf).withColumn("filename", F.col("doc_id").cast("string"))
    return L.relevant_chunks(chunks, P._relevant(spark, sf).select(F.col("doc_id").cast("string").alias("filename"))).select("doc_id", "chunk_index")


def indexable_orders(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "READY").otherwise("FAILED")
    return L.indexable(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), status.alias("status")))


def normalised_lists(spark, sf):
    """The line numbers of each order's parts, sorted and once each, and the words of each document's first line in order, once each."""
    words = F.split(F.substring_index("text", "\n", 1), " ")
    numbers = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.length(w))
    return _t(spark, sf, "documents").select("doc_id", F.array_join(T.distinct_texts(words), " ").alias("words"), F.array_join(F.transform(T.sorted_numbers(numbers), lambda n: n.cast("string")), ",").alias("lengths"))


def _grid(spark, sf):
    """Recall and reciprocal rank of each pair of weights of two rankings."""
    lists, relevant = P._two_lists(spark, sf), P._relevant(spark, sf)
    out = None
    for k, (a, b) in enumerate(P.GRID):
        own = _means(R.fuse(list(lists), 5, weights=[a, b]), relevant).withColumn("place", F.lit(k))
        out = own if out is None else out.union(own)
    return out


def _means(hits, relevant):
    """Means over queries of recall at 1, 3 and 5 and of the reciprocal rank of ranked hits (query_id, doc_id, rank)."""
    met = relevant.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    each = met.groupBy("query_id").agg(*[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"r{k}") for k in (1, 3, 5)], F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return each.agg(*[F.round(F.avg(f"r{k}"), 6).alias(f"recall_{k}") for k in (1, 3, 5)], F.round(F.avg("rr"), 6).alias("mrr"))


def best_weights(spark, sf):
    return L.best_configuration(_grid(spark, sf), "place")


def retriever_comparison(spark, sf):
    """The two rankings, their fusion and the reranked fusion, by means of recall and reciprocal rank; the reranked list isn't cleared of repeated documents."""
    other, sparse = P._two_lists(spark, sf)
    fused = written(R.fuse([other, sparse], 10), "fused")
    texts = fused.join(P._docs(spark, sf).select("doc_id", "text"), "doc_id").join(P._queries(spark, sf), "query_id")
    reranked = R.rerank(texts, R.overlap_score(F.col("query"), F.col("text"))).select("query_id", "doc_id", F.col("new_rank").alias("rank"))
    relevant, out = P._relevant(spark, sf), None
    for name, hits in (("other", other), ("sparse", sparse), ("fused", fused), ("reranked", reranked)):
        own = _means(hits.where("rank <= 5"), relevant).withColumn("retriever", F.lit(name))
        out = own if out is None else out.union(own)
    return out


def _turns(spark, sf):
    return C.paired_turns(_t(spark, sf, "conversations")).select(F.lit("t").alias("tenant_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn_no").cast("long").alias("turn_no"), "user_message", "assistant_message")


def added_turns(spark, sf):
    """Each document said in one of the conversations, or a new one, after what they had; each seventh has a blank answer and is left out."""
    n = F.col("doc_id")
    fresh = _t(spark, sf, "documents").select(F.lit(" t ").alias("tenant_id"), (n % 97).cast("string").alias("conversation_id"), F.concat(F.lit(" q"), n, F.lit("\n")).alias("user_message"), F.when(n % 7 == 0, F.lit(" \t")).otherwise(F.lit("ok")).alias("assistant_message"), n.alias("at"))
    return L.add_turns(_turns(spark, sf), fresh, "at").select("conversation_id", "turn_no", F.md5(F.concat("user_message", F.lit("|"), "assistant_message")).alias("digest"))


def rejected_turns(spark, sf):
    n = F.col("doc_id")
    fresh = _t(spark, sf, "documents").select("doc_id", F.when(n % 2 == 0, F.lit("t")).alias("tenant_id"), F.lit("c").alias("conversation_id"), F.when(n % 3 == 0, F.lit("")).otherwise(F.lit("q")).alias("user_message"), F.lit("a").alias("assistant_message"))
    return L.rejected_turns(fresh).select("doc_id")


def cleared_conversations(spark, sf):
    turns = _turns(spark, sf)
    return L.clear_conversations(turns, turns.where(F.col("conversation_id").cast("long") % 3 == 0)).select("conversation_id", "turn_no")


def round_trip(spark, sf):
    """Chunks as written and read back, of which some documents' are lost, changed, repeated or new."""
    rows = K._chunk_rows(spark, sf).select("chunk_id", "doc_id", "chunk_text")
    n = F.col("doc_id")
    stored = rows.where(n % 5 != 0).withColumn("chunk_text", F.when(n % 7 == 0, F.concat("chunk_text", F.lit("x"))).otherwise(F.col("chunk_text")))
    stored = stored.unionByName(stored.where(n % 11 == 0)).unionByName(rows.where(n % 13 == 0).withColumn("chunk_id", F.concat("chunk_id", F.lit("new"))))
    return V.counts(L.round_trip_issues(rows, written(stored, "stored"), "chunk_id"))


def unpaired_documents(spark, sf):
    return L.unpaired(_t(spark, sf, "documents").where("doc_id % 3 <> 1").select("doc_id"), _t(spark, sf, "labels").select("doc_id"), "doc_id").select("subject", "code")


def request_issues(spark, sf):
    made = F.when(F.col("item_id") % 4 == 0, F.lit("")).when(F.col("item_id") % 4 == 1, F.lit(None)).when(F.col("item_id") % 4 == 2, F.lit(" ")).otherwise(F.col("text"))
    return L.request_issues(_t(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), made.alias("query"))).select("subject", "code")


def rewrite_statistics(spark, sf):
    n = F.col("item_id")
    made = F.when(n % 4 == 0, F.lit("a <task> b")).otherwise(F.concat(F.lit("more "), "text"))
    found = _t(spark, sf, "benchmark").select("text", contextualised(F.col("text"), F.when(n % 5 == 0, "").otherwise("said before"), made).alias("c"))
    return L.rewrite_statistics(found.select("c.rewritten", T.token_count(F.col("text")).alias("original_tokens"), T.token_count(F.col("c.query")).alias("query_tokens")))


def ensured_names(spark, sf):
    """Nations put to the regions' names where they aren't there yet."""
    stored = _t(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    wanted = _t(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit("ASIA")).alias("name"), F.lit("nation").alias("kind"))
    return L.ensure(stored, wanted, "name")


def manifest_by_type(spark, sf):
    rows = K._chunk_rows(spark, sf).select("document_id", "strategy", F.when(F.col("chunk_index") == 0, "text").otherwise("table").alias("chunk_type"))
    found = L.manifest_by_type(rows, F.lit(512).alias("size"), F.lit(64).alias("overlap"))
    return found.select("document_id", "chunks", F.to_json("by_strategy").alias("by_strategy"), F.to_json("by_type").alias("by_type"), F.to_json("config").alias("config"))


def chunk_provenance(spark, sf):
    rows = K._chunk_rows(spark, sf)
    none = F.array().cast("array<string>")
    made = {"chunk_type": F.lit("text"), "page_numbers": none, "table_ids": none, "section_path": none, "source_filename": F.concat("document_id", F.lit(".txt")), "source_file_type": F.lit(".txt"), "source_s3_key": F.concat(F.lit("k/"), "document_id")}
    found = L.provenance(rows.withColumns(made))
    return found.select("chunk_id", F.concat_ws("|", "metadata.chunk_type", "metadata.strategy", "metadata.chunk_index", "metadata.source_filename", "metadata.source_file_type", "metadata.source_s3_key", "metadata.content_hash").alias("metadata"))


def strategy_mismatches(spark, sf):
    """Routed documents of which each fifth has lost its last strategy."""
    decisions = K.route(spark, sf)
    found = decisions.where("not (doc_id % 5 = 0 and strategy = 'table_aware')")
    return L.strategies_issues(decisions, found).select("subject", "code")


def sparse_corpus_issues(spark, sf):
    """The documents' index, checked against documents of which some are gone, longer or new."""
    docs = P._docs(spark, sf).select("doc_id", "text")
    path = f"{shared_dir(spark)}/sparse-check-{X.corpus_fingerprint(docs)}"
    X.build_sparse_index(docs, path)
    n = F.col("doc_id")
    other = docs.where(n % 6 != 1).withColumn("text", F.when(n % 6 == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    other = other.unionByName(docs.where(n % 6 == 3).withColumn("doc_id", n + 1_000_000_000))
    return V.counts(X.sparse_index_issues(other, path))


def parsed_files(spark, sf):
    """Documents as files of five types, parsed by their suffix; each eleventh is no JSON, and each thirteenth has a suffix without a parser."""
    n = F.col("doc_id")
    kind = F.when(n % 13 == 0, ".bin").otherwise(F.element_at(F.array(*map(F.lit, (".txt", ".md", ".json", ".csv", ".html"))), (n % 5).cast("int") + 1))
    body = (
        F.when(n % 5 == 2, F.when(n % 11 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"id":'), n, F.lit(',"lang":"'), "lang", F.lit('"}'))))
        .when(n % 5 == 3, F.concat(F.lit("key,name\n\n"), n, F.lit(',"a, b"\n'), "source", F.lit("\n")))
        .when(n % 5 == 4, F.concat(F.lit("<html><body><table><tr><th>a</th><th>b</th></tr><tr><td>"), n, F.lit("</td><td>x</td></tr></table></body></html>")))
        .otherwise(F.col("text"))
    )
    files = _t(spark, sf, "documents").select(F.concat(F.lit("f/"), n, kind).alias("path"), F.encode(body, "UTF-8").alias("content")).withColumn("length", F.length("content").cast("long"))
    found = parse_files(files)
    cells = F.array_join(F.flatten(F.transform(F.get("tables", F.lit(0))["rows"], lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit("null"))))), "|")
    shown = F.when(F.col("file_type").isin(".html"), F.lit(None)).otherwise(F.md5("raw_text"))
    return found.select("path", "file_type", "content_hash", "size", shown.alias("digest"), F.array_join(F.get("tables", F.lit(0))["headers"], "|").alias("headers"), cells.alias("cells"), F.col("error").isNotNull().alias("failed"))


def html_tables(spark, sf):
    """Pages with a table put into them: its place among the parsed columns."""
    made = F.concat(F.lit("<table><tr><td>1</td></tr></table>"), "html")
    return html_columns(_t(spark, sf, "pages").select("page_id", made.alias("html"))).select("page_id", F.col("n_tables").cast("long").alias("n_tables"))


QUERIES = {f.__name__: f for f in (document_clean, deleted_document, cacheable_answers, cache_store, ocr_failures, missed_chunks, indexable_orders, normalised_lists, best_weights, retriever_comparison, added_turns, rejected_turns, cleared_conversations, round_trip, unpaired_documents, request_issues,
                                   rewrite_statistics, ensured_names, manifest_by_type, chunk_provenance, strategy_mismatches, sparse_corpus_issues, parsed_files, html_tables)}

_NCELL = lambda x: K._CLEAN(f"(' ' || chr(9) || {x} || chr(1) || '  x ')")
_M = lambda k, name: f"round(avg(r{k}), 6) AS {name}"
_EACH = lambda hits: f"SELECT count(*) FILTER (rank <= 1) / count(*) AS r1, count(*) FILTER (rank <= 3) / count(*) AS r3, count(*) FILTER (rank <= 5) / count(*) AS r5, coalesce(1 / min(rank) FILTER (rank <= 5), 0) AS rr FROM rel LEFT JOIN {hits} USING (query_id, doc_id) GROUP BY query_id"
_MEANS = lambda hits, more: f"SELECT {_M(1, 'recall_1')}, {_M(3, 'recall_3')}, {_M(5, 'recall_5')}, round(avg(rr), 6) AS mrr, {more} FROM ({_EACH(hits)})"
_PAIRED = "m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT conv_id::VARCHAR AS conversation_id, turn AS turn_no, text AS u, nt AS a FROM m WHERE role = 'user' AND nr = 'assistant')"
ORACLE = {
    "document_clean": f"""WITH d AS (SELECT doc_id, lang, source, {K.NOISY} AS raw FROM documents), p AS (SELECT *, list_transform(string_split(raw, chr(10)), lambda x: {K._CLEAN('x')}) AS ps FROM d)
      SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_filter(list_transform(generate_series(1, len(ps)), lambda i: CASE WHEN ps[i] <> '' THEN 'Page ' || i || chr(10) || ps[i] END), lambda x: x IS NOT NULL), chr(10) || chr(10)) ELSE {K._CLEAN('raw')} END) AS digest,
      CASE WHEN doc_id % 2 = 0 THEN len(ps) ELSE 0 END AS pages, CASE WHEN doc_id % 3 = 0 THEN {_NCELL('source')} || '|b' END AS headers, CASE WHEN doc_id % 3 = 0 THEN {_NCELL('lang')} || '|null' END AS row, '{",".join(T.CLEANING)}' AS steps FROM p""",
    "deleted_document": "SELECT (doc_id % 50)::VARCHAR AS document_id, source AS tenant_id, doc_id FROM documents WHERE NOT (doc_id % 50 = 7 AND coalesce(source, '') = 'src0')",
    "cacheable_answers": f"WITH {Q._ANSWERS} SELECT doc_id % 3 > 0 AND doc_id % 11 <> 0 AND len({Q._CITES}) > 0 AS cacheable, count(*) AS n FROM answers GROUP BY ALL",
    "cache_store": "SELECT doc_id AS entry_id, 'old' AS departments FROM labels WHERE doc_id % 3 <> 1 OR doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 1",
    "ocr_failures": "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '1,2' ELSE '1' END AS pages FROM documents WHERE doc_id % 4 < 2",
    "missed_chunks": f"WITH {K._CHUNKS}, rel AS (SELECT DISTINCT doc_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)) SELECT doc_id, chunk_index FROM ch WHERE doc_id IN (SELECT doc_id FROM rel)",
    "indexable_orders": "SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'READY' END AS status FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "normalised_lists": """WITH w AS (SELECT doc_id, unnest(string_split(string_split(text, chr(10))[1], ' ')) AS w, generate_subscripts(string_split(string_split(text, chr(10))[1], ' '), 1) AS k FROM documents), f AS (SELECT doc_id, w, min(k) AS k FROM w WHERE w <> '' GROUP BY ALL)
      SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY k), '') AS words, coalesce((SELECT string_agg(n::VARCHAR, ',' ORDER BY n) FROM (SELECT DISTINCT length(w) AS n FROM f AS g WHERE g.doc_id = d.doc_id)), '') AS lengths FROM documents d LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
    "best_weights": f"WITH {P._BM25}, {P._TWO}, {P._RELEVANT}, {', '.join(P._fused(f'f{k}', 5, w) for k, w in enumerate(P.GRID))}, g AS (" + " UNION ALL ".join(_MEANS(f"f{k}", f"{k} AS place") for k in range(len(P.GRID))) + ") SELECT * FROM g ORDER BY recall_5 DESC, mrr DESC, recall_1 DESC, recall_3 DESC, place LIMIT 1",
    "retriever_comparison": f"""WITH {P._BM25}, {P._TWO}, {P._RELEVANT}, {P._fused('f', 10)}, h AS (SELECT f.query_id, f.doc_id, f.rank, d.text, q.query FROM f JOIN d USING (doc_id) JOIN q USING (query_id)),
      s AS (SELECT query_id, doc_id, rank, CASE WHEN len({P._TERMS('query')}) > 0 THEN round(len(list_intersect(list_distinct({P._TERMS('query')}), list_distinct({P._TERMS('text')}))) / len(list_distinct({P._TERMS('query')})), 6) ELSE 0.0 END AS score FROM h), k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s),
      re AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM k WHERE score >= 0.1 * best) """ + " UNION ALL ".join(_MEANS(h, f"'{n}' AS retriever") for h, n in (("other", "other"), ("sparse", "sparse"), ("f", "fused"), ("re", "reranked"))),
    "added_turns": f"""WITH {_PAIRED}, n AS (SELECT (doc_id % 97)::VARCHAR AS conversation_id, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS k, 'q' || doc_id AS u FROM documents WHERE doc_id % 7 <> 0), l AS (SELECT conversation_id, max(turn_no) AS last FROM t GROUP BY ALL)
      SELECT conversation_id, turn_no, md5(u || '|' || a) AS digest FROM t UNION ALL SELECT n.conversation_id, coalesce(last, -1) + k, md5(u || '|ok') FROM n LEFT JOIN l USING (conversation_id)""",
    "rejected_turns": "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0",
    "cleared_conversations": f"WITH {_PAIRED} SELECT conversation_id, turn_no FROM t WHERE conversation_id::BIGINT % 3 <> 0",
    "round_trip": f"""WITH {K._CHUNKS}, i AS (SELECT unnest([CASE WHEN doc_id % 5 = 0 THEN 'MISSING_ROW' END, CASE WHEN doc_id % 13 = 0 THEN 'UNKNOWN_ROW' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 11 = 0 THEN 'COUNT_MISMATCH' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'CHANGED_ROW' END]) AS code FROM ch)
      SELECT 'ERROR' AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY ALL""",
    "unpaired_documents": "WITH r AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 1), c AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id::VARCHAR AS subject, 'MISSING_CLEAN_DOCUMENT' AS code FROM r ANTI JOIN c USING (doc_id) UNION ALL SELECT doc_id::VARCHAR, 'MISSING_RAW_DOCUMENT' FROM c ANTI JOIN r USING (doc_id)",
    "request_issues": "SELECT item_id::VARCHAR AS subject, 'EMPTY_QUERY' AS code FROM benchmark WHERE item_id % 4 < 2",
    "rewrite_statistics": f"WITH c AS (SELECT item_id % 5 > 0 AND item_id % 4 > 0 AS re, len(regexp_extract_all(text, '{K._TOK}')) AS n FROM benchmark) SELECT count(*) AS queries, count(*) FILTER (re) AS rewritten, count(*) FILTER (NOT re) AS unchanged, round(avg(n), 6) AS original_tokens, round(avg(n + re::INT), 6) AS query_tokens FROM c",
    "ensured_names": "WITH w AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'ASIA' END AS name FROM nation) SELECT r_name AS name, 'region' AS kind FROM region UNION ALL SELECT name, 'nation' FROM w WHERE name NOT IN (SELECT r_name FROM region)",
    "manifest_by_type": f"""WITH {K._CHUNKS} SELECT doc_id::VARCHAR AS document_id, count(*)::BIGINT AS chunks, '{{"fixed_size":' || count(*) || '}}' AS by_strategy, '{{' || CASE WHEN count(*) > 1 THEN '"table":' || (count(*) - 1) || ',' ELSE '' END || '"text":1}}' AS by_type, '{{"size":512,"overlap":64}}' AS config FROM ch GROUP BY doc_id""",
    "chunk_provenance": f"WITH {K._CHUNKS} SELECT chunk_id, concat_ws('|', 'text', 'fixed_size', chunk_index, doc_id || '.txt', '.txt', 'k/' || doc_id, sha256(text)) AS metadata FROM ch",
    "strategy_mismatches": f"WITH {K._PROFILE}, {K._ROUTE} SELECT DISTINCT doc_id::VARCHAR AS subject, 'STRATEGY_MISMATCH' AS code FROM r WHERE doc_id % 5 = 0 AND x.s = 'table_aware'",
    "sparse_corpus_issues": """WITH d AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents), i AS (SELECT unnest([CASE WHEN doc_id % 6 = 1 AND n > 0 THEN 'UNKNOWN_DOCUMENT' END, CASE WHEN doc_id % 6 = 2 AND n > 0 THEN 'LENGTH_MISMATCH' WHEN doc_id % 6 = 2 OR doc_id % 6 = 3 AND n > 0 THEN 'MISSING_DOCUMENT' END]) AS code FROM d
      UNION ALL SELECT 'CORPUS_HASH_MISMATCH' UNION ALL SELECT 'DOCUMENT_COUNT_MISMATCH' WHERE (SELECT count(*) FILTER (doc_id % 6 = 1) <> count(*) FILTER (doc_id % 6 = 3) FROM d)) SELECT 'ERROR' AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY ALL""",
    "parsed_files": """WITH f AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 13 = 0 OR doc_id % 5 = 2 AND doc_id % 11 = 0 AS bad, CASE WHEN doc_id % 13 = 0 THEN '.bin' ELSE ['.txt', '.md', '.json', '.csv', '.html'][doc_id % 5 + 1] END AS kind, lang, source, text,
      CASE doc_id % 5 WHEN 2 THEN CASE WHEN doc_id % 11 = 0 THEN '{' ELSE '{"id":' || doc_id || ',"lang":"' || lang || '"}' END WHEN 3 THEN 'key,name' || chr(10) || chr(10) || doc_id || ',"a, b"' || chr(10) || source || chr(10)
        WHEN 4 THEN '<html><body><table><tr><th>a</th><th>b</th></tr><tr><td>' || doc_id || '</td><td>x</td></tr></table></body></html>' ELSE text END AS body FROM documents)
      SELECT 'f/' || doc_id || kind AS path, kind AS file_type, sha256(body) AS content_hash, octet_length(encode(body)) AS size,
        CASE WHEN bad OR k = 4 THEN NULL WHEN k = 2 THEN md5('{' || chr(10) || '  "id": ' || doc_id || ',' || chr(10) || '  "lang": "' || lang || '"' || chr(10) || '}') WHEN k = 3 THEN md5('Row 1: key: ' || doc_id || ' | name: a, b' || chr(10) || 'Row 2: key: ' || source || ' | name: ') ELSE md5(text) END AS digest,
        CASE WHEN bad THEN NULL WHEN k = 3 THEN 'key|name' WHEN k = 4 THEN 'a|b' END AS headers, CASE WHEN bad THEN NULL WHEN k = 3 THEN doc_id || '|a, b|' || source || '|null' WHEN k = 4 THEN doc_id || '|x' END AS cells, bad AS failed FROM f""",
    "html_tables": "SELECT page_id, 1 + len(regexp_extract_all(html, '<table')) AS n_tables FROM pages",
}
