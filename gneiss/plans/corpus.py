"""Text, hash, profile, chunk, manifest and parser queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.functions import text as T
from gneiss.operators import chunking, profiles as P, sequential_chunks as S, stores
from gneiss.operators.chunking import ChunkConfig
from gneiss.shared import written
from gneiss.sources.files import html_columns, ocr_needed, parse_files, path_parts

#: What documents get so that each cleaning step has something to do.
NOISY = "concat('  ', replace(replace(text, '. ', concat('. ', chr(9), chr(13), chr(10), ' ', chr(8203))), ', ', concat(',', chr(10), chr(10), chr(10), chr(1), ' x  ')), ' ', chr(10))"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("tenant_id"), F.col("lang").alias("department"))


def clean_text(spark, sf):
    found = _docs(spark, sf).withColumn("text", F.expr(NOISY))
    return found.select("doc_id", T.clean(F.col("text")).alias("clean_text"))


def token_stats(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", T.token_count(t).alias("tokens"), F.char_length(t).alias("characters"), T.meaningful_length(t).alias("meaningful"), F.size(T.word_tokens(t)).alias("words"))


def normalised_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalised(F.col("text"))).alias("digest"))


def retention(spark, sf):
    """The ten documents whose cleaned noisy text is shortest for what it was, and the ten where it is longest."""
    found = _docs(spark, sf).withColumn("raw", F.expr(NOISY)).withColumn("clean", T.clean(F.col("raw")))
    found = written(found.select("doc_id", F.round(F.char_length("clean") / F.char_length("raw"), 6).alias("share")), "retention")
    low, high = found.orderBy("share", "doc_id").limit(10), found.orderBy(F.desc("share"), "doc_id").limit(10)
    return low.withColumn("end", F.lit("lowest")).union(high.withColumn("end", F.lit("highest")))


def cache_keys(spark, sf):
    found = _t(spark, sf, "benchmark")
    return found.select("item_id", T.cache_key(F.concat(F.lit("t"), F.col("item_id") % 3), F.array(F.lit("hr"), F.lit("finance")), F.col("text")).alias("key"))


def file_hashes(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"))


def paths(spark, sf):
    """Paths of five parts taken apart; others are null."""
    made = F.concat(F.lit("original/"), "source", F.lit("/"), "lang", F.when(F.col("doc_id") % 7 == 0, F.lit("/x/y/")).otherwise("/"), F.substring(F.sha2("text", 256), 1, 8), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return _t(spark, sf, "documents").select("doc_id", path_parts(made).alias("p")).select("doc_id", "p.tenant_id", "p.department", "p.content_hash", "p.file_name")


def chunked(spark, sf, config: ChunkConfig):
    return chunking.fixed_size(_docs(spark, sf), config)


def fixed_chunks(spark, sf):
    return chunked(spark, sf, ChunkConfig("fixed_size")).select("doc_id", "chunk_index", "start_char", "end_char", "token_count", F.md5("chunk_text").alias("digest"))


def fixed_chunks_small(spark, sf):
    return chunked(spark, sf, ChunkConfig("fixed_size", size=40, overlap=10, least=5)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("long").alias("tokens"), F.max("end_char").alias("last"))


def fixed_chunks_chars(spark, sf):
    return chunked(spark, sf, ChunkConfig("fixed_size", size=500, overlap=100, least=50, unit="characters")).select("doc_id", "chunk_index", "start_char", "end_char", F.md5("chunk_text").alias("digest"))


def _pages(spark, sf):
    """Each line of a document as a page."""
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("page_number"), "text")


def page_windows(spark, sf):
    return chunking.page_aware(_pages(spark, sf), ChunkConfig("page_aware", size=30, overlap=5, least=1)).select("doc_id", "page_number", "chunk_index", "token_count", F.md5("chunk_text").alias("digest"))


def _chunk_rows(spark, sf):
    own = chunked(spark, sf, ChunkConfig("fixed_size")).withColumns({"document_id": F.col("doc_id").cast("string"), "content_hash": F.sha2("text", 256)})
    return chunking.with_chunk_ids(own, "fixed_size")


def chunk_ids(spark, sf):
    return _chunk_rows(spark, sf).select("doc_id", "chunk_index", "chunk_id")


def chunk_manifest(spark, sf):
    return stores.chunk_manifest(_chunk_rows(spark, sf))


def corpus_hash(spark, sf):
    return stores.corpus_hash(_chunk_rows(spark, sf), "chunk_id", "chunk_id", "content_hash")


def embedding_hash(spark, sf):
    """The hash of each document's chunks in order, as an embedding manifest has it."""
    return stores.ordered_hash(_chunk_rows(spark, sf), "doc_id", "chunk_index", "chunk_id", "chunk_text")


def persist_status(spark, sf):
    """Against a store of the labelled documents alone, with another count for those of low quality."""
    now = chunk_manifest(spark, sf).select("document_id", "strategy", "chunks")
    labels = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"), "quality")
    was = now.join(labels, "document_id").select("document_id", "strategy", (F.col("chunks") + 1 - F.col("quality")).alias("chunks"))
    return stores.persist_status(now, was, ["document_id", "strategy"]).groupBy("status").agg(F.count("*").alias("n"))


def _profiled(spark, sf):
    """Documents with every fifth one's lines as paragraphs, with upper-case lines and by turns each file type, pages and tables."""
    kinds = [".md", ".txt", ".pdf", ".json", ".csv", ".html", ".htm", ".xlsx"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds)).cast("int") + 1)
    text = F.when(F.col("doc_id") % 5 < 3, F.concat(F.lit("# Title\n\nPART ONE\n\n1. First things\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))).otherwise(F.col("text"))
    found = _docs(spark, sf).select("doc_id", kind.alias("file_type"), text.alias("text"))
    return found.withColumns({"pages": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "tables": F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))})


def profile(spark, sf):
    return P.profile(_profiled(spark, sf))


def structure_histogram(spark, sf):
    score = F.col("structure_confidence")
    bucket = F.when(score < 0.25, "low").when(score < 0.5, "medium").when(score < 0.75, "high").otherwise("very_high")
    return profile(spark, sf).groupBy(bucket.alias("bucket"), "file_type").agg(F.count("*").alias("n"))


def route(spark, sf):
    found = P.route(profile(spark, sf)).select("doc_id", F.explode("decisions").alias("d"))
    return found.select("doc_id", "d.strategy", "d.content", "d.priority")


def routing_combinations(spark, sf):
    return P.route(profile(spark, sf)).groupBy(P.combination(F.col("decisions")).alias("combination")).agg(F.count("*").alias("n"))


def recursive_chunks(spark, sf):
    return S.chunk(_docs(spark, sf), ChunkConfig("recursive"))


def sentence_chunks(spark, sf):
    return S.chunk(_docs(spark, sf), ChunkConfig("sentence", size=128, overlap=16, least=12))


def paragraph_chunks(spark, sf):
    return S.chunk(_docs(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), ChunkConfig("paragraph", size=128, overlap=16, least=12))


def structure_chunks(spark, sf):
    return S.chunk(_profiled(spark, sf), ChunkConfig("structure_aware", size=128, overlap=16, least=12))


def table_chunks(spark, sf):
    """The orders of each customer as a table."""
    cells = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), F.lit("orders").alias("table_id"), F.col("o_orderkey").alias("row_no"), cells.alias("cells"))
    headers = rows.select("doc_id", "table_id").distinct().withColumn("headers", F.array(*map(F.lit, ("key", "status", "price", "date"))))
    return S.chunk_table_rows(rows, headers, ChunkConfig("table_aware", size=64, overlap=0, least=1))


def json_chunks(spark, sf):
    found = _t(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    return S.chunk(found, ChunkConfig("json_aware")).select("doc_id", "chunk_index", "chunk_text")


def _routed_inputs(spark, sf):
    """Routed documents with real pages (their lines), JSON texts and table rows, where _profiled says that they have some."""
    docs = _profiled(spark, sf)
    body = F.when(F.col("file_type") == ".json", F.to_json(F.struct("doc_id", F.split("text", "\n").alias("lines")))).otherwise(F.col("text"))
    pages = F.when(F.size("pages") > 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    row = lambda x, k: F.array((k + 1).cast("string"), x)
    rows = F.when(F.size("tables") > 0, F.transform(F.split("text", "\n"), row)).otherwise(F.array().cast("array<array<string>>"))
    return docs.select("doc_id", "file_type", body.alias("text"), pages.alias("page_texts"), rows.alias("rows"))


def routed_chunks(spark, sf):
    """Each document by the strategies it is routed to: its text, its pages' texts or its table's rows."""
    docs = _routed_inputs(spark, sf)
    sizes = F.when(F.size("rows") > 0, F.array(F.size("rows"))).otherwise(F.array().cast("array<int>"))
    profiled = P.profile(docs.select("doc_id", "file_type", "text", F.col("page_texts").alias("pages"), sizes.alias("tables")))
    # Written, since each chunker reads them more than once: documents are profiled in one pass.
    decisions = written(P.route(profiled).select("doc_id", F.explode("decisions").alias("d")).select("doc_id", "d.strategy"), "decisions")
    pages = docs.select("doc_id", F.posexplode("page_texts").alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("page_number"), "text")
    tables = docs.where(F.size("rows") > 0).select("doc_id", F.lit("t").alias("table_id"), F.array(F.lit("line"), F.lit("text")).alias("headers"), "rows")
    same = ("doc_id", "chunk_index", "token_count")
    # Only the documents that are routed to a strategy are given to its chunker: the JSON one raises on other texts.
    own = lambda rows, s: rows.join(decisions.where(F.col("strategy") == s).select("doc_id"), "doc_id", "left_semi")
    found = {s: S.chunk(own(docs, s), ChunkConfig(s)).select(*same) for s in ("recursive", "structure_aware", "json_aware")}
    found["page_aware"] = chunking.page_aware(own(pages, "page_aware"), ChunkConfig("page_aware")).select(*same)
    found["table_aware"] = S.chunk_tables(own(tables, "table_aware"), ChunkConfig("table_aware")).select(*same)
    return chunking.routed(decisions, found).select("doc_id", "strategy", "chunk_index", "token_count")


def html_blocks(spark, sf):
    return html_columns(_t(spark, sf, "pages").select("page_id", "html"))


def html_meta(spark, sf):
    """Title and language of each page, by the parser."""
    return html_blocks(spark, sf).select("page_id", "language", (F.col("n_links") + 0).alias("n_links"))


def csv_rows(spark, sf):
    """Each nation as a CSV file with a quoted comma and a short row, parsed and rendered."""
    body = F.concat(F.lit('key,name,"a, b"\n'), F.col("n_nationkey"), F.lit(","), "n_name", F.lit(',"x, y"\n'), F.col("n_regionkey"), F.lit(",z\n"))
    files = _t(spark, sf, "nation").select(F.concat("n_nationkey", F.lit(".csv")).alias("path"), F.encode(body, "UTF-8").alias("content")).withColumn("length", F.length("content").cast("long"))
    return parse_files(files).select("path", F.explode(F.split("raw_text", "\n")).alias("line"))


def ocr_pages(spark, sf):
    return _pages(spark, sf).select("doc_id", ocr_needed(F.col("text")).alias("needed")).groupBy("doc_id").agg(F.count_if("needed").alias("pages_for_ocr"), F.count("*").alias("pages"))


def hash_embeddings(spark, sf):
    """The places of the stand-in embedder's vectors of all documents that aren't zero, with their values."""
    v = _docs(spark, sf).select("doc_id", F.posexplode(stores.hashing_embedder(F.col("text"))).alias("place", "value"))
    return v.where("value <> 0").select("doc_id", "place", F.round("value", 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (clean_text, token_stats, normalised_text, retention, cache_keys, file_hashes, paths, fixed_chunks, fixed_chunks_small, fixed_chunks_chars, page_windows, chunk_ids, chunk_manifest, corpus_hash, embedding_hash, persist_status, profile, structure_histogram, route,
              routing_combinations, recursive_chunks, sentence_chunks, paragraph_chunks, structure_chunks, table_chunks, json_chunks, routed_chunks, html_blocks, html_meta, csv_rows, ocr_pages, hash_embeddings)
}

_S, _LS = T.SPACE, T.LINE_SPACE
_NOISY = NOISY
_CLEAN = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}\\p{{Cf}}]', '', 'g'), '[ \\t]+', ' ', 'g'), '(^|\\n)[{_LS}]+', '\\1', 'g'), '[{_LS}]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_S}]+|[{_S}]+$', '', 'g')"
_TOK = f"[^{_S}]+"


def _windows(source: str, size: int, overlap: int, least: int, unit: str = "[^" + _S + "]+[" + _S + "]*") -> str:
    """w: doc_id, k, start, units and text of each window of source (doc_id, text)."""
    step = size - overlap
    tokens = unit != "."
    u = f"regexp_extract_all(text, '{unit if tokens else '(?s).'}')"
    lead = f"length(regexp_extract(text, '^[{_S}]*'))" if tokens else "0"
    strip = f"regexp_replace(j, '[{_S}]+$', '')" if tokens else "j"
    return f"""u AS (SELECT *, {u} AS us, {lead} AS lead FROM {source}),
    k AS (SELECT *, unnest(generate_series(0, greatest(0, CAST(ceil((len(us) - {size}) / {step}::DOUBLE) AS INT)) * {step}, {step})) AS k FROM u WHERE len(us) > 0),
    j AS (SELECT * EXCLUDE (us), array_to_string(us[k + 1:k + {size}], '') AS j, lead + coalesce(length(array_to_string(us[1:k], '')), 0) AS start, len(us[k + 1:k + {size}]) AS units FROM k),
    w AS (SELECT * EXCLUDE (j), {strip} AS chunk_text, start + length({strip}) AS stop FROM j WHERE units >= {least})"""


def _packed(text: str, boundary: str, joiner: str, strategy: str, last: str = "TRUE", size: int = 128, overlap: int = 16, least: int = 12) -> str:
    """Chunks of units of documents' texts: a unit ends before group 2 of boundary; those over size are cut; groups and a small last one as in the chunker."""
    return f"""WITH RECURSIVE m AS (SELECT doc_id, {text} AS text FROM documents), b AS (SELECT *, string_split(regexp_replace(text, '{boundary}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM m),
    q AS (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM b), r AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
    v AS (SELECT doc_id, i, before + length(regexp_extract(p, '^[{_S}]*')) AS pos, regexp_extract_all(p, '{_TOK}[{_S}]*') AS us FROM r WHERE {last}),
    k AS (SELECT *, unnest(generate_series(0, len(us) - 1, {size})) AS k FROM v WHERE len(us) > 0),
    x AS (SELECT doc_id, i, k, len(us[k + 1:k + {size}]) AS n, regexp_replace(array_to_string(us[k + 1:k + {size}], ''), '[{_S}]+$', '') AS t, pos + length(array_to_string(us[1:k], '')) AS pos FROM k),
    y AS (SELECT doc_id, list(t ORDER BY i, k) AS ts, list(pos ORDER BY i, k) AS starts, list(pos + length(t) ORDER BY i, k) AS stops, list_concat([0], list(s ORDER BY i, k)) AS sums FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i, k) AS s FROM x) GROUP BY doc_id),
    g AS (SELECT doc_id, 0 AS g, 1 AS a, len(list_filter(sums, lambda s: s <= {size})) - 1 AS z FROM y
      UNION ALL SELECT doc_id, g + 1, f, len(list_filter(sums, lambda s: s <= sums[f] + {size})) - 1 FROM (
        SELECT g.*, sums, greatest(a, list_min(list_filter(range(1, z + 2), lambda f: f = z + 1 OR (sums[z + 1] - sums[f] <= {overlap} AND sums[z + 2] - sums[f] <= {size})))) AS f FROM g JOIN y USING (doc_id) WHERE z < len(ts))),
    c AS (SELECT doc_id, g, array_to_string(ts[a:z], '{joiner}') AS t, sums[z + 1] - sums[a] AS n, starts[a] AS start, stops[z] AS stop FROM g JOIN y USING (doc_id)),
    e AS (SELECT *, lead(t) OVER w AS t2, lead(n) OVER w AS n2, lead(stop) OVER w AS stop2, lag(n) OVER w AS n0, max(g) OVER (PARTITION BY doc_id) AS top FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
    o AS (SELECT *, g = top - 1 AND n2 < {least} AND n + n2 <= {size} AS merged FROM e WHERE NOT (g = top AND g > 0 AND n < {least} AND n0 + n <= {size}))
    SELECT doc_id, '{strategy}' AS strategy, g AS chunk_index, CASE WHEN merged THEN t || '{joiner}' || t2 ELSE t END AS chunk_text, 'text' AS chunk_type, []::VARCHAR[] AS section_path, start AS start_char, CASE WHEN merged THEN stop2 ELSE stop END AS end_char, CASE WHEN merged THEN n + n2 ELSE n END AS token_count FROM o"""


_DOCS = "d AS (SELECT doc_id, text, source AS tenant_id, lang AS department FROM documents)"
_INDEXED = "c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index FROM w)"
_CHUNKS = f"{_DOCS}, {_windows('d', 512, 64, 50)}, {_INDEXED}, ch AS (SELECT *, sha256(concat_ws('|', tenant_id, doc_id::VARCHAR, sha256(text), 'fixed_size', '1.0', chunk_index::VARCHAR, sha256(chunk_text))) AS chunk_id FROM c)"
_KIND = "['.md', '.txt', '.pdf', '.json', '.csv', '.html', '.htm', '.xlsx'][doc_id % 8 + 1]"
_MADE = "CASE WHEN doc_id % 5 < 3 THEN '# Title' || chr(10) || chr(10) || 'PART ONE' || chr(10) || chr(10) || '1. First things' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) ELSE text END"
_HEADS = f"""CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{_S}]+|[{_S}]+$', '', 'g')),
  lambda x: regexp_full_match(x, '#{{1,6}}\\s+\\S.+') OR regexp_full_match(x, '(\\d+\\.)+\\s*\\S.+') OR (regexp_full_match(x, '[A-Z][A-Z0-9\\s/&(),:''-]{{2,100}}') AND len(regexp_extract_all(x, '{_TOK}')) BETWEEN 1 AND 15 AND length(x) <= 120))) AS INT)"""
_PROFILE = f"""m AS (SELECT doc_id, {_KIND} AS file_type, {_MADE} AS text FROM documents),
p AS (SELECT *, {_HEADS} AS heading_count, list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> '') AS ps FROM m),
s AS (SELECT doc_id, file_type, length(text) AS character_count, len(regexp_extract_all(text, '{_TOK}')) AS token_count, heading_count, len(ps) AS paragraph_count,
  round(list_sum(list_transform(ps, lambda x: len(regexp_extract_all(x, '{_TOK}')))) / len(ps), 6) AS average_paragraph_tokens, doc_id % 3 = 0 AS has_pages, doc_id % 2 = 0 AS has_tables,
  CAST(least(1.0, round(0.25 * (heading_count >= 1)::INT + 0.25 * (heading_count >= 3)::INT + 0.2 * (len(ps) >= 2)::INT + 0.15 * (len(ps) >= 5)::INT + 0.15 * (heading_count > 0 AND len(ps) > heading_count)::INT, 6)) AS DOUBLE) AS structure_confidence FROM p),
pr AS (SELECT *, structure_confidence >= 0.5 AS has_structure, token_count <= 512 AS is_short FROM s)"""
_ROUTE = """r AS (SELECT doc_id, unnest(CASE
  WHEN file_type = '.json' THEN [{'s': 'json_aware', 'c': 'text', 'p': 100}]
  WHEN file_type IN ('.csv', '.xlsx') THEN CASE WHEN has_tables THEN [{'s': 'table_aware', 'c': 'tables', 'p': 100}] ELSE [{'s': 'recursive', 'c': 'text', 'p': 50}] END
  WHEN file_type = '.pdf' THEN list_concat(CASE WHEN has_pages THEN [{'s': 'page_aware', 'c': 'text', 'p': 100}] WHEN token_count > 0 THEN [{'s': 'recursive', 'c': 'text', 'p': 50}] ELSE [] END, CASE WHEN has_tables THEN [{'s': 'table_aware', 'c': 'tables', 'p': 90}] ELSE [] END)
  WHEN file_type IN ('.md', '.html', '.docx') THEN list_concat(CASE WHEN has_structure THEN [{'s': 'structure_aware', 'c': 'text', 'p': 100}] ELSE [{'s': 'recursive', 'c': 'text', 'p': 50}] END, CASE WHEN has_tables THEN [{'s': 'table_aware', 'c': 'tables', 'p': 90}] ELSE [] END)
  WHEN file_type = '.txt' THEN [{'s': 'recursive', 'c': 'text', 'p': 50}] ELSE [{'s': 'recursive', 'c': 'text', 'p': 10}] END) AS x FROM pr)"""
ORACLE = {
    "clean_text": f"SELECT doc_id, {_CLEAN(_NOISY)} AS clean_text FROM documents",
    "token_stats": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOK}')) AS tokens, length(text) AS characters, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS meaningful, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS words FROM documents",
    "normalised_text": f"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[{_S}]+', ' ', 'g'))) AS digest FROM documents",
    "retention": f"WITH r AS (SELECT doc_id, round(length({_CLEAN('raw')}) / length(raw), 6) AS share FROM (SELECT doc_id, {_NOISY} AS raw FROM documents)) SELECT *, 'lowest' AS end FROM (FROM r ORDER BY share, doc_id LIMIT 10) UNION ALL SELECT *, 'highest' FROM (FROM r ORDER BY share DESC, doc_id LIMIT 10)",
    "cache_keys": f"SELECT item_id, 'rag:' || sha256('t' || (item_id % 3) || ':finance,hr:' || trim(regexp_replace(lower(text), '[{_S}]+', ' ', 'g'))) AS key FROM benchmark",
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "paths": "SELECT doc_id, CASE WHEN ok THEN source END AS tenant_id, CASE WHEN ok THEN lang END AS department, CASE WHEN ok THEN substring(sha256(text), 1, 8) END AS content_hash, CASE WHEN ok THEN doc_id || '.txt' END AS file_name FROM (SELECT *, doc_id % 7 <> 0 AS ok FROM documents)",
    "fixed_chunks": f"WITH {_DOCS}, {_windows('d', 512, 64, 50)}, {_INDEXED} SELECT doc_id, chunk_index, start AS start_char, stop AS end_char, units AS token_count, md5(chunk_text) AS digest FROM c",
    "fixed_chunks_small": f"WITH {_DOCS}, {_windows('d', 40, 10, 5)} SELECT doc_id, count(*) AS chunks, sum(units)::BIGINT AS tokens, max(stop) AS last FROM w GROUP BY doc_id",
    "fixed_chunks_chars": f"WITH {_DOCS}, {_windows('d', 500, 100, 50, '.')}, {_INDEXED} SELECT doc_id, chunk_index, start AS start_char, stop AS end_char, md5(chunk_text) AS digest FROM c",
    "page_windows": f"WITH pg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents), {_windows('pg', 30, 5, 1)} SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, k) - 1 AS chunk_index, units AS token_count, md5(chunk_text) AS digest FROM w",
    "chunk_ids": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, chunk_id FROM ch",
    "chunk_manifest": f"WITH {_CHUNKS} SELECT doc_id::VARCHAR AS document_id, 'fixed_size' AS strategy, count(*) AS chunks, sum(units)::BIGINT AS tokens, sum(length(chunk_text))::BIGINT AS characters FROM ch GROUP BY doc_id",
    "corpus_hash": f"WITH {_CHUNKS}, e AS (SELECT chunk_id AS k, sha256(chunk_id || sha256(text)) AS h, substring(sha256(chunk_id), 1, 4) AS g FROM ch), f AS (SELECT g, sha256(string_agg(h, '' ORDER BY k)) AS h FROM e GROUP BY g) SELECT sha256(string_agg(h, '' ORDER BY g)) AS sha256 FROM f",
    "embedding_hash": f"WITH {_CHUNKS} SELECT doc_id, sha256(string_agg(chunk_id || chunk_text, '' ORDER BY chunk_index)) AS sha256 FROM ch GROUP BY doc_id",
    "persist_status": f"WITH {_CHUNKS}, x AS (SELECT DISTINCT doc_id FROM ch) SELECT CASE WHEN quality IS NULL THEN 'WRITTEN' WHEN quality = 0 THEN 'REBUILT' ELSE 'SKIPPED_UP_TO_DATE' END AS status, count(*) AS n FROM x LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "profile": f"WITH {_PROFILE} SELECT * FROM pr",
    "structure_histogram": f"WITH {_PROFILE} SELECT CASE WHEN structure_confidence < 0.25 THEN 'low' WHEN structure_confidence < 0.5 THEN 'medium' WHEN structure_confidence < 0.75 THEN 'high' ELSE 'very_high' END AS bucket, file_type, count(*) AS n FROM pr GROUP BY ALL",
    "route": f"WITH {_PROFILE}, {_ROUTE} SELECT doc_id, x.s AS strategy, x.c AS content, x.p AS priority FROM r",
    "routing_combinations": f"WITH {_PROFILE}, {_ROUTE}, c AS (SELECT doc_id, string_agg(x.s, '+' ORDER BY -x.p, x.s) AS combination FROM r GROUP BY doc_id) SELECT combination, count(*) AS n FROM c GROUP BY combination",
    "sentence_chunks": _packed("text", f"([.!?])([{_S}])", " ", "sentence"),
    "paragraph_chunks": _packed("replace(text, chr(10), chr(10) || chr(10))", f"([^{_S}])(\\n[{_S}]*\\n)", "\n\n", "paragraph", f"i < len(ps) OR NOT regexp_matches(text, '[{_S}]$')"),
    "table_chunks": """WITH r AS (SELECT o_custkey::BIGINT AS doc_id, o_orderkey AS key, concat_ws(' | ', o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d')) AS line FROM orders),
      n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY key, line) - 1) // ((64 - 7) // 7) AS chunk_index FROM r)
      SELECT doc_id, 'orders' AS table_id, chunk_index, 'key | status | price | date' || chr(10) || string_agg(line, chr(10) ORDER BY key, line) AS chunk_text, 7 + 7 * count(*) AS token_count FROM n GROUP BY doc_id, chunk_index""",
    "json_chunks": "SELECT event_id AS doc_id, k - 1 AS chunk_index, key || ': ' || (props::JSON->key)::VARCHAR AS chunk_text FROM (SELECT event_id, props, unnest(json_keys(props)) AS key, generate_subscripts(json_keys(props), 1) AS k FROM events WHERE trim(props) <> '')",
    "html_meta": "SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS language, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages",
    "csv_rows": "SELECT n_nationkey || '.csv' AS path, unnest(['Row 1: key: ' || n_nationkey || ' | name: ' || n_name || ' | a, b: x, y', 'Row 2: key: ' || n_regionkey || ' | name: z | a, b: ']) AS line FROM nation",
    "ocr_pages": "SELECT doc_id, count(*) FILTER (length(regexp_replace(p, '[^\\p{L}\\p{N}]', '', 'g')) < 50) AS pages_for_ocr, count(*) AS pages FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id",
    "hash_embeddings": """WITH w AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS place FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents)), v AS (SELECT doc_id, place, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
      SELECT doc_id, place::INT AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM v""",
}
