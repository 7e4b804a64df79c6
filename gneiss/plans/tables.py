"""Analytics, SQL, catalog, evaluation and validation queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.functions.text import SPACE
from gneiss.operators import evaluation as E, lifecycle, tables as A, validation as V
from gneiss.plans.corpus import _CHUNKS, _chunk_rows
from gneiss.sources.files import path_parts

RELATIONAL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
FACTS = [["the", "zzz"], ["thtion"], ["qqqq"], []]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Tabular analytics


def agg_count(spark, sf):
    return A.analyse(_t(spark, sf, "orders"), "count")


def agg_columns(spark, sf):
    return A.analyse(_t(spark, sf, "region"), "columns")


def agg_shape(spark, sf):
    return A.analyse(_t(spark, sf, "orders"), "SHAPE")


def describe(spark, sf):
    found = A.analyse(_t(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber"), "describe")
    return found.select("column", "count", *[F.round(c, 4).alias(c) for c in found.columns[2:]])


def _one(operation):
    def query(spark, sf):
        return A.analyse(_t(spark, sf, "lineitem"), operation, "l_extendedprice").select(F.round(operation, 4).alias(operation))

    query.__name__ = f"agg_{operation}"
    return query


agg_sum, agg_mean, agg_min, agg_max = map(_one, ("sum", "mean", "min", "max"))


def top_n(spark, sf):
    return A.analyse(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "top_n", "o_totalprice", 7)


def bottom_n(spark, sf):
    return A.analyse(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "bottom_n", "o_totalprice", 7)


# SELECT pass-through

SQL = {
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "sql_shipping_priority": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1996-03-15' AND l_shipdate > DATE '1996-03-15' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "sql_nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "sql_discount_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "sql_left_join": "SELECT c_nationkey, count(*) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey",
    "sql_full_join": "SELECT count(*) AS n, count(s_suppkey) AS suppliers, count(c_custkey) AS customers FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "sql_semi_join": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderstatus",
    "sql_anti_join": "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_rollup": "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n, grouping(o_orderstatus) + grouping(year(o_orderdate)) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, year(o_orderdate))",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_windows": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS nth, coalesce(lag(o_orderkey) OVER w, -1) AS before, round(sum(o_totalprice) OVER w, 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS x WHERE nth <= 3",
    "sql_union": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "sql_having": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 25",
    "sql_scalar_subquery": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "sql_event_types": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean FROM events GROUP BY event_type",
}


def _select(name):
    def query(spark, sf):
        A.register_tables(spark, sf, RELATIONAL)
        return A.select_only(spark, SQL[name])

    query.__name__ = name
    return query


# Counts and catalog


def key_counts(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


def rollup_counts(spark, sf):
    return _t(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


def most_common(spark, sf):
    return _t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(10)


def duplicate_content(spark, sf):
    found = _t(spark, sf, "documents").withColumn("digest", F.sha2("text", 256))
    return A.shared_content(found, "digest", "doc_id")


def duplicate_ids(spark, sf):
    return V.duplicate_keys(_t(spark, sf, "documents").select("source", "lang", "n_chars"), "source", "lang", "n_chars")


def latest_version(spark, sf):
    """Orders as versions of their customer's file: the one of the latest date."""
    return A.latest(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def _users(spark, sf):
    role = F.when(F.col("c_custkey") % 50 == 0, "admin").when(F.col("c_custkey") % 2 == 0, "manager").otherwise("employee")
    own = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("c_custkey") % 4).cast("int") + 1)
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("src"), F.col("c_custkey") / 10 % 20).alias("tenant_id"), own.alias("department"), role.alias("role"))


def document_acl(spark, sf):
    """How many documents each user may read."""
    docs = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("department"))
    users = _users(spark, sf).withColumn("tenant_id", F.concat(F.lit("src"), F.expr("user_id div 10") % 20))
    return A.visible_counts(docs, users)


def scope_resolution(spark, sf):
    asked = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("*"))).when(F.col("user_id") % 7 == 0, F.array(F.lit("hr"))).otherwise(F.array().cast("array<string>"))
    return _users(spark, sf).select("user_id", F.array_join(A.scope(F.col("role"), F.col("department"), asked), ",").alias("departments"))


def tool_permissions(spark, sf):
    allowed = F.when(F.col("role") == "admin", F.array(F.lit("*"))).when(F.col("role") == "manager", F.array(F.lit("search"), F.lit("sql"))).otherwise(F.array(F.lit("search")))
    return _users(spark, sf).select("role", A.may_use(allowed, F.lit("sql")).alias("sql"), A.may_use(allowed, F.lit("search")).alias("search")).distinct()


def catalog_listing(spark, sf):
    """Customers with their nation and region, which are empty where unknown."""
    c, n, r = _t(spark, sf, "customer"), _t(spark, sf, "nation"), _t(spark, sf, "region")
    found = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return found.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


def role_lists(spark, sf):
    """Each region's nations as one string, as roles have their permissions."""
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    return r.join(n, r.r_regionkey == n.n_regionkey).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


def stale_points(spark, sf):
    return A.stale(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), "doc_id")


def upserted(spark, sf):
    stored = _t(spark, sf, "documents").select("doc_id", F.char_length("text").alias("n"))
    return A.upsert(stored, stored.join(_t(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", (F.col("n") + 1).alias("n")), "doc_id")


def pending(spark, sf):
    return A.not_yet(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


def semantic_cache(spark, sf):
    """Embeddings as cached answers: the best usable one for each vector whose id 50 divides, of the others."""
    from gneiss.operators.retrieval import dense_scores

    v = _t(spark, sf, "embeddings")
    rows = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    scores = dense_scores(rows.where("doc_id % 50 <> 0"), rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), 50).withColumnRenamed("doc_id", "entry_id")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("t0").alias("tenant_id"), F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("d0"), F.lit("d1"))).alias("departments"))
    cache = v.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("entry_id"), F.lit("t0").alias("tenant_id"), F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), F.col("vec_id") % 3))).alias("answer_departments"))
    return A.cached_answers(queries, cache, scores, least=0.3)


# Evaluation


def _answers(spark, sf):
    """Documents as answers: each sentence cites its source, each fourth an unknown one, and some sentences nothing."""
    cut = F.split(F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), f"([.!?])[{SPACE}]+", "$1\x01"), "\x01")
    cited = F.transform(cut, lambda s, k: F.concat(s, F.when(k % 4 == 3, " [nobody].").when(k % 3 == 0, F.concat(F.lit(" ["), F.col("source"), F.lit("]."))).otherwise("")))
    answer = F.when(F.col("doc_id") % 11 == 0, "I do not know based on the provided context.").otherwise(F.array_join(cited, "\n"))
    return _t(spark, sf, "documents").select("doc_id", "source", answer.alias("answer"))


def fact_recall(spark, sf):
    facts = F.array(*[F.array(*map(F.lit, g)).cast("array<string>") for g in FACTS])
    return _answers(spark, sf).select("doc_id", F.round(E.fact_recall(F.col("answer"), facts), 6).alias("recall"))


def source_recall(spark, sf):
    expected = F.array(F.col("source"), F.lit("src1"))
    return _answers(spark, sf).select("doc_id", F.round(E.source_recall(E.valid_citations(F.col("answer"), expected), expected), 6).alias("recall"))


def citation_validate(spark, sf):
    return _answers(spark, sf).select("doc_id", F.array_join(E.valid_citations(F.col("answer"), F.array("source")), ",").alias("sources"), F.size(E.citations(F.col("answer"))).alias("n"))


def citation_completeness(spark, sf):
    return _answers(spark, sf).select("doc_id", E.completeness(F.col("answer"), F.array("source")).alias("c")).select("doc_id", "c.factual", "c.cited", F.round("c.score", 6).alias("score"))


def claim_citations(spark, sf):
    found = _answers(spark, sf).select("doc_id", F.posexplode(E.claims(F.col("answer"), F.array("source"))).alias("claim_no", "c"))
    return found.select("doc_id", "claim_no", "c.claim", F.array_join("c.citations", ",").alias("citations"))


def answer_gate(spark, sf):
    return _answers(spark, sf).select("doc_id", F.md5(E.gated(F.col("answer"), E.valid_citations(F.col("answer"), F.array("source")))).alias("digest"), E.abstains(F.col("answer")).alias("abstains"))


def faithfulness_score(spark, sf):
    """Lines of an order as claims: by shipped status, a stand-in for a judge's verdict."""
    verdict = F.when(F.col("l_returnflag") == "A", "SUPPORTED").when(F.col("l_returnflag") == "N", "PARTIALLY_SUPPORTED").when(F.col("l_linenumber") == 7, F.lit(None)).otherwise("UNSUPPORTED")
    rows = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("case_id"), F.col("l_linenumber").alias("claim_no"), verdict.alias("verdict"))
    return E.faithfulness(rows)


# Validation


def retrieval_dataset_issues(spark, sf):
    cases = _t(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 9 == 0, F.lit(" ")).when(F.col("item_id") % 7 == 0, F.lit("same")).otherwise(F.col("text")).alias("query"), F.when(F.col("item_id") % 5 != 0, F.lit("t")).alias("tenant_id"), F.lit("hr").alias("department"), F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("item_id", F.lit(".txt")), F.lit("lost.txt"))).alias("relevant"))
    files = _t(spark, sf, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("filename"))
    return V.counts(V.dataset_issues(cases, files))


def chunk_issues(spark, sf):
    n = F.col("doc_id")
    none = F.array().cast("array<string>")
    rows = _chunk_rows(spark, sf).withColumns({
        "expected_document_id": F.when(n % 10 == 0, F.lit("other")).otherwise(F.col("document_id")), "expected_tenant_id": F.when(n % 23 == 0, F.lit("other")).otherwise(F.col("tenant_id")), "expected_department": F.when(n % 29 == 0, F.lit("other")).otherwise(F.col("department")),
        "expected_content_hash": F.when(n % 31 == 0, F.lit("other")).otherwise(F.col("content_hash")), "chunk_type": F.when(n % 13 == 0, F.lit("image")).otherwise(F.lit("text")), "strategy": F.when(n % 37 == 0, F.lit("table_aware")).when(n % 37 == 1, F.lit("page_aware")).otherwise(F.col("strategy")),
        "chunk_index": F.when(n % 17 == 0, F.lit(-1)).otherwise(F.col("chunk_index")), "page_numbers": F.array().cast("array<int>"), "table_ids": none, "section_path": none, "chunk_text": F.when(n % 19 == 0, F.lit(" ")).otherwise(F.col("chunk_text"))})
    return V.counts(V.chunk_issues(rows, 500))


def chunk_layout_issues(spark, sf):
    """Chunk files of whose paths some are of another tenant, department or content, or not laid out as they should be."""
    n = F.col("doc_id")
    files = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("department"), F.sha2("text", 256).alias("content_hash"))
    part = lambda k, c: F.when(n % 10 == k, F.lit("x")).otherwise(F.col(c))
    path = F.concat(F.lit("original/"), part(1, "tenant_id"), F.lit("/"), part(2, "department"), F.when(n % 10 == 4, F.lit("/y/z/")).otherwise(F.lit("/")), part(3, "content_hash"), F.lit("/"), n, F.lit(".jsonl"))
    return V.counts(V.layout_issues(files.withColumn("path", path), path_parts(F.col("path"))))


def chunk_manifest_issues(spark, sf):
    """Manifests of which some are gone, or count chunks, strategies or types otherwise than the chunks do."""
    rows = _chunk_rows(spark, sf).select("doc_id", "document_id", "strategy", F.when(F.col("chunk_index") == 0, "text").otherwise("table").alias("chunk_type"))
    n = F.col("document_id").cast("long")
    made = lifecycle.manifest_by_type(rows.select("document_id", "strategy", "chunk_type")).withColumns({
        "chunks": F.when(n % 7 == 1, F.col("chunks") + 1).otherwise(F.col("chunks")), "by_strategy": F.when(n % 7 == 2, F.create_map(F.lit("recursive"), F.col("chunks"))).when(n % 7 == 3, F.create_map(F.lit("fixed_size"), F.col("chunks") + 2)).otherwise(F.col("by_strategy")),
        "by_type": F.when(n % 7 == 4, F.create_map(F.lit("text"), F.col("chunks") + 9)).otherwise(F.col("by_type"))})
    return V.counts(V.manifest_issues(made.where(n % 7 != 0), rows.where("doc_id % 7 <> 5")))


def embedding_file_issues(spark, sf):
    """Each document's chunks against vectors of which some are gone, out of order, or of another model or version."""
    rows = _chunk_rows(spark, sf).select("doc_id", "document_id", F.col("chunk_index").alias("position"), "chunk_id")
    n, first = F.col("doc_id"), F.col("position") == 0
    vectors = rows.where("not (doc_id % 8 = 1) and not (doc_id % 8 = 2 and position = 1)").select(
        "document_id", "position", F.when((n % 8 == 3) & first, F.lit("moved")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when((n % 8 == 4) & first, F.lit("b")).otherwise(F.lit("a")).alias("model_name"), F.when((n % 8 == 5) & first, F.lit("2")).otherwise(F.lit("1")).alias("embedding_version"))
    return V.counts(V.embedding_file_issues(rows, vectors))


def embedding_issues(spark, sf):
    v = _t(spark, sf, "embeddings")
    chunks = v.where("label % 5 <> 1").select(F.col("vec_id").cast("string").alias("chunk_id"))
    vectors = v.where("label % 5 <> 2").select(F.col("vec_id").cast("string").alias("chunk_id"), F.when(F.col("label") % 5 == 3, F.slice("embedding", 1, 10)).when(F.col("label") % 5 == 4, F.array(F.lit(float("nan")))).otherwise(F.col("embedding")).cast("array<double>").alias("vector"))
    return V.counts(V.embedding_issues(chunks, vectors, 64))


def raw_document_status(spark, sf):
    n = F.col("doc_id")
    page = F.array(F.struct(F.lit(1).alias("page_number"), F.when(n % 6 == 0, F.lit("")).when(n % 6 == 1, F.lit("ab")).otherwise(F.col("text")).alias("text"), (n % 5 == 0).alias("ocr_needed"), (n % 10 == 0).alias("ocr_used"), F.lit(False).alias("ocr_failed")))
    table = F.array(F.struct(F.lit("t").alias("table_id"), F.array(F.lit("a")).alias("headers"), F.when(n % 4 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("x")))).alias("rows")))
    docs = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("department"), F.lit("f").alias("filename"), F.lit(".txt").alias("file_type"), F.lit("h").alias("content_hash"), F.when(n % 8 == 0, F.lit("short")).otherwise(F.col("text")).alias("raw_text"), page.alias("pages"), table.alias("tables"),
        F.when(n % 12 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.lit(True).alias("json_ok"), F.concat(F.lit("original/"), "source", F.lit("/"), "lang", F.lit("/h/f")).alias("path"))
    found = V.raw_issues(docs)
    return V.status(docs, "doc_id", found).groupBy("status").agg(F.count("*").alias("n"))


def quality_by_language(spark, sf):
    found = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    return found.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").cast("long").alias("toxic"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (agg_count, agg_columns, agg_shape, describe, agg_sum, agg_mean, agg_min, agg_max, top_n, bottom_n, *map(_select, SQL), key_counts, rollup_counts, most_common, duplicate_content, duplicate_ids, latest_version, document_acl, scope_resolution, tool_permissions, catalog_listing, role_lists,
              stale_points, upserted, pending, semantic_cache, fact_recall, source_recall, citation_validate, citation_completeness, claim_citations, answer_gate, faithfulness_score, retrieval_dataset_issues, chunk_issues, chunk_layout_issues, chunk_manifest_issues, embedding_file_issues, embedding_issues, raw_document_status, quality_by_language)
}

_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS max FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
)
_USERS = "us AS (SELECT c_custkey AS user_id, 'src' || (c_custkey // 10 % 20) AS tenant_id, ['en', 'de', 'fr', 'es'][c_custkey % 4 + 1] AS department, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 2 = 0 THEN 'manager' ELSE 'employee' END AS role FROM customer)"
_CUT = f"string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"
_ANSWERS = f"""parts AS (SELECT doc_id, source, {_CUT} AS ps FROM documents),
answers AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN 'I do not know based on the provided context.' ELSE array_to_string(list_transform(ps, lambda s, k: s || CASE WHEN (k - 1) % 4 = 3 THEN ' [nobody].' WHEN (k - 1) % 3 = 0 THEN ' [' || source || '].' ELSE '' END), chr(10)) END AS answer FROM parts)"""
_NORM = f"trim(regexp_replace(lower(answer), '[{SPACE}]+', ' ', 'g'))"
_CITES = "list_transform(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1), lambda c: trim(c))"
_FACTS = " + ".join("(" + (" OR ".join(f"contains({_NORM}, '{p}')" for p in g) or "false") + ")::INT" for g in FACTS)
_UNITS = f"""units AS (SELECT doc_id, source, u, row_number() OVER (PARTITION BY doc_id ORDER BY l, k) AS n FROM (
  SELECT doc_id, source, l, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM (SELECT doc_id, source, l, string_split(regexp_replace(trim(line), '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)) AS us FROM (
    SELECT doc_id, source, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS l FROM answers))) WHERE trim(u) <> '')"""
ORACLE = {
    "agg_count": "SELECT count(*) AS count FROM orders",
    "agg_columns": "SELECT ordinal_position - 1 AS position, column_name AS name FROM information_schema.columns WHERE table_name = 'region'",
    "agg_shape": "SELECT count(*) AS rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders') AS columns FROM orders",
    "describe": _DESCRIBE,
    **{f"agg_{op}": f"SELECT round({f}(l_extendedprice), 4) AS {op} FROM lineitem" for op, f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"))},
    "top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7",
    "bottom_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7",
    **SQL,
    "key_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "rollup_counts": "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)",
    "most_common": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "duplicate_content": "SELECT digest, doc_id, n FROM (SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1",
    "duplicate_ids": "SELECT source, lang, n_chars, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
    "latest_version": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
    "document_acl": f"WITH {_USERS} SELECT user_id, count(*) AS n FROM us JOIN documents ON source = tenant_id AND (role = 'admin' OR lang = department) GROUP BY user_id",
    "scope_resolution": f"WITH {_USERS} SELECT user_id, CASE WHEN role = 'admin' THEN '*' WHEN user_id % 3 <> 0 AND user_id % 7 = 0 THEN '' ELSE department END AS departments FROM us",
    "tool_permissions": f"WITH {_USERS} SELECT DISTINCT role, role <> 'employee' AS sql, true AS search FROM us",
    "catalog_listing": "SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "role_lists": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "stale_points": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "upserted": "SELECT doc_id, length(text) + (doc_id IN (SELECT doc_id FROM labels))::INT AS n FROM documents",
    "pending": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)",
    "semantic_cache": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0),
      p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS place FROM s), k AS (SELECT * FROM p WHERE place <= 10 AND score >= 0.3 AND entry_id % 5 <> 0 AND (query_id % 3 = 0 OR entry_id % 3 < 2))
      SELECT query_id, entry_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS n FROM k) WHERE n = 1""",
    "fact_recall": f"WITH {_ANSWERS} SELECT doc_id, round(({_FACTS}) / {len(FACTS)}, 6) AS recall FROM answers",
    "source_recall": f"WITH {_ANSWERS} SELECT doc_id, round(len(list_intersect({_CITES}, list_distinct([source, 'src1']))) / len(list_distinct([source, 'src1'])), 6) AS recall FROM answers",
    "citation_validate": f"WITH {_ANSWERS} SELECT doc_id, CASE WHEN list_contains({_CITES}, source) THEN source ELSE '' END AS sources, len({_CITES}) AS n FROM answers",
    "citation_completeness": f"""WITH {_ANSWERS}, {_UNITS}, f AS (SELECT doc_id, n, contains(u, '[' || source || ']') AS cited, regexp_full_match(trim(u), '(\\s*\\[[^\\[\\]]+\\]\\s*)+') AS alone FROM units WHERE NOT ends_with(trim(u), ':') AND doc_id % 11 <> 0),
      g AS (SELECT *, sum(CASE WHEN alone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM f), h AS (SELECT doc_id, grp, bool_or(cited) AS cited FROM g WHERE grp > 0 GROUP BY ALL)
      SELECT doc_id, count(h.grp)::INT AS factual, count(*) FILTER (cited)::INT AS cited, round(CASE WHEN count(h.grp) = 0 THEN 1.0 ELSE count(*) FILTER (cited) / count(h.grp) END, 6)::DOUBLE AS score FROM answers LEFT JOIN h USING (doc_id) GROUP BY doc_id""",
    "claim_citations": f"""WITH {_ANSWERS}, l AS (SELECT doc_id, source, unnest(string_split(replace(answer, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(answer, chr(13) || chr(10), chr(10)), chr(10)), 1) AS l FROM answers),
      p AS (SELECT *, string_split(regexp_replace(trim(line), '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM l), v AS (SELECT doc_id, source, l, unnest(ps) AS answer, generate_subscripts(ps, 1) AS k FROM p),
      c AS (SELECT doc_id, source, l, k, list_contains({_CITES}, source) AS own,
        regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(answer), '{E.CITATION}', '', 'g'), '^\\s*([-*•]|\\d+[.)])\\s*', ''), '[{SPACE}]+', ' ', 'g')), '[ ,;:]+$', '') AS claim FROM v WHERE trim(answer) <> ''),
      w AS (SELECT *, len(regexp_extract_all(claim, '[^ ]+')) AS words FROM c),
      x AS (SELECT *, coalesce(last_value(CASE WHEN NOT own AND claim <> '' AND (words >= 4 OR regexp_matches(lower(claim), '{"|".join(E.PREFIX_MARKERS)}')) THEN claim END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY l, k), '') AS prefix FROM w)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l, k) - 1 AS claim_no, source AS citations,
        CASE WHEN prefix <> '' AND (words <= 6 OR regexp_matches(lower(claim), '^({"|".join(E.CONTINUATIONS)})')) THEN regexp_replace(prefix, '[ ,;:]+$', '') || ' ' || regexp_replace(claim, '^[ ,;:]+', '') ELSE claim END AS claim FROM x WHERE own AND claim <> ''""",
    "answer_gate": f"WITH {_ANSWERS} SELECT doc_id, md5(CASE WHEN doc_id % 11 = 0 OR NOT list_contains({_CITES}, source) THEN 'I do not know based on the provided context.' ELSE answer END) AS digest, doc_id % 11 = 0 AS abstains FROM answers",
    "faithfulness_score": """WITH v AS (SELECT l_orderkey % 500 AS case_id, l_linenumber AS claim_no, CASE WHEN l_returnflag = 'A' THEN 'S' WHEN l_returnflag = 'N' THEN 'P' WHEN l_linenumber = 7 THEN NULL ELSE 'U' END AS v FROM lineitem),
      c AS (SELECT case_id, claim_no, CASE WHEN count(v) > 0 AND count(*) FILTER (v = 'S') = count(v) THEN 1.0 WHEN count(*) FILTER (v IN ('S', 'P')) > 0 THEN 0.5 ELSE 0.0 END AS s FROM v GROUP BY ALL) SELECT case_id, count(*) AS n_claims, round(avg(s), 6) AS faithfulness FROM c GROUP BY case_id""",
    "retrieval_dataset_issues": """WITH c AS (SELECT item_id AS id, CASE WHEN item_id % 9 = 0 THEN ' ' WHEN item_id % 7 = 0 THEN 'same' ELSE text END AS q FROM benchmark), d AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id) AS n FROM c),
      i AS (SELECT unnest([CASE WHEN trim(q) = '' THEN 'EMPTY_QUERY' END, CASE WHEN trim(q) <> '' AND n > 1 THEN 'DUPLICATE_QUERY' END, CASE WHEN id % 5 = 0 THEN 'MISSING_TENANT' END, CASE WHEN id % 4 = 0 THEN 'NO_RELEVANT_DOCUMENTS' ELSE 'UNKNOWN_RELEVANT_DOCUMENT' END]) AS code FROM d)
      SELECT 'ERROR' AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY code""",
    "chunk_issues": f"""WITH {_CHUNKS}, c2 AS (SELECT doc_id, units, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nth FROM ch), i AS (SELECT unnest([CASE WHEN doc_id % 10 = 0 THEN 'CHUNK_DOCUMENT_MISMATCH' END, CASE WHEN doc_id % 23 = 0 THEN 'CHUNK_TENANT_MISMATCH' END, CASE WHEN doc_id % 29 = 0 THEN 'CHUNK_DEPARTMENT_MISMATCH' END,
      CASE WHEN doc_id % 31 = 0 THEN 'CHUNK_CONTENT_HASH_MISMATCH' END, CASE doc_id % 37 WHEN 0 THEN 'MISSING_TABLE_PROVENANCE' WHEN 1 THEN 'MISSING_PAGE_PROVENANCE' END, CASE WHEN doc_id % 13 = 0 THEN 'UNKNOWN_CHUNK_TYPE' END,
      CASE WHEN doc_id % 17 = 0 THEN 'NEGATIVE_CHUNK_INDEX' END, CASE WHEN doc_id % 17 = 0 AND nth > 1 THEN 'DUPLICATE_STRATEGY_INDEX' END, CASE WHEN doc_id % 19 = 0 THEN 'EMPTY_CHUNK_TEXT' END, CASE WHEN units > 500 THEN 'OVERSIZED_CHUNK' END]) AS code FROM c2) SELECT 'ERROR' AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY ALL""",
    "chunk_layout_issues": "SELECT 'ERROR' AS severity, ['TENANT_PATH_MISMATCH', 'DEPARTMENT_PATH_MISMATCH', 'CONTENT_HASH_PATH_MISMATCH', 'INVALID_DIRECTORY_LAYOUT'][doc_id % 10] AS code, count(*) AS n FROM documents WHERE doc_id % 10 BETWEEN 1 AND 4 GROUP BY ALL",
    "chunk_manifest_issues": f"""WITH {_CHUNKS}, own AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id), i AS (SELECT unnest(CASE doc_id % 7 WHEN 0 THEN ['MISSING_MANIFEST'] WHEN 1 THEN ['MANIFEST_CHUNK_COUNT_MISMATCH'] WHEN 2 THEN ['MANIFEST_STRATEGY_SET_MISMATCH'] WHEN 3 THEN ['STRATEGY_COUNT_MISMATCH'] WHEN 4 THEN ['CHUNK_TYPE_COUNT_MISMATCH'] WHEN 5 THEN ['MISSING_CHUNKS'] ELSE [] END) AS code FROM own)
      SELECT 'ERROR' AS severity, code, count(*) AS n FROM i GROUP BY code""",
    "embedding_file_issues": f"""WITH {_CHUNKS}, own AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id), i AS (SELECT CASE doc_id % 8 WHEN 1 THEN 'MISSING_EMBEDDING_FILE' WHEN 2 THEN CASE WHEN n > 1 THEN 'EMBEDDING_COUNT_MISMATCH' END WHEN 3 THEN 'CHUNK_ORDER_MISMATCH' WHEN 4 THEN CASE WHEN n > 1 THEN 'MODEL_NOT_CONSTANT' END WHEN 5 THEN CASE WHEN n > 1 THEN 'VERSION_NOT_CONSTANT' END END AS code FROM own)
      SELECT 'ERROR' AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY code""",
    "embedding_issues": """WITH n AS (SELECT label % 5 AS m FROM embeddings), i AS (SELECT unnest(CASE m WHEN 1 THEN ['UNKNOWN_CHUNK'] WHEN 2 THEN ['MISSING_EMBEDDING'] WHEN 3 THEN ['DIMENSION_MISMATCH'] WHEN 4 THEN ['DIMENSION_MISMATCH', 'NON_FINITE_VECTOR'] ELSE [] END) AS code FROM n)
      SELECT 'ERROR' AS severity, code, count(*) AS n FROM i GROUP BY code""",
    "raw_document_status": """WITH n AS (SELECT doc_id AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS m, CASE WHEN doc_id % 8 = 0 THEN 5 ELSE length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) END AS raw FROM documents)
      SELECT CASE WHEN n % 6 = 0 OR (n % 5 = 0 AND n % 10 <> 0) THEN 'ERROR' WHEN n % 6 = 1 OR n % 4 = 0 OR n % 12 = 0 OR raw < 50 OR (n % 6 > 1 AND m < 10) THEN 'WARNING' ELSE 'CLEAN' END AS status, count(*) AS n FROM n GROUP BY ALL""",
    "quality_by_language": "SELECT lang, round(avg(quality), 6) AS quality, sum(toxic)::BIGINT AS toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang",
}
