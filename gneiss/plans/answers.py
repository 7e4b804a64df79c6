"""Queries of judged answers, outcomes, remaining validators and catalog jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import answers as J, context as C, evaluation as E, retrieval as R, stores, tables as A, validation as V
from gneiss.plans import retrieval as P, tables as Q

OUTPUTS = ['```json\n{"verdict": "supported", "reason": "yes"}\n```', '{"verdict": "PARTIALLY_SUPPORTED", "reason": "some"}', '{"verdict": "maybe", "reason": "x"}', '{"verdict": "UNSUPPORTED", "reason": " "}', "no json", '{"verdict": "UNSUPPORTED", "reason": "none"}']
FACTS = [["the"], ["a", "e"]]


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def judge_parse(spark, sf):
    made = F.element_at(F.array(*map(F.lit, OUTPUTS)), (F.col("doc_id") % len(OUTPUTS)).cast("int") + 1)
    return _t(spark, sf, "documents").select("doc_id", J.parse_judgement(made).alias("j")).select("doc_id", "j.verdict", "j.error")


def claim_verdicts(spark, sf):
    verdict = F.when(F.col("l_returnflag") == "A", "SUPPORTED").when(F.col("l_returnflag") == "N", "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(J.claim_verdict(F.collect_list(verdict)).alias("verdict"))


def evidence(spark, sf):
    """Claims of answers with their document as the only chunk; two of three have no source."""
    claims = Q.claim_citations(spark, sf).select(F.col("doc_id").alias("case_id"), "claim_no", "claim", F.split("citations", ",").alias("citations"))
    chunks = _t(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.lit(0).alias("position"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"), "text")
    found = J.resolve_evidence(claims, chunks)
    return found.groupBy("case_id").agg(F.sum(F.size("evidence")).cast("long").alias("found"), F.sum(F.size("missing")).cast("long").alias("missing"))


def judge_prompts(spark, sf):
    made = J.judge_prompt(F.lit("claim"), F.col("source"), F.array("text", F.lit("two")))
    return _t(spark, sf, "documents").select("doc_id", F.md5(made).alias("digest"))


def rag_quality(spark, sf):
    facts = F.array(*[F.array(*map(F.lit, g)) for g in FACTS])
    cases = Q._answers(spark, sf).select(F.col("doc_id").alias("case_id"), "answer", F.when(F.col("doc_id") % 22 == 0, "unknown").otherwise("answer").alias("behaviour"), facts.alias("facts"), F.array("source").alias("expected_sources"), F.array("source").alias("allowed"))
    return J.quality_row(cases)


def prompt_behaviour(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, ("unknown", "conflict", "answer", "citation", "other"))), (F.col("doc_id") % 5).cast("int") + 1)
    sources = F.when(F.col("doc_id") % 3 == 0, F.array("source", F.lit("nobody"))).when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    return Q._answers(spark, sf).select("doc_id", J.behaves(F.col("answer"), sources, kinds).alias("met"))


def context_retention(spark, sf):
    """Whether a relevant document is still in the context, and the tokens before and after."""
    hits = P._hit_texts(spark, sf).select("query_id", "rank", "doc_id", "text")
    before = hits.groupBy("query_id").agg(F.sum(T.token_count(F.col("text"))).cast("long").alias("before"))
    context = C.build_context(hits, 1500)
    after = context.groupBy("query_id").agg(F.sum("tokens").cast("long").alias("after"))
    kept = context.join(P._relevant(spark, sf), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("kept"))
    every = before.join(after, "query_id", "left").join(kept, "query_id", "left")
    return every.select("query_id", "before", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce(F.col("kept") > 0, F.lit(False)).alias("retained"))


def retriever_overlap(spark, sf):
    """How many documents two rankings share for each query."""
    other, sparse = P._two_lists(spark, sf)
    return other.join(sparse.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("shared"))


def three_rankings(spark, sf):
    other, sparse = P._two_lists(spark, sf)
    lists = {"other": other, "sparse": sparse, "fused": R.fuse([other, sparse], 10)}
    out = None
    for name, hits in lists.items():
        own = hits.select(F.lit(name).alias("retriever"), "query_id", "doc_id", "rank")
        out = own if out is None else out.union(own)
    return out.groupBy("retriever").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def _outcomes(spark, sf):
    other, sparse = P._two_lists(spark, sf)
    gathered = lambda hits, name: hits.where("rank <= 3").groupBy("query_id").agg(F.collect_list("doc_id").alias(name))
    own = P._relevant(spark, sf).groupBy("query_id").agg(F.collect_list("doc_id").alias("expected"))
    every = own.join(gathered(other, "before"), "query_id").join(gathered(sparse, "after"), "query_id")
    return every.select("query_id", J.retrieval_outcome(F.col("before"), F.col("after"), F.col("expected")).alias("outcome"))


def retrieval_outcomes(spark, sf):
    return _outcomes(spark, sf)


def contextualised_hits(spark, sf):
    """Outcomes of searching each item's first twelve words, and its words from the fifth to the fortieth: whether the second finds what it should in the first three."""
    words = F.split("query", " ")
    cut = lambda a, n: P._queries(spark, sf).withColumn("query", F.array_join(F.slice(words, a, n), " "))
    gathered = lambda queries, name: R.ranked(P._sparse(spark, sf, queries), 3, "doc_id").groupBy("query_id").agg(F.collect_list("doc_id").alias(name))
    own = P._relevant(spark, sf).groupBy("query_id").agg(F.collect_list("doc_id").alias("expected"))
    none = F.array().cast("array<bigint>")
    every = own.join(gathered(cut(1, 12), "before"), "query_id", "left").join(gathered(cut(5, 36), "after"), "query_id", "left")
    return every.select("query_id", J.retrieval_outcome(F.coalesce("before", none), F.coalesce("after", none), F.col("expected")).alias("outcome"))


def retrieval_decision(spark, sf):
    return J.decision(_outcomes(spark, sf))


def memory_outcomes(spark, sf):
    a = Q._answers(spark, sf)
    first = F.when(F.col("doc_id") % 4 == 0, F.lit(E.ABSTENTION_ANSWER)).otherwise(F.col("answer"))
    return a.groupBy(J.memory_outcome(first, F.col("answer"), F.size(E.valid_citations(F.col("answer"), F.array("source"))) > 0).alias("outcome")).agg(F.count("*").alias("n"))


def contextualise(spark, sf):
    """Queries after a history: each third is rewritten, each fourth's rewriting is invalid."""
    n = F.col("item_id")
    made = F.when(n % 4 == 0, F.lit("a <task> b")).when(n % 3 == 0, F.concat(F.lit('"Rewritten query:  '), "text", F.lit(' "'))).otherwise(F.concat(F.lit("more "), "text"))
    found = J.contextualised(F.col("text"), F.when(n % 5 == 0, "").otherwise("said before"), made)
    return _t(spark, sf, "benchmark").select("item_id", found.alias("c")).select("item_id", "c.rewritten", F.md5(T.normalised(F.col("c.query"))).alias("digest"))


def history_select(spark, sf):
    turns = C.paired_turns(_t(spark, sf, "conversations")).withColumnsRenamed({"conv_id": "conversation_id"}).withColumn("tenant_id", F.lit("t"))
    return C.memory(turns, 3, 1200).groupBy("conversation_id").agg(F.count("*").alias("turns"), F.max("turn_no").alias("last"))


def corpus_sync(spark, sf):
    """Documents as paths: created, skipped or ignored."""
    path = F.concat(F.lit("seed/"), F.when(F.col("doc_id") % 9 == 0, "misc").otherwise(F.col("lang")), F.lit("/en/"), F.col("doc_id"), F.lit(".txt"))
    path = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("seed/misc/"), F.col("doc_id"), F.lit(".txt"))).otherwise(path)
    docs = _t(spark, sf, "documents").select(path.alias("path"), F.lit("t").alias("tenant_id"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    found = docs.withColumn("department", J.department_of(F.col("path"), ("en", "de", "fr", "es")))
    done = J.new_uploads(found, docs.join(_t(spark, sf, "labels"), "doc_id", "left_semi"))
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


def _clean_pairs(spark, sf):
    n = F.col("doc_id")
    pages = lambda k: F.array(F.struct(k.alias("page_number"), F.lit(False).alias("ocr_used")))
    table = F.array(F.struct(F.lit("t").alias("table_id"), F.lit(1).alias("n_rows")))
    return _t(spark, sf, "documents").select(
        "doc_id", F.when(n % 10 == 0, n + 1).otherwise(n).alias("clean_doc_id"), F.col("text").alias("raw_text"), F.when(n % 4 == 0, F.lit("abc")).when(n % 7 == 0, F.lit(" ")).otherwise(F.concat("text", F.when(n % 9 == 0, F.col("text")).otherwise(""))).alias("clean_text"),
        pages(F.lit(1)).alias("raw_pages"), pages(F.when(n % 6 == 0, 2).otherwise(1)).alias("clean_pages"), table.alias("raw_tables"), F.when(n % 8 == 0, F.slice(table, 1, 0)).otherwise(table).alias("clean_tables"), F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))).alias("steps"))


def clean_pair_issues(spark, sf):
    """The issues of metadata, pages, tables and steps; clean_pair_all_issues has those of the texts too."""
    return V.counts(V.clean_issues(_clean_pairs(spark, sf)).where("code not in ('LOW_TEXT_RETENTION', 'UNEXPECTED_TEXT_EXPANSION', 'EMPTY_CLEAN_TEXT')"))


def clean_pair_all_issues(spark, sf):
    """All issues of the clean_pair_issues documents, those of the texts themselves too."""
    return V.counts(V.clean_issues(_clean_pairs(spark, sf)))


def vector_point_issues(spark, sf):
    """Points of which each sixteenth lacks another payload field, and others repeat, are blank, or have a wrong vector or none."""
    v, n = _t(spark, sf, "embeddings"), F.col("vec_id")
    text = {c: F.when(n % 16 != k, F.lit("0" if c == "chunk_index" else "x")) for k, c in enumerate(V.PAYLOAD) if c != "chunk_id"}
    text |= {"chunk_id": F.when(n % 16 == 11, n - 1).otherwise(n).cast("string"), "text": F.when(n % 16 == V.PAYLOAD.index("text"), None).when(n % 16 == 12, F.lit(" ")).otherwise(F.lit("x"))}
    points = v.select(*[c.alias(k) for k, c in text.items()], F.when(n % 16 == 13, F.lit(None)).when(n % 16 == 14, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"))
    return V.counts(V.vector_issues(points, 64))


def cache_entries(spark, sf):
    """Events as cached answers that live an hour: how many are left at a time, by type."""
    cache = _t(spark, sf, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return A.fresh_entries(cache, F.lit("2024-01-02 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n"))


def point_ids(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", stores.point_id(F.col("doc_id").cast("string")).alias("point_id"))


def hybrid_topk(spark, sf):
    """Sparse and, by the stand-in embedder, dense rankings of the documents, fused."""
    return R.fuse([P._dense(spark, sf), P.bm25_topk(spark, sf)], 10)


QUERIES = {f.__name__: f for f in (judge_parse, claim_verdicts, evidence, judge_prompts, rag_quality, prompt_behaviour, context_retention, retriever_overlap, three_rankings, retrieval_outcomes, contextualised_hits, retrieval_decision, memory_outcomes, contextualise, history_select, corpus_sync, clean_pair_issues, clean_pair_all_issues, vector_point_issues, cache_entries, point_ids, hybrid_topk)}

_A, _CITES, _NORM, _UNITS, _S = Q._ANSWERS, Q._CITES, Q._NORM, Q._UNITS, T.SPACE
_COMPLETE = f"""{_UNITS}, f AS (SELECT doc_id, n, contains(u, '[' || source || ']') AS cited, regexp_full_match(trim(u), '(\\s*\\[[^\\[\\]]+\\]\\s*)+') AS alone FROM units WHERE NOT ends_with(trim(u), ':') AND doc_id % 11 <> 0),
g AS (SELECT *, sum(CASE WHEN alone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM f), h AS (SELECT doc_id, grp, bool_or(cited) AS cited FROM g WHERE grp > 0 GROUP BY ALL),
comp AS (SELECT doc_id, round(CASE WHEN count(h.grp) = 0 THEN 1.0 ELSE count(*) FILTER (cited) / count(h.grp) END, 6)::DOUBLE AS completeness FROM answers LEFT JOIN h USING (doc_id) GROUP BY doc_id)"""
_FACTS = " + ".join("(" + " OR ".join(f"contains({_NORM}, '{p}')" for p in g) + ")::INT" for g in FACTS)
_OUT = f"""{P._BM25}, {P._TWO}, {P._RELEVANT}, o AS (SELECT query_id, coalesce(bool_or(other.rank <= 3), false) AS had, coalesce(bool_or(sparse.rank <= 3), false) AS has FROM rel LEFT JOIN other USING (query_id, doc_id) LEFT JOIN sparse USING (query_id, doc_id) GROUP BY query_id),
oc AS (SELECT query_id, CASE WHEN NOT had AND has THEN 'IMPROVED' WHEN had AND NOT has THEN 'REGRESSED' ELSE 'UNCHANGED' END AS outcome FROM o)"""
_N = lambda x: f"trim(regexp_replace(lower({x}), '[{_S}]+', ' ', 'g'))"
ORACLE = {
    "judge_parse": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 5 THEN 'UNSUPPORTED' END AS verdict, CASE doc_id % 6 WHEN 2 THEN 'invalid verdict' WHEN 3 THEN 'empty reason' WHEN 4 THEN 'invalid JSON' END AS error FROM documents",
    "claim_verdicts": "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'A') THEN 'SUPPORTED' WHEN bool_or(l_returnflag IN ('A', 'N')) THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM lineitem GROUP BY l_orderkey",
    "evidence": f"WITH {_A}, {_UNITS}, c AS (SELECT doc_id, count(*) AS n FROM units WHERE contains(u, '[' || source || ']') AND trim(regexp_replace(u, '\\[[^\\[\\]]+\\]', '', 'g'), ' ,;:') <> '' GROUP BY doc_id) SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN n ELSE 0 END AS found, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n END AS missing FROM c",
    "judge_prompts": "SELECT doc_id, md5('Source: ' || source || chr(10) || '<chunk id=\"1\">' || chr(10) || text || chr(10) || '</chunk>' || chr(10) || '<chunk id=\"2\">' || chr(10) || 'two' || chr(10) || '</chunk>' || chr(10) || 'Claim: claim' || chr(10) || 'Answer in JSON with verdict and reason.') AS digest FROM documents",
    "rag_quality": f"""WITH {_A}, {_COMPLETE}, q AS (SELECT doc_id AS case_id, trim(answer) <> '' AS answer_present, (doc_id % 11 = 0) = (doc_id % 22 = 0) AS abstention_correct, round(({_FACTS}) / {len(FACTS)}, 6) AS fact_recall, list_contains({_CITES}, source)::INT::DOUBLE AS source_recall, completeness FROM answers JOIN comp USING (doc_id))
      SELECT *, answer_present AND abstention_correct AND fact_recall = 1 AND source_recall = 1 AND completeness = 1 AS passed FROM q""",
    "prompt_behaviour": f"""WITH {_A}, s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN [source, 'nobody'] WHEN doc_id % 11 = 0 THEN [] ELSE [source] END AS ss, doc_id % 11 = 0 AS unk FROM answers)
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN unk AND len(ss) = 0 WHEN 1 THEN NOT unk AND regexp_matches(lower(answer), 'conflict|different|inconsistent') AND len(ss) >= 2 WHEN 2 THEN trim(answer) <> '' AND NOT unk AND len(ss) > 0
        WHEN 3 THEN trim(answer) <> '' AND NOT unk AND len(ss) > 0 AND len(list_filter(ss, lambda x: NOT contains(answer, '[' || x || ']'))) = 0 ELSE false END AS met FROM s""",
    "context_retention": f"""WITH RECURSIVE {P._BM25}, {P._HITS}, {P._CONTEXT}, {P._RELEVANT}, b AS (SELECT query_id, sum(tokens)::BIGINT AS before FROM rows GROUP BY query_id), a AS (SELECT query_id, sum(tokens)::BIGINT AS after FROM ctx GROUP BY query_id)
      SELECT query_id, before, coalesce(after, 0) AS after, EXISTS (SELECT 1 FROM ctx JOIN rel USING (query_id, doc_id) WHERE ctx.query_id = b.query_id) AS retained FROM b LEFT JOIN a USING (query_id)""",
    "retriever_overlap": f"WITH {P._BM25}, {P._TWO} SELECT query_id, count(*) AS shared FROM other JOIN sparse USING (query_id, doc_id) GROUP BY query_id",
    "three_rankings": f"WITH {P._BM25}, {P._TWO}, {P._fused('f', 10)}, e AS (SELECT 'other' AS retriever, doc_id FROM other UNION ALL SELECT 'sparse', doc_id FROM sparse UNION ALL SELECT 'fused', doc_id FROM f) SELECT retriever, count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY retriever",
    "retrieval_outcomes": f"WITH {_OUT} SELECT * FROM oc",
    "contextualised_hits": f"""WITH {P._BM25.replace("q AS (SELECT item_id AS query_id, text AS query FROM benchmark)", "q0 AS (SELECT item_id AS query_id, text AS query FROM benchmark), q AS (SELECT query_id * 2 AS query_id, array_to_string(string_split(query, ' ')[1:12], ' ') AS query FROM q0 UNION ALL SELECT query_id * 2 + 1, array_to_string(string_split(query, ' ')[5:40], ' ') FROM q0)")},
      rel AS (SELECT DISTINCT query_id, doc_id FROM q0, d WHERE contains(d.text, q0.query)), o AS (SELECT query_id, coalesce(bool_or(b.rank <= 3), false) AS had, coalesce(bool_or(a.rank <= 3), false) AS has FROM rel LEFT JOIN (SELECT query_id // 2 AS query_id, doc_id, rank FROM top WHERE query_id % 2 = 0) b USING (query_id, doc_id) LEFT JOIN (SELECT query_id // 2 AS query_id, doc_id, rank FROM top WHERE query_id % 2 = 1) a USING (query_id, doc_id) GROUP BY query_id)
      SELECT query_id, CASE WHEN NOT had AND has THEN 'IMPROVED' WHEN had AND NOT has THEN 'REGRESSED' ELSE 'UNCHANGED' END AS outcome FROM o""",
    "retrieval_decision": f"WITH {_OUT} SELECT CASE WHEN count(*) FILTER (outcome = 'REGRESSED') > 0 THEN 'regressions' WHEN count(*) FILTER (outcome = 'IMPROVED') > 0 THEN 'improved' ELSE 'no improvement' END AS decision FROM oc",
    "memory_outcomes": f"""WITH {_A}, m AS (SELECT doc_id % 4 = 0 OR doc_id % 11 = 0 AS was, doc_id % 11 = 0 AS now, doc_id % 11 <> 0 AND list_contains({_CITES}, source) AS cited FROM answers)
      SELECT CASE WHEN was AND NOT now AND cited THEN 'IMPROVED' WHEN NOT was AND now THEN 'REGRESSED' ELSE 'UNCHANGED' END AS outcome, count(*) AS n FROM m GROUP BY ALL""",
    "contextualise": f"""WITH c AS (SELECT item_id, text, CASE WHEN item_id % 5 = 0 OR item_id % 4 = 0 OR item_id % 3 = 0 THEN text ELSE 'more ' || text END AS q FROM benchmark) SELECT item_id, {_N('q')} <> {_N('text')} AS rewritten, md5({_N('q')}) AS digest FROM c""",
    "history_select": P.ORACLE["memory_window"].split("SELECT conv_id AS conversation_id")[0].replace("1500", "1200").replace("t.age <= 5", "t.age <= 3") + "SELECT conv_id AS conversation_id, count(*) AS turns, max(turn) AS last FROM f WHERE taken GROUP BY conv_id",
    "corpus_sync": """WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 9 = 0 AS ign, CASE WHEN doc_id % 9 = 0 THEN 'seed/misc/' || doc_id || '.txt' ELSE 'seed/' || lang || '/en/' || doc_id || '.txt' END AS path FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ign, path) AS nth, h IN (SELECT h FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) AS known FROM d) SELECT CASE WHEN ign THEN 'ignored' WHEN known OR nth > 1 THEN 'skipped' ELSE 'created' END AS outcome, count(*) AS n FROM n GROUP BY ALL""",
    "clean_pair_issues": """WITH i AS (SELECT unnest([CASE WHEN doc_id % 10 = 0 THEN 'DOCUMENT_IDENTITY_MISMATCH' END, CASE WHEN doc_id % 6 = 0 THEN 'PAGE_NUMBER_MISMATCH' END, CASE WHEN doc_id % 8 = 0 THEN 'TABLE_COUNT_MISMATCH' END, CASE WHEN doc_id % 11 = 0 THEN 'NO_CLEANING_STEPS_RECORDED' END]) AS code FROM documents)
      SELECT CASE WHEN code = 'NO_CLEANING_STEPS_RECORDED' THEN 'WARNING' ELSE 'ERROR' END AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY ALL""",
    "clean_pair_all_issues": f"""WITH p AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'abc' WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 9 = 0 THEN text || text ELSE text END AS made FROM documents),
      b AS (SELECT *, NOT regexp_matches(text, '[^{_S}]') AS raw_blank, NOT regexp_matches(made, '[^{_S}]') AS made_blank FROM p),
      c AS (SELECT *, CASE WHEN NOT raw_blank AND NOT made_blank THEN length(made) / length(text) END AS share FROM b),
      i AS (SELECT unnest([CASE WHEN doc_id % 10 = 0 THEN 'DOCUMENT_IDENTITY_MISMATCH' END, CASE WHEN text IS NULL THEN 'INVALID_RAW_TEXT' END, CASE WHEN made IS NULL THEN 'INVALID_CLEAN_TEXT' END, CASE WHEN made_blank THEN 'EMPTY_CLEAN_TEXT' END, CASE WHEN share < 0.5 THEN 'LOW_TEXT_RETENTION' END, CASE WHEN share > 1.2 THEN 'UNEXPECTED_TEXT_EXPANSION' END,
        CASE WHEN doc_id % 6 = 0 THEN 'PAGE_NUMBER_MISMATCH' END, CASE WHEN doc_id % 8 = 0 THEN 'TABLE_COUNT_MISMATCH' END, CASE WHEN doc_id % 11 = 0 THEN 'NO_CLEANING_STEPS_RECORDED' END]) AS code FROM c)
      SELECT CASE WHEN code IN ('NO_CLEANING_STEPS_RECORDED', 'LOW_TEXT_RETENTION', 'UNEXPECTED_TEXT_EXPANSION') THEN 'WARNING' ELSE 'ERROR' END AS severity, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY ALL""",
    "vector_point_issues": """WITH i AS (SELECT unnest(CASE WHEN vec_id % 16 BETWEEN 1 AND 9 THEN ['MISSING_PAYLOAD_FIELDS'] WHEN vec_id % 16 = 10 THEN ['MISSING_PAYLOAD_FIELDS', 'EMPTY_TEXT'] WHEN vec_id % 16 = 11 THEN ['DUPLICATE_CHUNK'] WHEN vec_id % 16 = 12 THEN ['EMPTY_TEXT']
      WHEN vec_id % 16 = 13 THEN ['MISSING_VECTOR'] WHEN vec_id % 16 = 14 THEN ['DIMENSION_MISMATCH'] ELSE [] END) AS code FROM embeddings) SELECT 'ERROR' AS severity, code, count(*) AS n FROM i GROUP BY code""",
    "point_ids": """SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id
      FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR)) AS h FROM documents)""",
    "hybrid_topk": f"WITH {P._BM25}, {P._TWO}, {P._fused('f', 10)} SELECT * FROM f",
    "cache_entries": "SELECT event_type, count(*) AS n FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-02 00:00:00' GROUP BY event_type",
}
