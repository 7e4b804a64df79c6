"""Retrieval, fusion, context, evaluation, catalog, sources: literal cases."""

from __future__ import annotations

import io
import math
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import context as C, evaluation as E, profiles as P, retrieval as R, sparse_index, stores, tables as A, validation as V
from gneiss.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_bm25_scores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "refund policy policy"), (2, "refund window"), (3, "shipping"), (4, "")], "doc_id long, text string")
    index = sparse_index.build_sparse_index(docs, str(tmp_path / "index"))
    assert index.documents == 4 and index.average_length == 1.5
    idf = {r.term: r.idf for r in index.idf.collect()}
    assert idf["policy"] == pytest.approx(math.log(3.5) - math.log(1.5)) and idf["refund"] == pytest.approx(0)
    hits = R.sparse_scores(index, spark.createDataFrame([(1, "Policy policy zzz")], "query_id long, query string")).collect()
    want = 2 * idf["policy"] * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.5))
    assert [(h.doc_id, h.score) for h in hits] == [(1, pytest.approx(want, abs=1e-6))]


def test_sparse_index_is_loaded_for_the_same_corpus_and_checked_against_it(spark, tmp_path):
    rows = [(1, "a b b"), (2, None), (3, ""), (4, "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = sparse_index.sparse_index(docs, str(tmp_path))
    again = sparse_index.sparse_index(docs.orderBy(F.desc("doc_id")), str(tmp_path))
    assert made.postings.inputFiles() == again.postings.inputFiles() and again.documents == 4 and again.average_length == 5 / 3
    assert {(r.doc_id, r.dl, r.term, r.tf) for r in made.postings.collect()} == {(1, 3, "a", 1), (1, 3, "b", 2), (4, 2, "b", 1), (4, 2, "c", 1)}
    path = made.postings.inputFiles()[0].split("/postings")[0]
    assert sparse_index.sparse_index_issues(docs, path).count() == 0
    other = spark.createDataFrame([(1, "a b"), (5, "z")], "doc_id long, text string")
    found = sorted((r.subject, r.code) for r in sparse_index.sparse_index_issues(other, path).collect())
    assert found == [("1", "LENGTH_MISMATCH"), ("4", "UNKNOWN_DOCUMENT"), ("5", "MISSING_DOCUMENT"), ("manifest", "CORPUS_HASH_MISMATCH"), ("manifest", "DOCUMENT_COUNT_MISMATCH")]
    assert [r.code for r in sparse_index.sparse_index_issues(docs, str(tmp_path / "none")).collect()] == ["MISSING_MANIFEST"]
    empty = sparse_index.sparse_index(docs.limit(0), str(tmp_path))
    assert empty.documents == 0 and empty.postings.count() == 0 and empty.idf.count() == 0


def test_containing_against_brute_force(spark):
    import random

    rng = random.Random(6)
    docs = [(k, "".join(rng.choice(["a", "b ", "cc ", " ", "\n", "dog "]) for _ in range(rng.randint(0, 200)))) for k in range(60)] + [(99, None)]
    queries = [(k, docs[rng.randrange(60)][1][a : a + n]) for k, (a, n) in enumerate([(rng.randint(0, 40), rng.randint(0, 70)) for _ in range(80)])] + [(200, None), (201, "nowhere to be found at all"), (202, "x")]
    got = R.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"))
    assert sorted(map(tuple, got.collect())) == sorted((q, d) for q, own in queries for d, t in docs if own is not None and t is not None and own in t)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in R.fuse([a, b]).orderBy("rank").collect()] == [20, 10, 30]
    assert [r.doc_id for r in R.fuse([a, b], 2, weights=[1.0, 2.0]).orderBy("rank").collect()] == [20, 30]
    for bad in (dict(limit=0), dict(k=0), dict(weights=[1.0])):
        with pytest.raises(ValueError):
            R.fuse([a, b], **bad)


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, vector array<double>")
    score = lambda m: {r.doc_id: r.score for r in R.dense_scores(v, q, metric=m).collect()}
    assert score("cosine") == {1: 0.707107, 2: 0.707107, 3: 0.0}
    assert score("dot") == {1: 1.0, 2: 2.0, 3: 0.0} and score("euclid") == {1: -1.0, 2: -1.414214, 3: -1.414214}
    assert [r.doc_id for r in R.ranked(R.dense_scores(v, q, 1), 1, "doc_id").collect()] == [1]
    assert R.dense_scores(v, q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.dense_scores(v, q, 0)


def test_departments_are_cut_apart_and_only_sparse_ones_again(spark):
    hits = spark.createDataFrame([(1, d, dep, s, ["a", "b"]) for d, dep, s in ((1, "a", 0.9), (2, "a", 0.8), (3, "b", 0.7), (4, "b", 0.6))], "query_id long, doc_id long, department string, score double, departments array<string>")
    assert [r.doc_id for r in R.per_department(hits, 1, False).orderBy("rank").collect()] == [1, 3]
    assert [r.doc_id for r in R.per_department(hits, 1, True).collect()] == [1]


def test_negative_best_rerank_score_keeps_nothing(spark):
    hits = spark.createDataFrame([(1, 1, 1, -1.0), (1, 2, 2, -0.05), (2, 1, 1, 1.0), (2, 2, 2, 0.09), (2, 3, 3, 0.1)], "query_id long, doc_id long, rank int, s double")
    got = R.rerank(hits, F.col("s")).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(2, 1), (2, 3)]


def folded(spark, rows, fold, **how):
    kind = "rows array<struct<id:string,text:string,tokens:int>>"
    return [r["id"] for r in spark.createDataFrame([(rows,)], kind).select(fold(F.col("rows"), **how).alias("r")).first().r]


def test_context_folds(spark):
    assert folded(spark, [("c1", "t1", 1), ("c1", "t2", 1), ("c2", "T2 ", 1)], C.dedupe_fold) == ["c1", "c2"]
    assert folded(spark, [(str(k), "", n) for k, n in enumerate((900, 1800, 500, 200, 400, 0, -1))], C.budget_fold) == ["0", "1", "3"]


def test_memory(spark):
    turns = spark.createDataFrame([("t", "c", k, "u" * 5, "a" * 5) for k in range(3)], "tenant_id string, conversation_id string, turn_no int, user_message string, assistant_message string")
    assert [r.turn_no for r in C.memory(turns, 5, 20).orderBy("position").collect()] == [1, 2]


def test_unit_selection(spark):
    text = "alpha beta\n\nrow | one\nrow | two\n\ngamma refund"
    got = one(spark, C.select_units(F.lit("refund two"), F.lit(text)).alias("a"), C.select_units(F.lit("the of"), F.lit(text)).alias("b"), C.select_units(F.lit("nothing"), F.lit(text)).alias("c"))
    assert got.a == "row | two\n\ngamma refund" and got.b == text and got.c == "alpha beta\n\nrow | one\n\nrow | two"


def test_rewrites(spark):
    cases = {'"Standalone query: what  is it?"': "what is it?", "'x'": "x", "  ": None, "a <task> b": None, "x" * 1001: None, "Query: stays": "Query: stays", "sources": "sources"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", C.clean_rewrite(F.col("t")).alias("c")).collect()} == cases


def test_metrics(spark):
    got = one(
        spark, E.recall_at(arr("a", "b", "a"), arr("a", "c"), 2).alias("r"), E.recall_at(arr("a"), arr(), 1).alias("r0"), E.reciprocal_rank(arr("x", "a"), arr("a")).alias("rr"), E.reciprocal_rank(arr("x"), arr("a")).alias("rr0"),
        E.source_recall(arr(), arr()).alias("s0"), E.fact_recall(F.lit("The  Refund"), F.array(arr("the refund", "no"), arr("zzz"), arr())).alias("f"), E.fact_recall(F.lit("x"), F.array().cast("array<array<string>>")).alias("f0"),
        E.abstains(F.lit("Well, I do not know based on the\nprovided context.")).alias("ab"), E.gated(F.lit("x"), arr()).alias("g"), E.gated(F.lit("x"), arr("s")).alias("g1"),
    )
    assert (got.r, got.r0, got.rr, got.rr0, got.s0, got.f0, got.ab) == (0.5, 0.0, 0.5, 0.0, 1.0, 1.0, True)
    assert got.f == pytest.approx(1 / 3) and got.g == E.ABSTENTION_ANSWER and got.g1 == "x"
    with pytest.raises(ValueError):
        E.recall_at(arr("a"), arr("a"), 0)


def test_failures(spark):
    n = F.lit(None).cast("int")
    names = [E.failure(*c) for c in ((F.lit(1), n, F.lit(1)), (n, F.lit(2), F.lit(3)), (n, n, n), (n, F.lit(1), n), (F.lit(1), n, n), (F.lit(2), F.lit(3), n))]
    assert list(one(spark, *names)) == ["success_rank_1", "success_low_rank", "both_retrievers_miss", "dense_miss_fusion_failure", "sparse_miss_fusion_failure", "fusion_ranking_failure"]


def complete(spark, answer, *allowed):
    c = one(spark, E.completeness(F.lit(answer), arr(*allowed)).alias("c")).c
    return c.factual, c.cited, c.score


def test_completeness(spark):
    assert complete(spark, "A is b [a.md]. C is d.", "a.md") == (2, 1, 0.5)
    assert complete(spark, "Intro:\n- A is b.\n[a.md]", "a.md") == (1, 1, 1.0)
    assert complete(spark, "[a.md]", "a.md") == (0, 0, 1.0)
    assert complete(spark, "", "a.md") == (0, 0, 1.0)
    assert complete(spark, "I do not know based on the provided context.", "a.md") == (0, 0, 1.0)
    assert complete(spark, "A [zero0] b", "zero0") == (1, 1, 1.0)
    assert complete(spark, "A [b.md]", "a.md") == (1, 0, 0.0)


def test_claims(spark):
    got = one(spark, E.claims(F.lit("The limits differ between these plans:\n- basic 5 [a.md]\n2) pro 9 [b.md] [x]\nA full sentence of more than six words stands alone [a.md]."), arr("a.md", "b.md")).alias("c")).c
    assert [(c.claim, c.citations) for c in got] == [("The limits differ between these plans basic 5", ["a.md"]), ("The limits differ between these plans pro 9", ["b.md"]), ("A full sentence of more than six words stands alone .", ["a.md"])]


def test_profile_and_routes(spark):
    rows = [(1, ".md", "# Ab\n\nSome words.\n\nMORE TEXT\n\nlast one", None, None), (2, ".pdf", "x", ["t"], [2]), (3, ".pdf", "", None, None), (4, ".htm", "x", None, None), (5, ".csv", "x", None, [0]), (6, ".json", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, file_type string, text string, pages array<string>, tables array<int>")
    profiles = P.profile(df)
    first = profiles.where("doc_id = 1").first()
    assert (first.heading_count, first.paragraph_count, first.structure_confidence) == (2, 4, 0.6)
    got = {r.doc_id: ([(d.strategy, d.priority) for d in r.decisions], r.error is None) for r in P.route(profiles).collect()}
    assert got == {1: ([("structure_aware", 100)], True), 2: ([("page_aware", 100), ("table_aware", 90)], True), 3: ([], False), 4: ([("recursive", 10)], True), 5: ([("recursive", 50)], True), 6: ([("json_aware", 100)], True)}


def test_cleaning_steps(spark):
    dirty = "  ﬁle\r\n​ a \t b \r\r\n\n\n\n c d \x00"
    assert one(spark, T.clean(F.lit(dirty)).alias("c")).c == "file\na b\n\nc d"


def test_analytics(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, 7.0), (5, 7.0)], "k int, v double")
    assert [A.analyse(df, op, "v").first()[0] for op in ("sum", "Mean", "min", "MAX")] == [16.0, pytest.approx(16 / 3), 2.0, 7.0]
    assert A.analyse(df.limit(0), "sum", "v").first()[0] == 0.0
    assert [r.k for r in A.analyse(df.where("v > 0 and not isnan(v)"), "top_n", "v", 2).collect()] == [4, 5]
    with pytest.raises(A.ColumnNotFoundError):
        A.analyse(df, "sum", "zz")
    with pytest.raises(A.UnsupportedOperationError):
        A.analyse(df, "median", "v")


@pytest.mark.parametrize("query", ["WITH a AS (SELECT 1) SELECT * FROM a", "DROP TABLE x", "", "select 1; drop table x"])
def test_only_select(spark, query):
    with pytest.raises(A.UnsupportedQueryError):
        A.select_only(spark, query)


def test_select(spark):
    assert A.select_only(spark, "  SELECT 1 AS a;").first().a == 1


def test_scope(spark):
    cases = [("admin", None, ["*"]), ("user", None, ["hr"]), ("user", ["*"], ["hr"]), ("user", ["hr", "x"], ["hr"]), ("user", ["x"], []), ("knowledge_admin", ["x"], ["*"])]
    df = spark.createDataFrame([(k, r, q) for k, (r, q, _) in enumerate(cases)], "k int, role string, asked array<string>")
    assert [r.s for r in df.orderBy("k").select(A.scope(F.col("role"), F.lit("hr"), F.col("asked")).alias("s")).collect()] == [c[2] for c in cases]


def test_cache_takes_the_first_ten_before_the_threshold(spark):
    queries = spark.createDataFrame([(1, "t", ["a"])], "query_id long, tenant_id string, departments array<string>")
    cache = spark.createDataFrame([(k, "t", ["b"] if k < 10 else ["a"]) for k in range(12)], "entry_id long, tenant_id string, answer_departments array<string>")
    scores = spark.createDataFrame([(1, k, 0.99 - k / 100) for k in range(12)], "query_id long, entry_id long, score double")
    assert A.cached_answers(queries, cache, scores).count() == 0
    assert A.cached_answers(queries, cache.where("entry_id > 2"), scores).first().entry_id == 10


def test_stores(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    assert stores.up_to_date(chunks, vectors, 2).first().current is True
    assert stores.up_to_date(chunks, vectors.where("chunk_id = 'a'"), 2).first().current is False
    assert stores.up_to_date(chunks, vectors, 3).first().current is False
    assert {r.point_id for r in stores.points(chunks, vectors).collect()} == {str(uuid.uuid5(uuid.NAMESPACE_URL, c)) for c in "ab"}
    with pytest.raises(ValueError):
        stores.points(chunks, vectors.limit(1))
    one_way, other = (stores.corpus_hash(df, "chunk_id", "text").first().sha256 for df in (chunks, chunks.orderBy(F.desc("chunk_id"))))
    assert one_way == other
    stores.write_json_lines(chunks, str(tmp_path / "c"))
    assert stores.read_json_lines(spark, str(tmp_path / "c"), "chunk_id string, text string").count() == 2
    stores.write_partitions(chunks.withColumn("p", F.col("chunk_id")), str(tmp_path / "p"), "p")
    stores.write_partitions(chunks.where("chunk_id = 'a'").withColumn("text", F.lit("new")).withColumn("p", F.col("chunk_id")), str(tmp_path / "p"), "p")
    assert {(r.chunk_id, r.text) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", "new"), ("b", "y")}


def test_validators(spark):
    chunks = spark.createDataFrame([("i", "d", "d", "t", "t", "recursive", "text", 0, "x", 1, [], [], "p", "p", "h", "h", []), ("i", "d", "e", "t", "u", "odd", "text", 0, " ", 0, [], [], "p", "q", "h", "g", [])], "chunk_id string, document_id string, expected_document_id string, tenant_id string, expected_tenant_id string, strategy string, chunk_type string, chunk_index int, chunk_text string, token_count int, page_numbers array<int>, section_path array<string>, department string, expected_department string, content_hash string, expected_content_hash string, table_ids array<string>")
    codes = {r.code for r in V.chunk_issues(chunks, 10).collect()}
    assert codes == {"DUPLICATE_LOCAL_CHUNK_ID", "DUPLICATE_GLOBAL_CHUNK_ID", "CHUNK_DOCUMENT_MISMATCH", "CHUNK_TENANT_MISMATCH", "CHUNK_DEPARTMENT_MISMATCH", "CHUNK_CONTENT_HASH_MISMATCH", "UNKNOWN_STRATEGY", "EMPTY_CHUNK_TEXT", "INVALID_TOKEN_COUNT"}
    pairs = spark.createDataFrame([("a", "a", "x" * 10, "x" * 3, [(1, False)], [(2, False)], [], [], []), ("b", "c", "x", None, [], None, [("t", 1)], [], None)],
        "doc_id string, clean_doc_id string, raw_text string, clean_text string, raw_pages array<struct<page_number:int,ocr_used:boolean>>, clean_pages array<struct<page_number:int,ocr_used:boolean>>, raw_tables array<struct<table_id:string,n_rows:int>>, clean_tables array<struct<table_id:string,n_rows:int>>, steps array<string>")
    got = {(r.subject, r.code) for r in V.clean_issues(pairs).collect()}
    assert {("a", "LOW_TEXT_RETENTION"), ("a", "PAGE_NUMBER_MISMATCH"), ("a", "NO_CLEANING_STEPS_RECORDED"), ("b", "DOCUMENT_IDENTITY_MISMATCH"), ("b", "INVALID_CLEAN_TEXT"), ("b", "INVALID_CLEAN_PAGES"), ("b", "TABLE_COUNT_MISMATCH"), ("b", "INVALID_CLEANING_STEPS")} <= got
    assert ("a", "TABLE_COUNT_MISMATCH") not in got


def test_html():
    page = "<html lang=' en '><head><title> A  b </title><meta name=author content=Me><style>x</style></head><body><h2>Head</h2><ul><li><p>item <a href=x>link</a></p></li></ul><script>no</script><pre>code</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table></body></html>"
    d = files.parse_html(page)
    assert d["title"] == "A b" and d["language"] == "en" and d["extra"]["author"] == "Me" and d["extra"]["link_count"] == "1"
    assert d["raw_text"].split("\n\n")[:4] == ["## Head", "- item link", "item link", "Code Block:\ncode"]
    assert [(t["headers"], t["rows"]) for t in d["tables"]] == [(["k", "v"], [["1", "2"]]), (["column_1", "column_2"], [["a"], ["b", "c"]])]
    assert "Table: table_0\nColumns: k | v\nRow 1: k: 1 | v: 2" in d["raw_text"]


def test_files(spark, tmp_path):
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>h</t></is></c></row><row><c r="A2"><v>1</v></c><c r="C2"><v>2</v></c></row><row/></sheetData></worksheet>')
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>i</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    for name, content in {"a.TXT": b"plain", "b.csv": "k,v\n1,\n2,\xe9".encode("latin-1"), "c.json": b'{"x": [1]}', "d.md": b"# h\xff", "e.html": b"<p>x", "f.xlsx": sheet.getvalue(), "g.docx": doc.getvalue(), "h.bin": b"?", "i.txt": b"\xff"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.TXT"].raw_text == "plain" and got["a.TXT"].file_type == ".txt"
    assert got["b.csv"].raw_text == "Row 1: k: 1 | v: \nRow 2: k: 2 | v: é" and got["b.csv"].warnings == ["decoded using fallback encoding: latin-1"]
    assert got["c.json"].extra == {"root_type": "dict", "top_level_keys": "x"} and got["d.md"].raw_text == "# h�" and got["e.html"].raw_text == "x"
    assert got["f.xlsx"].tables[0].headers == ["h", "unnamed_column_2"] and got["f.xlsx"].tables[0].rows == [["1", "2"]]
    assert got["g.docx"].raw_text == "## T\n\n- i\n\na | b"
    assert "no parser" in got["h.bin"].error and "UnicodeDecodeError" in got["i.txt"].error
    with pytest.raises(ValueError):
        files.PARSERS.register((".csv",), files.parse_csv)
    with pytest.raises(files.UnsupportedOperationError):
        files.read_table(spark, "x.pdf")


def test_best_of_scores_against_sorting_each_row():
    rng = np.random.default_rng(4)
    for limit, least in ((1, None), (3, None), (3, 0.4), (50, 0.2), (None, 0.5), (None, None)):
        score = np.round(rng.random((7, 40)), 1)
        score[0] = 0.0
        score[1, ::3] = np.nan
        keys = rng.permutation(40)
        k, j = R.best(score, keys, limit, least)
        got = sorted(zip(k.tolist(), j.tolist()))
        expected = []
        for row in range(7):
            order = sorted(range(40), key=lambda c: (np.isnan(score[row, c]), -score[row, c] if not np.isnan(score[row, c]) else 0, keys[c]))
            expected += [(row, c) for c in order[: limit or 40] if least is None or score[row, c] >= least]
        assert got == sorted(expected)
