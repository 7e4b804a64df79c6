"""Cleaning whole documents, deletes, appends, round trips and exact quartiles: literal cases with nulls, repeats and empty tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import lifecycle as L, tables as A, validation as V

PAGES = "pages array<struct<page_number:int,text:string>>, tables array<struct<table_id:string,headers:array<string>,rows:array<array<string>>>>"


def test_whole_documents_are_cleaned(spark):
    rows = [(1, "raw", [(1, " a\t b "), (2, " \n"), (3, "ﬁ")], [("t", [" h ", "２"], [[None, " x "], ["＂", ""]])]), (2, " raw\r\ntext ", [], []), (3, None, [], None)]
    got = {r.doc_id: r for r in L.clean_documents(spark.createDataFrame(rows, f"doc_id long, raw_text string, {PAGES}")).collect()}
    assert got[1].clean_text == "Page 1\na b\n\nPage 3\nfi" and [p.text for p in got[1].pages] == ["a b", "", "fi"]
    assert got[1].tables[0].headers == ["h", "2"] and got[1].tables[0].rows == [[None, "x"], ['"', ""]]
    assert got[2].clean_text == "raw\ntext" and got[2].cleaning_steps == list(T.CLEANING) and got[2].cleaning_version == "1.0"
    assert got[3].clean_text is None and got[3].tables is None


def test_deletes_and_cache_writes(spark):
    points = spark.createDataFrame([("a", "t", 1), ("a", "u", 2), (None, "t", 3), ("b", None, 4)], "document_id string, tenant_id string, n int")
    assert {r.n for r in L.delete_document(points, F.lit("a"), F.lit("t")).collect()} == {2, 3, 4}
    stored = spark.createDataFrame([(1, ["x"]), (2, ["x"])], "entry_id long, answer_departments array<string>")
    fresh = spark.createDataFrame([(2, ["y"]), (2, ["y"]), (1, []), (3, None), (4, ["z"])], "entry_id long, answer_departments array<string>")
    assert sorted((r.entry_id, *r.answer_departments) for r in L.cache_insert(stored, fresh).collect()) == [(1, "x"), (2, "y"), (4, "z")]
    own = spark.createDataFrame([("yes", ["s"], True), ("yes", [], True), (L.ABSTENTION_ANSWER, ["s"], True), ("yes", ["s"], None)], "a string, s array<string>, g boolean")
    assert [r.ok for r in own.select(L.cacheable(F.col("a"), F.col("s"), F.col("g")).alias("ok")).collect()] == [True, False, False, False]


def test_turns_are_appended_once_and_cleared(spark):
    turns = spark.createDataFrame([("t", "c", 4, "u", "a")], "tenant_id string, conversation_id string, turn_no long, user_message string, assistant_message string")
    fresh = spark.createDataFrame([(" t", "c", " q ", "r", 2), ("t", "c", "p", "r", 1), ("t", "n", "q", "r", 1), ("t", "n", " ", "r", 2), (None, "n", "q", "r", 3)], "tenant_id string, conversation_id string, user_message string, assistant_message string, at int")
    got = L.add_turns(turns, fresh, "at")
    assert sorted((r.conversation_id, r.turn_no, r.user_message) for r in got.collect()) == [("c", 4, "u"), ("c", 5, "p"), ("c", 6, "q"), ("n", 0, "q")]
    assert sorted(r.at for r in L.rejected_turns(fresh).collect()) == [2, 3]
    assert {r.conversation_id for r in L.clear_conversations(got, spark.createDataFrame([("t", "c"), ("u", "n")], "tenant_id string, conversation_id string")).collect()} == {"n"}
    assert L.add_turns(turns.limit(0), fresh.limit(0), "at").count() == 0


def test_round_trips_and_pairs(spark):
    a = spark.createDataFrame([("1", "x", [1]), ("2", "y", None), ("3", None, [])], "k string, t string, v array<int>")
    assert L.round_trip_issues(a, a, "k").count() == 0
    b = spark.createDataFrame([("1", "x", [2]), ("2", "y", None), ("2", "y", None), ("4", "", [])], "k string, t string, v array<int>")
    assert sorted((r.subject, r.code) for r in L.round_trip_issues(a, b, "k").collect()) == [("1", "CHANGED_ROW"), ("2", "COUNT_MISMATCH"), ("3", "MISSING_ROW"), ("4", "UNKNOWN_ROW")]
    assert sorted((r.subject, r.code) for r in L.unpaired(a, b, "k").collect()) == [("3", "MISSING_CLEAN_DOCUMENT"), ("4", "MISSING_RAW_DOCUMENT")]


def test_cases_and_names(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"name": "n", "query": "q", "expected_facts": [["a", "b"]]}, {"name": "m", "query": "r", "expected_sources": ["s"]}]))
    got = {r.name: r for r in L.read_cases(spark, str(tmp_path / "c.json")).collect()}
    assert got["n"].expected_facts == [["a", "b"]] and got["n"].expected_sources == [] and got["m"].expected_facts == []
    stored = spark.createDataFrame([("a", 1)], "name string, n int")
    assert sorted(map(tuple, L.ensure(stored, spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "name string, n int"), "name").collect())) == [("a", 1), ("b", 3)]
    lists = spark.createDataFrame([([3, 1, 3], ["b", "", "a", "b", None], ["a", "b"], ["b", "a", "a"])], "n array<int>, s array<string>, x array<string>, y array<string>")
    row = lists.select(T.sorted_numbers(F.col("n")).alias("n"), T.distinct_texts(F.col("s")).alias("s"), T.same_set(F.col("x"), F.col("y")).alias("same")).first()
    assert row.n == [1, 3] and row.s == ["b", "a"] and row.same


def test_quartiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.choice([1.0, 1.0, 1.0, 2.5, rng.normal()])), int(rng.integers(0, 7)), None if k % 3 else float(k), None) for k in range(1001)]
    rows += [(float("nan"), None, None, None)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double")
    got = {r.column: r for r in A.describe(df).collect()}
    for k, name in enumerate("abc"):
        own = np.array([r[k] for r in rows if r[k] is not None and r[k] == r[k]])
        want = np.percentile(own, [25, 50, 75])
        assert np.allclose([got[name].p25, got[name].p50, got[name].p75], want) and got[name]["count"] == len(own)
    assert got["d"]["count"] == 0 and got["d"].p50 is None
    assert A.describe(df.limit(0)).count() == 0 and A.describe(df.select(F.lit("x").alias("x"))).count() == 0


def test_counts_of_visible_documents_are_those_of_their_rows(spark):
    docs = spark.createDataFrame([(k, f"t{k % 3}", None if k % 7 == 0 else f"d{k % 2}") for k in range(60)], "doc_id long, tenant_id string, department string")
    users = spark.createDataFrame([(1, "t0", "d0", "user"), (2, "t1", "d1", "admin"), (3, "t9", "d0", "user"), (4, "t2", None, "user")], "user_id long, tenant_id string, department string, role string")
    want = {r.user_id: r["count"] for r in A.visible(docs, users).groupBy("user_id").count().collect()}
    assert {r.user_id: r.n for r in A.visible_counts(docs, users).collect()} == want and 2 in want


def test_manifests_and_vectors_of_documents(spark):
    chunks = spark.createDataFrame([("a", "s", "text"), ("a", "s", "table"), ("b", "s", "text")], "document_id string, strategy string, chunk_type string")
    made = L.manifest_by_type(chunks)
    assert V.manifest_issues(made, chunks).count() == 0
    assert {(r.subject, r.code) for r in V.manifest_issues(made, chunks.where("document_id = 'a'")).collect()} == {("b", "MISSING_CHUNKS")}
    assert {(r.subject, r.code) for r in V.manifest_issues(made.where("document_id = 'a'"), chunks.where("chunk_type = 'text'")).collect()} == {("a", "MANIFEST_CHUNK_COUNT_MISMATCH"), ("a", "STRATEGY_COUNT_MISMATCH"), ("a", "CHUNK_TYPE_COUNT_MISMATCH"), ("b", "MISSING_MANIFEST")}
