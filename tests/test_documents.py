"""Keyed stores, the catalog's life cycle, cascading deletes, local files, and the validators' last codes."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gneiss.operators import chunk_store as S, collection as C, documents as D, validation as V
from gneiss.operators.generations import VerificationError, current
from gneiss.operators.keyed_store import store

ROW = StructType().add("k", "string").add("v", "long")


def records(spark, n=6, tenant="t"):
    rows = [(f"d{k}", tenant, "hr", f"f{k}.txt", ".txt", f"h{k}", f"s3/{k}" if k else None, None, 10 + k, 1) for k in range(n)]
    return spark.createDataFrame(rows, D.RECORD)


def state(spark, root):
    return {r.document_id: r.status for r in D.catalog(root).read(spark).collect()}


def test_rows_are_put_replaced_and_removed_by_key(spark, tmp_path):
    kept = store(str(tmp_path / "s"), ROW, ["k"], buckets=4)
    read = lambda: sorted(tuple(r) for r in kept.read(spark).collect())
    assert read() == []
    kept.remove(spark.createDataFrame([("a",)], "k string"))
    kept.put(spark.createDataFrame([(f"k{i}", i) for i in range(9)], ROW))
    kept.put(spark.createDataFrame([("k1", 100), ("new", 7)], ROW))
    assert read() == sorted([(f"k{i}", i if i != 1 else 100) for i in range(9)] + [("new", 7)])
    before = current(spark, kept.root)
    with pytest.raises(VerificationError):
        kept.put(spark.createDataFrame([("x", 1), ("x", 2)], ROW))
    with pytest.raises(ValueError):
        kept.put(spark.createDataFrame([(None, 1)], ROW))
    assert current(spark, kept.root) == before
    kept.remove(spark.createDataFrame([(f"k{i}",) for i in range(9)] + [("new",), ("never",)], "k string"))
    assert read() == [] and current(spark, kept.root).parts == {}


def test_documents_live_through_their_states(spark, tmp_path):
    root = str(tmp_path / "catalog")
    documents = D.catalog(root)
    D.create(documents, records(spark))
    assert set(state(spark, root).values()) == {"PROCESSING"}
    with pytest.raises(ValueError):
        D.create(documents, records(spark, 1))
    D.settle(documents, spark.createDataFrame([("d0", None), ("d1", "no text"), ("d1", None), ("d2", None)], "document_id string, error string"))
    assert state(spark, root) == {"d0": "READY", "d1": "FAILED", "d2": "READY", "d3": "PROCESSING", "d4": "PROCESSING", "d5": "PROCESSING"}
    D.update(documents, spark.createDataFrame([("d1", "it", 2), ("d2", None, 3)], "document_id string, department string, version int"))
    rows = {r.document_id: (r.department, r.version, r.status) for r in documents.read(spark).collect()}
    assert rows["d1"] == ("it", 2, "FAILED") and rows["d2"] == ("hr", 3, "READY")
    with pytest.raises(D.DocumentNotFoundError):
        D.update(documents, spark.createDataFrame([("d1", "X"), ("none", "X")], "document_id string, status string"))
    assert state(spark, root)["d1"] == "FAILED"


def test_a_delete_takes_vectors_chunks_and_files_along(spark, tmp_path):
    roots = {name: str(tmp_path / name) for name in ("catalog", "points", "chunks", "files")}
    documents, files = D.catalog(roots["catalog"]), D.objects(roots["files"])
    D.create(documents, records(spark))
    files.put(spark.createDataFrame([(f"s3/{k}", b"x" * k) for k in range(6)], D.OBJECT))
    C.create(spark, roots["points"], 1)
    C.upsert_points(spark.createDataFrame([(k, f"c{k}", f"d{k % 6}", "t", "hr", [1.0]) for k in range(12)], C.POINT), roots["points"])
    docs = records(spark).select("document_id", "tenant_id", "department", "content_hash")
    chunks = spark.createDataFrame([(f"d{k}", "t", f"c{k}", 0, "fixed_size", "text", "x", 1) for k in range(6)], StructType([f for f in S.CHUNK if f.name != "bucket"]))
    S.persist(docs, chunks, roots["chunks"], {})
    asked = spark.createDataFrame([(1, "admin", "t", "d1"), (2, "employee", "t", "d2"), (3, "knowledge_admin", "u", "d3"), (4, "admin", "t", "d9"), (5, "knowledge_admin", "t", "d0"), (6, None, "t", "d4")], "request_id int, role string, tenant_id string, document_id string")
    found = {r.request_id: r.outcome for r in D.delete_documents(asked, documents, roots["points"], roots["chunks"], files).collect()}
    assert found == {1: "DELETED", 2: "DENIED", 3: "DENIED", 4: "NOT_FOUND", 5: "DELETED", 6: "DENIED"}
    left = ["d2", "d3", "d4", "d5"]
    assert sorted(state(spark, roots["catalog"])) == left
    assert sorted({r.document_id for r in C.points(spark, roots["points"]).collect()}) == left and C.count(spark, roots["points"]) == 8
    assert sorted(r.document_id for r in S.load_chunks(spark, roots["chunks"]).collect()) == left == sorted(r.document_id for r in S.load_manifests(spark, roots["chunks"]).collect())
    held = D.held_objects(spark, files, spark.createDataFrame([("s3/0",), ("s3/1",), ("s3/2",)], "key string"))
    assert {r.key: r.held for r in held.collect()} == {"s3/0": True, "s3/1": False, "s3/2": True}
    again = {r.request_id: r.outcome for r in D.delete_documents(asked, documents, roots["points"], roots["chunks"], files).collect()}
    assert again[1] == again[5] == "NOT_FOUND"


def test_local_files_are_documents_by_their_relative_path(spark, tmp_path):
    for name in ("hr/a.txt", "hr/deep/b.tar.gz", "it/.hidden", "it/c"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {r.filename: r for r in D.local_documents(spark, str(tmp_path), "t").collect()}
    assert {n: (r.department, r.file_type) for n, r in found.items()} == {"a.txt": ("hr", ".txt"), "b.tar.gz": ("deep", ".gz"), "c": ("it", "")}
    assert found["b.tar.gz"].document_id == hashlib.sha256(b"hr/deep/b.tar.gz").hexdigest()
    assert [r.filename for r in D.local_documents(spark, str(tmp_path), "t", "hr").collect()] == ["a.txt"]


def codes(found):
    return sorted((r.subject, r.code) for r in found.collect())


def test_vectors_of_other_owners_and_repeated_ids(spark):
    schema = "document_id string, position int, chunk_id string, tenant_id string, department string"
    chunks = spark.createDataFrame([("a", 0, "a0", "t", "hr"), ("a", 1, "a1", "t", "hr"), ("a", 2, "a2", "t", "hr"), ("b", 0, "b0", "t", "it")], schema)
    assert codes(V.embedding_identity_issues(chunks, chunks)) == []
    bad = spark.createDataFrame([("a", 0, "a0", "u", "hr"), ("a", 1, "a1", "t", None), ("a", 2, "a1", "t", "hr"), ("b", 0, "a0", "t", "it"), ("c", 0, "c0", "t", "hr")], schema)
    assert codes(V.embedding_identity_issues(chunks, bad)) == [
        ("a0", "DUPLICATE_GLOBAL_EMBEDDING"), ("a0", "TENANT_MISMATCH"), ("a1", "DEPARTMENT_MISMATCH"), ("a1", "DUPLICATE_GLOBAL_EMBEDDING"), ("a1", "DUPLICATE_LOCAL_EMBEDDING"), ("c0", "DOCUMENT_MISMATCH"),
    ]


def test_stated_point_counts_and_table_pages(spark):
    assert codes(V.point_count_issues(spark.range(3), 3)) == [] and codes(V.point_count_issues(spark.range(3), 4)) == [("collection", "POINT_COUNT_MISMATCH")]
    table = "array<struct<table_id: string, n_rows: int, page_number: int>>"
    pages = "array<struct<page_number: int, ocr_used: boolean>>"
    schema = f"doc_id long, clean_doc_id long, raw_text string, clean_text string, raw_pages {pages}, clean_pages {pages}, raw_tables {table}, clean_tables {table}, steps array<string>"
    rows = [(1, 1, "long text", "long text", [], [], [("t", 1, 1), ("u", 1, None)], [("t", 1, 2), ("u", 1, None)], ["s"]), (2, 2, "long text", "long text", [], [], [("t", 1, 1)], [("t", 1, 1)], ["s"])]
    assert codes(V.clean_issues(spark.createDataFrame(rows, schema))) == [("1", "TABLE_PROVENANCE_MISMATCH")]
    old = spark.createDataFrame(rows, schema).withColumns({c: F.transform(c, lambda t: F.struct(t["table_id"].alias("table_id"), t["n_rows"].alias("n_rows"))) for c in ("raw_tables", "clean_tables")})
    assert codes(V.clean_issues(old)) == []
