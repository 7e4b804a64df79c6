"""Generations, the chunk store, vector indexes, collections and counted writes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import chunk_store as S, collection as V, generations as G, observed, retrieval as R, vector_index as I

CHUNKS = "document_id string, tenant_id string, chunk_id string, chunk_index int, strategy string, chunk_type string, chunk_text string, token_count long"
DOCUMENTS = "document_id string, tenant_id string, department string, content_hash string"
CONFIG = {"size": 3}


def batch(spark, texts, version="1", tenant="t"):
    """Documents by id with their chunk texts, as rows for persist."""
    docs = spark.createDataFrame([(d, tenant, "hr", f"{version}-{d}-{own}") for d, own in texts.items()], DOCUMENTS)
    rows = [(d, tenant, f"{d}-{k}-{version}", k, "fixed_size", "text", text, len(text.split())) for d, own in texts.items() for k, text in enumerate(own)]
    return docs, spark.createDataFrame(rows, CHUNKS)


def stored(spark, root):
    return sorted((r.document_id, r.chunk_index, r.chunk_text) for r in S.load_chunks(spark, root).collect())


def status(found):
    return {r.document_id: r.status for r in found.collect()}


def test_pointers_name_the_newest_generation_and_refuse_a_late_writer(spark, tmp_path):
    root = str(tmp_path / "t")
    none = G.current(spark, root)
    assert none == G.Pointer()
    first = G.publish(spark, root, none, G.Pointer(generation="a", parts={"0": "a"}))
    assert G.current(spark, root) == first and first.sequence == 1
    second = G.publish(spark, root, first, G.Pointer(generation="b", parts={"0": "a", "1": "b"}, facts={"n": "2"}))
    assert G.current(spark, root) == second
    with pytest.raises(G.PublishConflictError):
        G.publish(spark, root, first, G.Pointer(generation="late"))
    assert G.current(spark, root) == second


def test_chunks_are_written_skipped_rebuilt_and_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    assert stored(spark, root) == []
    texts = {"a": ["x y", "z"], "b": ["only"], "none": []}
    assert status(S.persist(*batch(spark, texts), root, CONFIG)) == {"a": "WRITTEN", "b": "WRITTEN", "none": "REFUSED_ZERO_CHUNKS"}
    assert stored(spark, root) == [("a", 0, "x y"), ("a", 1, "z"), ("b", 0, "only")]
    before = G.current(spark, root)
    assert set(status(S.persist(*batch(spark, {"a": ["x y", "z"], "b": ["only"]}), root, CONFIG)).values()) == {"SKIPPED_UP_TO_DATE"}
    assert G.current(spark, root) == before
    again = S.persist(*batch(spark, {"a": ["new"], "b": ["only"], "c": ["third"]}, "1"), root, CONFIG)
    assert status(again) == {"a": "REBUILT", "b": "SKIPPED_UP_TO_DATE", "c": "WRITTEN"}
    assert stored(spark, root) == [("a", 0, "new"), ("b", 0, "only"), ("c", 0, "third")]
    assert status(S.persist(*batch(spark, {"b": ["only"]}), root, CONFIG, force=True)) == {"b": "REBUILT"}
    assert status(S.persist(*batch(spark, {"b": ["only"]}), root, {"size": 4})) == {"b": "REBUILT"}
    manifest = {r.document_id: r for r in S.load_manifests(spark, root).collect()}
    assert set(manifest) == {"a", "b", "c"} and manifest["a"].total_chunks == 1 and [tuple(c) for c in manifest["a"].strategy_counts] == [("fixed_size", 1)]


@pytest.mark.parametrize("step", ["verify", "publish"])
def test_a_run_that_ends_between_two_steps_leaves_the_old_generation(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "store")
    S.persist(*batch(spark, {"a": ["old"], "b": ["kept"]}), root, CONFIG)
    before = stored(spark, root)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S, step, killed)
        with pytest.raises(KeyboardInterrupt):
            S.persist(*batch(spark, {"a": ["new"]}), root, CONFIG)
    assert stored(spark, root) == before
    S.persist(*batch(spark, {"a": ["new"]}), root, CONFIG)
    assert stored(spark, root) == [("a", 0, "new"), ("b", 0, "kept")]


@pytest.mark.parametrize("spoil, wrong", [
    (lambda c: c.where("chunk_index > 0"), "count"),
    (lambda c: c.withColumn("chunk_index", F.lit(1) - F.col("chunk_index")), "ids or their order"),
    (lambda c: c.withColumn("chunk_id", F.lit("same")), "repeated ids"),
    (lambda c: c.withColumn("tenant_id", F.lit("other")), "tenant"),
])
def test_staged_chunks_that_differ_are_not_published(spark, tmp_path, spoil, wrong):
    docs, chunks = batch(spark, {"a": ["x", "y"]})
    expected = S.manifests(docs, chunks, CONFIG)
    S.verify(expected, chunks)
    with pytest.raises(G.VerificationError, match=wrong):
        S.verify(expected, spoil(chunks))


def test_chunks_of_other_documents_and_tenants_are_refused(spark, tmp_path):
    docs, chunks = batch(spark, {"a": ["x"]})
    for given in (chunks.withColumn("document_id", F.lit("b")), chunks.withColumn("tenant_id", F.lit("u"))):
        with pytest.raises(ValueError):
            S.persist(docs, given, str(tmp_path / "s"), CONFIG)
    assert G.current(spark, str(tmp_path / "s")).generation is None


def vectors(spark, n=3000, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, size))
    rows = [(k, [float(x) for x in centres[rng.integers(20)] + 0.4 * rng.normal(size=size)], k % 3) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, vector array<double>, lane int").repartition(4)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_the_index_finds_what_the_exact_search_finds(spark, tmp_path, metric):
    given = vectors(spark)
    asked = given.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact = R.ranked(R.dense_scores(given, asked, 10, metric), 10, "doc_id")
    index = I.build_vector_index(given, str(tmp_path / metric), metric)
    assert 20 < len(index.centroids) < 100
    assert I.recall_at(I.indexed_search(index, asked, 10), exact, 10).first().recall >= 0.9
    key = lambda rows: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in rows.collect())
    whole = I.indexed_search(I.load_vector_index(spark, str(tmp_path / metric)), asked, 10, probed=1000)
    assert key(whole) == key(exact)
    some = R.ranked(R.dense_scores(given.where("lane = 1"), asked, 10, metric), 10, "doc_id")
    assert key(I.indexed_search(index, asked, 10, probed=1000, where="lane = 1")) == key(some)


def test_recall_on_the_given_vectors(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = given.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact = R.ranked(R.dense_scores(given, asked, 10), 10, "doc_id")
    index = I.build_vector_index(given, str(tmp_path / "index"))
    assert I.recall_at(I.indexed_search(index, asked, 10), exact, 10).first().recall >= 0.9


def test_only_probed_lists_are_read(spark, tmp_path):
    given = vectors(spark)
    index = I.build_vector_index(given, str(tmp_path / "index"))
    one = given.where("doc_id = 7").select(F.col("doc_id").alias("query_id"), "vector")
    found = I.indexed_scores(index, one, 5, probed=3)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan
    read = index.rows.where(F.col("list").isin(I.probes(index, np.array([one.first().vector]), 3)[0].tolist()))
    assert len(read.inputFiles()) >= 3 and read.count() < 0.4 * 3000 and found.where("doc_id = 7").count() == 1


def test_the_index_is_loaded_by_fingerprint_and_built_anew_for_other_vectors(spark, tmp_path):
    given = vectors(spark, 400)
    first = I.vector_index(given, folder=str(tmp_path))
    assert I.vector_index(given, folder=str(tmp_path)).rows.inputFiles() == first.rows.inputFiles()
    other = I.vector_index(given.where("doc_id < 300"), folder=str(tmp_path))
    assert other.rows.count() == 300 and first.rows.count() == 400


def test_vectors_that_an_index_leaves_out_or_refuses(spark, tmp_path):
    schema = "doc_id long, vector array<double>"
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0, None])], schema)
    index = I.build_vector_index(odd, str(tmp_path / "a"))
    assert sorted(r.doc_id for r in index.rows.collect()) == [1, 4]
    assert I.indexed_search(index, spark.createDataFrame([], "query_id long, vector array<double>"), 3).count() == 0
    with pytest.raises(ValueError):
        I.indexed_search(index, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3)
    with pytest.raises(ValueError):
        I.build_vector_index(odd.where("vector is null"), str(tmp_path / "b"))
    with pytest.raises(Exception, match="different lengths"):
        I.build_vector_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), str(tmp_path / "c"))


def points(spark, n=4000):
    rows = [(k, f"c{k}", f"d{k % 100:03d}", f"t{k % 2}", "hr" if k % 4 < 2 else "it", [float(k % 7), 1.0]) for k in range(n)]
    return spark.createDataFrame(rows, V.POINT)


def test_collections_are_created_once_recreated_and_counted(spark, tmp_path):
    root = str(tmp_path / "c")
    with pytest.raises(V.CollectionNotFoundError):
        V.count(spark, root)
    assert V.create(spark, root, 2) and not V.create(spark, root, 2)
    assert V.count(spark, root) == 0 and V.points(spark, root).count() == 0
    assert V.upsert_points(points(spark, 50), root) == 50 and V.upsert_points(points(spark, 60), root) == 60
    assert V.count(spark, root) == V.points(spark, root).count() == 60
    held = V.points(spark, root)
    assert V.delete_points(spark, root, "t1", "d001") == 59
    V.recreate(spark, root, 3, "dot")
    assert V.count(spark, root) == 0 and V.info(spark, root).size == 3 and held.count() == 60
    with pytest.raises(ValueError):
        V.upsert_points(points(spark, 5), root)
    with pytest.raises(ValueError):
        V.create(spark, str(tmp_path / "d"), 2, "manhattan")


def test_stale_points_of_a_document_go(spark, tmp_path):
    root = str(tmp_path / "c")
    V.create(spark, root, 2)
    V.upsert_points(points(spark, 300), root)
    fresh = points(spark, 300).where("document_id = 'd005' AND doc_id < 200")
    assert V.upsert_points(fresh, root, replace=True) == 299
    assert sorted(r.doc_id for r in V.filtered(spark, root, document_id="d005").collect()) == [5, 105]


def scanned_rows(df):
    """Rows that the file scan of df's plan gave out, from its own metrics."""
    plan = df._jdf.queryExecution()
    df.collect()
    leaf = plan.executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_filters_prune_folders_and_row_groups(spark, tmp_path):
    root = str(tmp_path / "c")
    V.create(spark, root, 2)
    V.upsert_points(points(spark, 20_000), root, row_group=16 << 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    try:
        one = V.filtered(spark, root, "t1", "hr")
        assert "PartitionFilters: [isnotnull(tenant_id" in one._jdf.queryExecution().toString()
        assert scanned_rows(one) == one.count() == 5000
        document = V.filtered(spark, root, "t1", "hr", "d013")
        assert document.count() == 200 and scanned_rows(document) < 0.6 * 5000
        assert scanned_rows(V.filtered(spark, root, "t1", "hr", "d0135")) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")


def test_a_collection_is_searched_within_its_filters(spark, tmp_path):
    root = str(tmp_path / "c")
    asked = spark.createDataFrame([(1, [6.0, 1.0])], "query_id long, vector array<double>")
    with pytest.raises(V.CollectionNotFoundError):
        V.search(asked, root)
    V.create(spark, root, 2, "Dot")
    V.upsert_points(points(spark, 100), root)
    best = [r.doc_id for r in V.search(asked, root, 3, "t1").orderBy("rank").collect()]
    assert best == [13, 27, 41]
    assert V.search(asked, root, 50, least=30.0).count() == len([k for k in range(100) if 6 * (k % 7) + 1 >= 30])
    with pytest.raises(ValueError):
        V.search(asked, root, 0)
    with pytest.raises(ValueError):
        V.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), root)


def test_a_counted_write_equals_a_recount_and_scans_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("status")).write.parquet(source)
    got = observed.write_counted(spark.read.parquet(source), out, {"total": F.sum("id")}, {"status": ["s0", "s1", None]}, ["status"])
    again = spark.read.parquet(out)
    recount = {r.status: r.n for r in again.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got["rows"] == again.count() and got["total"] == 499500
    assert observed.manifest(got, "status") == {"s0": recount["s0"], "s1": recount["s1"], "None": recount[None], "other": recount["s2"]}
