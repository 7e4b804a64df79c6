"""Read-only SQL by plan, SQL's functions, keyed state with expiry, and checked JSON lines."""

import time

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gneiss.functions import registry, text as T
from gneiss.operators.readonly import UnsupportedQueryError, check_read_only, nodes, parsed_plan, select_only
from gneiss.sources.lines import BadLineError, bad_lines, read_checked_lines, write_lines
from gneiss.streaming import state


@pytest.fixture(autouse=True)
def view(spark, tmp_path):
    spark.range(5).selectExpr("id", "concat('x y ', id) AS t").createOrReplaceTempView("rows5")
    spark.range(3).write.parquet(str(tmp_path / "p"))
    return str(tmp_path / "p")


@pytest.mark.parametrize("query", [
    "SELECT * FROM parquet.`{path}`", "select (select count(*) from parquet.`{path}`) AS n", "SELECT id FROM rows5 WHERE id IN (SELECT id FROM parquet.`{path}`)", "SELECT * FROM text.`/etc/passwd`",
    "SELECT TRANSFORM(id) USING 'cat' AS (a) FROM rows5", "SELECT reflect('java.lang.System', 'getenv')", "SELECT java_method('java.util.UUID', 'randomUUID')", "SELECT `reflect`('java.lang.System', 'getenv')",
    "SELECT 1; DROP VIEW rows5", "WITH a AS (SELECT 1) SELECT * FROM a", "INSERT INTO rows5 SELECT 1", "DROP VIEW rows5", "EXPLAIN SELECT 1", "",
])
def test_what_does_not_only_read_known_tables_is_refused(spark, view, query):
    with pytest.raises(UnsupportedQueryError):
        select_only(spark, query.format(path=view))


@pytest.mark.parametrize("query, n", [
    ("  select id from rows5 ;", 5), ("SELECT * FROM (WITH a AS (SELECT id FROM rows5) SELECT * FROM a)", 5), ("SELECT 'a; b' AS x", 1), ("SELECT 'one\n+ two\nInsertIntoStatement' AS x", 1),
    ("SELECT r.id, e.c FROM rows5 r, LATERAL explode(split(r.t, ' ')) e(c)", 15), ("SELECT id, sum(id) OVER (ORDER BY id) FROM rows5 UNION ALL SELECT 1, 2", 6), ("SELECT * FROM VALUES (1), (2) AS v(a) JOIN rows5 ON a = id", 2),
    ("SELECT id % 2 AS k, count(*) FROM rows5 GROUP BY ROLLUP (id % 2) HAVING count(*) > 1 ORDER BY 1 LIMIT 2 OFFSET 1", 2), ("SELECT * FROM rows5 PIVOT (count(t) FOR id IN (1, 2))", 1), ("SELECT /*+ BROADCAST(rows5) */ * FROM rows5 TABLESAMPLE (100 PERCENT)", 5),
    ("SELECT * FROM rows5 a CROSS JOIN range(2) b", 10), ("SELECT (SELECT max(id) FROM rows5) AS m, exists(SELECT 1 FROM rows5)", 1), ("SELECT id FROM rows5 EXCEPT SELECT 1", 4), ("SELECT a.id FROM rows5 a RIGHT JOIN rows5 b ON a.id = b.id + 1", 5),
])
def test_what_only_reads_is_run(spark, query, n):
    assert len(select_only(spark, query).collect()) == n


def test_other_mistakes_stay_what_they_are(spark):
    with pytest.raises(AnalysisException):
        select_only(spark, "SELECT * FROM nowhere")
    with pytest.raises(ParseException):
        select_only(spark, "SELECT (1")


def test_a_check_runs_nothing_and_a_literal_hides_nothing(spark):
    lines = parsed_plan(spark, "SELECT 'x\n   y' AS a FROM rows5 WHERE id > 1")
    assert [n for n, _ in nodes(lines)] == ["Project", "Filter", "UnresolvedRelation"]
    check_read_only(spark, "SELECT assert_true(false)")
    with pytest.raises(UnsupportedQueryError):
        check_read_only(spark, "SELECT 'x\n+- y' AS a")  # it looks like a node that isn't known


def test_functions_of_sql_equal_those_of_columns(spark):
    registry.register(spark)
    texts = ["", None, "  A\r\nb \t c\n\n\n\nd\x01 ﬁ x​ ", "one  two three", "ÄÖ ü\n \n"]
    noisy = spark.createDataFrame([(t,) for t in texts], "t string")
    noisy.createOrReplaceTempView("noisy")
    for name in registry.COLUMNS:
        want = [r[0] for r in noisy.select(registry.column_function(name, F.col("t"))).collect()]
        assert [r[0] for r in select_only(spark, f"SELECT {name}(t) FROM noisy").collect()] == want, name


def test_a_chunker_and_a_cleaner_in_one_select(spark):
    registry.register(spark)
    spark.createDataFrame([(1, " a  b c​ d e "), (2, ""), (3, None), (4, "x")], "k int, t string").createOrReplaceTempView("docs")
    found = select_only(spark, "SELECT k, c.* FROM (SELECT k, clean_text(t) AS t FROM docs) d, LATERAL chunk(d.t, 3, 1) c ORDER BY k, chunk_index").collect()
    assert [tuple(r) for r in found] == [(1, 0, "a b c", 3), (1, 1, "c d e", 3), (4, 0, "x", 1)]


def test_units_are_packed_within_their_partition(spark):
    registry.register(spark)
    rows = [(d, k, t) for d, own in {1: ["a b", "c", "d e f g", "h"], 2: ["", None, "x"], 3: ["1 2 3 4 5 6"]}.items() for k, t in enumerate(own)]
    spark.createDataFrame(rows, "doc int, unit_id long, text string").repartition(5).createOrReplaceTempView("units")
    found = select_only(spark, "SELECT * FROM pack_units(TABLE(units) PARTITION BY (doc) ORDER BY (unit_id), 4) ORDER BY chunk_text").collect()
    assert [tuple(r) for r in found] == [(0, 0, 0, "1 2 3 4 5 6", 6), (0, 0, 1, "a b\nc", 3), (1, 2, 2, "d e f g", 4), (2, 3, 3, "h", 1), (0, 2, 2, "x", 1)]


def test_functions_can_be_added_once(spark):
    registry.define("shout", lambda t: F.upper(t))
    registry.define("shout", registry.SqlFunction("t STRING", "STRING", "upper(t)"))
    try:
        registry.register(spark)
        assert spark.range(1).select(registry.column_function("shout", F.lit("a"))).first()[0] == select_only(spark, "SELECT shout('a') AS x").first()[0] == "A"
        with pytest.raises(registry.DuplicateFunctionError):
            registry.define("shout", registry.SqlFunction("t STRING", "STRING", "t"))
        with pytest.raises(registry.DuplicateFunctionError):
            registry.define("chunk", (registry.PackUnits, "x int"))
    finally:
        del registry.COLUMNS["shout"], registry.SQL["shout"]
    with pytest.raises(KeyError):
        registry.column_function("shout", F.lit("a"))
    assert T.CLEANING  # the steps that clean_text is made of


def run_stream(spark, tmp_path, made, schema, rows, name):
    """One run over what is new in the source, with the state of the runs before; the rows of all runs."""
    source, out, mark = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "mark"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = made(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.option("checkpointLocation", mark).format("parquet").option("path", out).trigger(once=True).start()  # expiry by the clock asks for batches without data, so availableNow would go on
    assert query.awaitTermination(60)
    return spark.read.parquet(out).collect()


def test_cached_values_outlive_a_restart_and_expire(spark, tmp_path):
    ask = lambda ttl, rows, name: {(r.key, r.seq): r.value if r.hit else None for r in run_stream(spark, tmp_path, lambda s: state.cache_answers(s, ttl), state.REQUEST, rows, name)}
    first = [("a", 1, "get", None), ("a", 2, "set", "one"), ("a", 3, "get", None), ("b", 1, "set", "two"), ("b", 2, "set", None), (" ", 1, "set", "x"), (" ", 2, "get", None)]
    assert ask(state.CACHE_TTL, first, "long") == {("a", 1): None, ("a", 3): "one", (" ", 2): None}
    later = ask(state.CACHE_TTL, [("a", 9, "get", None), ("b", 9, "get", None), ("c", 9, "get", None)], "long")
    assert (later["a", 9], later["b", 9], later["c", 9]) == ("one", "two", None)
    ask(1.5, [("a", 1, "set", "one")], "short")
    time.sleep(2)
    assert ask(1.5, [("a", 2, "get", None)], "short")["a", 2] is None


def test_the_last_turns_are_remembered_over_a_restart(spark, tmp_path):
    turns = lambda ks: [("t", 1, k, "user", f"text {k}") for k in ks]
    remember = lambda rows: {r.turn: [h.turn for h in r.history] for r in run_stream(spark, tmp_path, state.remember, state.TURN, rows, "memory") if (r.tenant_id, r.conv_id) == ("t", 1)}
    found = remember(turns([1, 2, 4]) + [("t", 1, 3, "user", " "), ("u", 1, 1, "user", "other tenant"), ("t", 2, 1, "user", "other")])
    assert found == {1: [1], 2: [1, 2], 4: [1, 2, 4]}
    found = remember(turns([5, 6, 7, 4, 0]))
    assert found[5] == [1, 2, 4, 5][-5:] or found[5] == [0, 1, 2, 4, 5]
    assert found[7] == [2, 4, 5, 6, 7]


LINES = "doc_id long, name string"


def test_bad_lines_are_found_with_their_numbers_in_files_of_many_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    want = set()
    for f in ("a", "b"):
        out = []
        for k in range(3000):
            if k % 701 == 700:
                want.add((f"{f}.jsonl", len(out) + 1))
                out.append('{"doc_id": 1, "name"')
            else:
                out.append(f'{{"doc_id": {k}, "name": "n{k}"}}')
            if k % 100 == 0:
                out += ["", "  "]
        (folder / f"{f}.jsonl").write_text("\n".join(out) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        found = bad_lines(spark, str(folder), LINES).collect()
        assert {(r.file.rsplit("/", 1)[1], r.line) for r in found} == want and {r.value for r in found} == {'{"doc_id": 1, "name"'}
        with pytest.raises(BadLineError, match="a.jsonl, line 715"):
            read_checked_lines(spark, str(folder), LINES)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_round_trip_with_sorted_keys_and_nulls(spark, tmp_path):
    path = str(tmp_path / "lines")
    docs = spark.createDataFrame([(1, "ä\n\"x\""), (2, None)], "z long, a string")
    write_lines(docs.coalesce(1), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":"ä\\n\\"x\\"","z":1}', '{"a":null,"z":2}']
    schema = StructType([StructField("a", StringType())]).add("z", "long")
    assert sorted((r.z, r.a) for r in read_checked_lines(spark, path, schema).collect()) == [(1, 'ä\n"x"'), (2, None)]
    assert bad_lines(spark, path, "z long, a long").count() == 1
