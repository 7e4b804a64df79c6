"""Exact duplicates by chunk recipes, against plain comparison of texts."""

import hashlib
import random

import pyarrow as pa
import pytest

from gneiss.llm import exact_dedup
from gneiss.llm.exact_dedup import LEAST, MOST, chunks, clashing, digest, exact_groups, recipes

SCHEMA = "doc_id long, text string"


def prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh ijklmnop\nqrstü vwxyz") for _ in range(n))


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        own = groups[text or ""]
        out.append((doc, max((d for d in own if d is not None), default=None), len(own), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_chunks_put_the_text_together_and_follow_the_content():
    text, inserted = prose(1, 400_000), prose(2, 37)
    a, b = chunks(pa.array([text, inserted + text]))
    assert b"".join(a) == text.encode() and b"".join(b) == (inserted + text).encode()
    assert all(LEAST <= len(c) <= MOST for c in a[:-1])
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert list(chunks(pa.array(["", None, "x"]))) == [[], [], [b"x"]]


def test_a_texts_chunks_do_not_depend_on_its_neighbours():
    texts = [prose(k, 1 + 700 * k) for k in range(40)]
    together = list(chunks(pa.array(texts)))
    assert together == [next(chunks(pa.array([t]))) for t in texts]


def test_whole_result_against_brute_force(spark):
    long = prose(3, 120_000)
    texts = [None, "", " ", "a", "A", "a ", long, long + "x", "x" + long, prose(4, 9000), "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    rng = random.Random(5)
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(None, "a"), (None, "null keys alone"), (None, "null keys alone")]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_repeated_rows_string_keys_clashing_columns_and_empty_tables(spark):
    rows = [("b", "t", 1, 2, 3), ("b", "t", 1, 2, 3), ("a", "t", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "`id.x` string, text string, heads int, key int, n int")
    got = exact_groups(docs, key="id.x").collect()
    assert [r[0] for r in got if r.kept] == ["b"] and {(r.keep_id, r.group_size) for r in got} == {("b", 3)}
    assert exact_groups(docs.where("false"), key="id.x").count() == 0


def test_identifiers_that_clash_are_found_and_another_seed_is_taken(spark, monkeypatch):
    """With 8 bits, 24 chunks soon clash; the groups are right all the same, and come from a later seed."""
    rows = [(k, f"text {k % 24}" * 3) for k in range(48)]
    docs = spark.createDataFrame(rows, SCHEMA)
    own = [digest(t.encode(), 0, 8) for t in {t for _, t in rows}]
    assert len(set(own)) < len(own), "the fixture has no clash under the first seed"
    found = recipes(docs, 0, 8)
    repeated = found.selectExpr("heads[0] AS head", "tails[0] AS tail").distinct()
    assert {tuple(r) for r in clashing(docs, repeated, 0, 8).collect()} == {i for i in own if own.count(i) > 1}
    seeds = []
    monkeypatch.setattr(exact_dedup, "recipes", lambda d, s, b=128: seeds.append(s) or recipes(d, s, b))
    got = exact_groups(docs, bits=8).collect()
    assert len(seeds) > 1
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    with pytest.raises(RuntimeError):
        exact_groups(docs, bits=2)
