"""Chunkers: exact small cases, and invariants over the driver's documents."""

from __future__ import annotations

import random
import re

import pytest

from gneiss.operators import chunking as C, sequential_chunks as S
from gneiss.operators.chunking import ChunkConfig

SMALL = dict(size=6, overlap=2, least=2)


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["word ", "Two. ", "three! ", "\n", "\n\n", "# Head\n", "1.2 Part\n", "UPPER CASE\n", "  ", "longer words here? ", "é "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def loop_windows(text: str, size: int, overlap: int, least: int) -> list[tuple]:
    """One window after the other, as offsets."""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    out, k = [], 0
    while k < len(at):
        own = at[k : k + size]
        if len(own) >= least:
            out.append((text[own[0][0] : own[-1][1]], own[0][0], own[-1][1], len(own)))
        if k + size >= len(at):
            break
        k += size - overlap
    return out


def test_fixed_windows_against_a_loop(spark):
    rows = list(enumerate(texts(1, 150)))
    df = spark.createDataFrame([(k, t, 9) for k, t in [*rows, (900, ""), (901, None)]], "doc_id long, text string, w int")
    for size, overlap, least in ((6, 2, 2), (3, 0, 1), (50, 10, 20)):
        got: dict = {}
        for r in C.fixed_size(df, ChunkConfig("fixed_size", size=size, overlap=overlap, least=least)).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append((r.chunk_text, r.start_char, r.end_char, r.token_count))
        assert got == {k: w for k, t in rows if (w := loop_windows(t, size, overlap, least))}


@pytest.mark.parametrize("strategy", ["recursive", "sentence", "paragraph", "structure_aware"])
@pytest.mark.parametrize("unit", ["tokens", "characters"])
def test_invariants(spark, strategy, unit):
    rows = [(k, t.strip() if strategy == "paragraph" else t) for k, t in enumerate(texts(2, 120))]  # a line end behind the last paragraph hides it
    config = ChunkConfig(strategy, unit=unit, **(SMALL if unit == "tokens" else dict(size=40, overlap=8, least=10)))
    df = spark.createDataFrame([*rows, (900, None), (901, " \n ")], "doc_id long, text string")
    one, two = (S.chunk(df, config).orderBy("doc_id", "chunk_index").collect() for _ in range(2))
    assert one == two
    by: dict = {}
    for r in one:
        by.setdefault(r.doc_id, []).append(r)
    count = S.counter(config)
    assert 900 not in by and 901 not in by
    for k, t in rows:
        own = by.get(k, [])
        assert [r.chunk_index for r in own] == list(range(len(own)))
        assert all(r.chunk_text and count(r.chunk_text) <= config.size for r in own)
        assert bool(own) == bool(t.strip())
        if unit == "tokens":
            assert {w for w in t.split()} == {w for r in own for w in r.chunk_text.split()}


def pieces(f, text, **how) -> list[str]:
    return [p.text for p in f(text, ChunkConfig("x", **how))]


def test_sentences_pack_with_whole_units_of_overlap():
    assert pieces(S.sentence, "One two. Three four. Five six.", size=4, overlap=2, least=0) == ["One two. Three four.", "Three four. Five six."]
    assert pieces(S.sentence, "One two three. Four.", size=3, overlap=0, least=2) == ["One two three.", "Four."]
    assert pieces(S.sentence, "a b c d e f g", size=3, overlap=0, least=0) == ["a b c", "d e f", "g"]


def test_a_small_tail_joins_the_chunk_before_it():
    assert pieces(S.sentence, "One two three. Four five.", size=5, overlap=0, least=5) == ["One two three. Four five."]
    assert pieces(S.paragraph, "one two\n\nthree four\n\nfive", size=4, overlap=0, least=3) == ["one two\n\nthree four", "five"]


def test_a_one_character_paragraph_goes_with_the_next():
    assert pieces(S.paragraph, "a\n\nbc", size=10, overlap=0, least=0) == ["a\n\nbc"]
    assert [p.text for p in S.paragraph("ab\n\ncd", ChunkConfig("x", size=1, overlap=0, least=0))] == ["ab", "cd"]


def test_recursive_keeps_separators_and_carries_words():
    assert pieces(S.recursive, "a b c d e f", size=3, overlap=1, least=0) == ["a b c", "c d e", "e f"]
    assert pieces(S.recursive, "a b\n\nc d e", size=3, overlap=0, least=0) == ["a b", "c d e"]


def test_sections_have_the_path_of_their_headings():
    text = "intro\n# A\none\n## B\ntwo\n# C\nthree\n1. D\nfour\n"
    got = [(p.text, p.path) for p in S.structure(text, ChunkConfig("x", size=4, overlap=0, least=0))]
    assert got == [("intro\n\n# A\none", ("A",)), ("## B\ntwo", ("A", "B")), ("# C\nthree", ("C",)), ("1. D\nfour", ("C", "D"))]
    assert S.heading_of("1. Title") == (2, "Title") and S.heading_of("1 Title") == (1, "Title") and S.heading_of("plain text") is None


def test_tables():
    config = ChunkConfig("table_aware", size=8, overlap=0, least=1, rows_per_group=2)
    rows = [["1", "x"], ["2", None], [None, " "], ["3", "y"]]
    assert [p.text for p in S.table(["k", "v"], rows, config)] == ["k | v\n1 | x\n2 | ", "k | v\n3 | y"]
    long = [p.text for p in S.table(["k", "v"], [["1", "a b c d e f g h i"]], config)]
    assert all(t.startswith("k | v\n") and len(t.split()) <= 8 for t in long) and "v:" in long[0] + long[1]
    assert list(S.table(["k"], [], config)) == []
    with pytest.raises(ValueError):
        list(S.table(["a b c d e f g h"], [["1"]], config))


def test_json():
    text = '{"b": {"c": 1, "a": [1, 2]}, "l": [{"z": 1, "y": {}}, {}, [3, []]], "e": {}, "n": null}'
    assert pieces(S.json_values, text, size=9, overlap=0, least=0) == ["b.c: 1", "b.a: [1, 2]", 'l.0: {"y": {}, "z": 1}', "l.1: {}", "l.2.0: 3", "n: null"]
    assert pieces(S.json_values, "7", size=9, overlap=0, least=0) == ["7"]
    with pytest.raises(ValueError):
        pieces(S.json_values, "{", size=9, overlap=0, least=0)


def test_pages_do_not_mix(spark):
    df = spark.createDataFrame([(1, 1, "a b c d e"), (1, 2, " "), (1, 3, "f"), (1, 4, None)], "doc_id long, page_number int, text string")
    got = [(r.page_number, r.chunk_index, r.chunk_text) for r in C.page_aware(df, ChunkConfig("page_aware", size=3, overlap=1, least=1)).orderBy("chunk_index").collect()]
    assert got == [(1, 0, "a b c"), (1, 1, "c d e"), (3, 2, "f")]


@pytest.mark.parametrize("bad", [dict(size=0), dict(overlap=-1), dict(size=5, overlap=5, least=0), dict(least=-1), dict(size=5, overlap=1, least=9), dict(unit="lines"), dict(rows_per_group=0), dict(strategy=" ")])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        ChunkConfig(**bad)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="recursive"):
        S.chunk(spark.createDataFrame([(1, "x")], "doc_id long, text string"), ChunkConfig("nothing"))


def test_table_rows_in_blocks_against_whole_tables(spark):
    rng = random.Random(5)
    tables = {k: [[rng.choice(["x", "", "y z", None, " w ", "many words in this one cell here"]) for _ in range(3)] for _ in range(rng.choice([0, 1, 4, 9, 60]))] for k in range(30)}
    rows = spark.createDataFrame([(k, "t", 3 * n, row) for k, body in tables.items() for n, row in enumerate(body)], "doc_id long, table_id string, row_no long, cells array<string>")
    whole = spark.createDataFrame([(k, "t", ["a", "b", None], body) for k, body in tables.items()], "doc_id long, table_id string, headers array<string>, rows array<array<string>>")
    for how in (dict(size=8, rows_per_group=3), dict(size=30, rows_per_group=25, unit="characters"), dict(size=12, rows_per_group=12, whole_table=True)):
        config = ChunkConfig("table_aware", overlap=0, least=0, **how)
        expected = sorted(map(tuple, S.chunk_tables(whole, config).collect()))
        assert sorted(map(tuple, S.chunk_table_rows(rows, whole.select("doc_id", "table_id", "headers"), config, block=5).collect())) == expected
