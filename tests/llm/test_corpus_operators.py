"""Classifier, mixing, SimHash, token output, decontamination, pipeline: brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm import components, decontaminate, mixing, quality_classifier as qc, rans, simhash, token_store
from gneiss.llm.words import shingles, words

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "a b", "é\t日本 x\x0b y\rz", "x" * 9000, "  two  spaces ", "line\r\nend\n"]


def noise(rng: random.Random, n: int, size: int = 30) -> list[str]:
    return ["".join(rng.choice(["a", "b ", "cc ", "\n", "é ", "\t", "the ", " ", "\x1c", "A", "日本 "]) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_words_against_split():
    texts = ODD + noise(random.Random(1), 400)
    found = words(pa.array(texts, pa.string()))
    hashes, known = found.hashes(), {}
    for k, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        lo, hi = found.first[k], found.first[k + 1]
        assert hi - lo == len(own)
        for w, h in zip(own, hashes[lo:hi].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    pairs, first = shingles(found, hashes, 2)
    assert np.diff(first).tolist() == [max(0, len((t or "").split(None)) - 1) if "\x1c" not in (t or "") else n for t, n in zip(texts, np.diff(first).tolist())]
    assert words(pa.array([], pa.string())).first.tolist() == [0]


def plain_fingerprint(text: str | None) -> int:
    own = (text or "").encode().lower().split()
    grams = [b" ".join(own[k : k + 3]) for k in range(len(own) - 2)] if len(own) >= 3 else [b" ".join(own)] if own else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def test_fingerprints_against_brute_force():
    for t in ODD + noise(random.Random(3), 150):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def groups_of(nodes, linked) -> dict:
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    for n, m in ((40, 25), (200, 199), (30, 0)):
        edges = [(k, k + 1) for k in range(n - 1)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
        want = groups_of(range(n), edges)
        inside = {x for e in edges if e[0] != e[1] for x in e}
        assert got == {k: v for k, v in want.items() if k in inside}


def test_near_fingerprints_link_as_all_pairs_do(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    prints = set(base)
    for p in base:
        for _ in range(6):
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    pairs = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), "fp", 2).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in pairs)
    want = groups_of(prints, [(a, b) for k, a in enumerate(prints) for b in prints[:k] if bin(a ^ b).count("1") <= 2])
    got = groups_of(prints, [(a % 2**64, b % 2**64) for a, b in pairs])
    assert got == want


def test_simhash_groups_with_nulls_repeats_and_clashing_names(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(3, long), (1, long + " x"), (1, long + " x"), (7, None), (None, " "), (9, "other words here entirely"), (None, "unlike the rest of all these")]
    df = spark.createDataFrame([(*r, 5, "b") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    near = bin(plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])).count("1") <= 2
    for r in got:
        assert r.component_id == {3: 1 if near else 3, 1: 1, 7: 7, 9: 9, None: 7 if r.fingerprint == "0" * 16 else None}[r.doc_id]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_near_copies_leave_one_of_each_group(spark):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(3000)]
    rows, copies = [], {}
    for d in range(40):
        own = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((d, " ".join(own)))
        for c in range(3):
            other = list(own)
            for _ in range(3):
                other[rng.randrange(len(other))] = "changed"
            copies[100 + 3 * d + c] = d
            rows.append((100 + 3 * d + c, " ".join(other)))
    rows += [rows[0], (900, ""), (901, None), (None, rows[5][1])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, near_key string")
    kept = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
    assert sorted(x for x in kept if x < 40) == list(range(40))
    assert len([x for x in kept if x in copies]) <= 2
    assert sum(x in (900, 901) for x in kept) == 1 and None not in kept
    assert simhash.drop_near_copies(df).columns == df.columns and simhash.drop_near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 33, 5000, 16384 * 2 + 5])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 50257).astype(np.uint32)
    cut = n // 3
    data = rans.encode([None, 5], np.array([cut, n - cut]), ids, 77)
    keys, counts, got, before = rans.decode(data)
    assert keys == [None, 5] and counts.tolist() == [cut, n - cut] and before == 77 and (got == ids).all() and len(got) == n
    if n > 16384:
        first, second = (rans.decode(data, only=[k])[2] for k in (0, 1))
        assert (np.concatenate((first, second)) == ids[: len(first) + len(second)]).all()
        bad = bytearray(data)
        bad[-8] ^= 255
        with pytest.raises(ValueError):
            rans.decode(bytes(bad))
    with pytest.raises(ValueError):
        rans.decode(b"XXXX" + data[4:])


def test_one_symbol_and_large_ids():
    for ids in (np.full(1000, 9), np.array([0, 2**31, 2**32 - 1] * 50), np.arange(70_000)):
        assert (rans.decode(rans.encode([1], np.array([len(ids)]), ids))[2] == ids).all()


def test_encoder_against_the_library(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_PIECES", 900)
    monkeypatch.setattr(token_store, "KNOWN_PIECES", 4000)
    rng, own, library = random.Random(3), token_store.Encoder(BPE), Tokenizer.from_file(BPE)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "bc", "don't", "12", "!!", "é", "日本", "<|endoftext|>", "\x1c", ".", "\x00", " x", "the", "😀", "word, ", "End.\nNext "]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for lo in range(0, len(texts), 200):  # the cache turns and is cleared between
        part = texts[lo : lo + 200]
        ids, n = own.encode(part)
        at = np.concatenate(([0], np.cumsum(n)))
        for k, t in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], t


def test_token_files_round_trip(spark):
    rows = [(k * 7 % 101, f"text number {k} " * (k % 9)) for k in range(101)] + [(5, "again"), (5, "again"), (None, "no id"), (3, None), (3, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    library = Tokenizer.from_file(BPE)
    got = token_store.tokenize(df, BPE).collect()
    assert len(got) == len(rows)
    want = sorted((d is not None, d or 0, n, c) for d, t in rows for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 0]] for n, c in [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_store.tokenize(df.limit(0), BPE).count() == 0


def exact_leaks(docs, items) -> set:
    out = set()
    for d, t in docs:
        own = decontaminate.tokens(t)
        for i, q in items:
            wanted = decontaminate.tokens(q)
            size = min(5, len(wanted))
            need = decontaminate.distinct_shingles(wanted, size) if size else set()
            shared = len(need & decontaminate.distinct_shingles(own, size)) if need else 0
            if need and shared >= 0.8 * len(need):
                out.add((d, i, shared, len(need)))
    return out


def test_leaks_against_exact_containment(spark):
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 20, 60, 200])))) for k in range(60)] + [(90, ""), (91, " ")]
    docs = []
    for d in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 50, 3000]))]
        for _ in range(rng.randint(0, 2)):
            q = items[rng.randrange(60)][1].split()
            if len(q) > 19 and rng.random() < 0.5:
                q[rng.randrange(len(q))] = "edited"
            if len(q) > 19 and rng.random() < 0.2:
                q[10:10] = ["put", "between"] * 30
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() for w in q]
        docs.append((d, rng.choice([" ", "\n", "  "]).join(own)))
    docs += [(500, None), (None, items[9][1]), (501, "V1  v2 z")]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([*items, items[3], (None, "v1 v2"), (77, None)], "item_id long, text string")
    want = exact_leaks(docs, [*items, (None, "v1 v2")])
    got = [(r.doc_id, r.item_id, r.shared, r.shingles) for r in decontaminate.leaked_pairs(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(w[1] is None for w in want)
    kept = decontaminate.drop_leaked(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {w[0] for w in want})
    assert decontaminate.drop_leaked(df, bench.limit(0)).count() == len(docs) and decontaminate.leaked_pairs(df.limit(0), bench).count() == 0


def test_leaks_of_scattered_items_with_ids_of_strings(spark):
    rng = random.Random(3)
    items = [(f"mmlu-{k}", " ".join(f"q{k}x{j}" for j in range(n))) for k, n in enumerate([5, 6, 7, 9, 20, 60, 200] * 3)]
    docs = []
    for d in range(200):
        own = [[f"n{d}y{j}" for j in range(rng.choice([1, 40]))] for _ in range(60)]
        _, text = items[d % len(items)]
        q = text.split()
        grams = [q[k : k + 5] for k in range(len(q) - 4)]
        rng.shuffle(grams)
        for g in grams[: round(len(grams) * rng.choice([0.7, 0.8, 0.85, 1]))]:
            own.insert(rng.randrange(len(own)), g)
        docs.append((f"d{d}", " ".join(w for part in own for w in part)))
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id string, text string, K1 string, gram int, leak_k1 int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = exact_leaks(docs, items)
    assert 100 < len(want) < 200
    got = {(r.doc_id, r.item_id, r.shared, r.shingles) for r in decontaminate.leaked_pairs(df, bench).collect()}
    assert got == want
    kept = decontaminate.drop_leaked(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def fill(sizes: list[int], weights, most) -> list[float]:
    """Water-filling by rounds: those over their cap are held, and the rest share what is left by weight."""
    total, held = float(sum(sizes)), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in held]
        left = total - sum(held.values())
        whole = sum(weights[k % len(weights)] for k in free)
        over = [k for k in free if left * weights[k % len(weights)] / whole > most * sizes[k]]
        if not over:
            return [held.get(k, left * weights[k % len(weights)] / whole if k in free else 0) for k in range(len(sizes))]
        held |= {k: float(most * sizes[k]) for k in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1000, 7, 3000, 0, 2], [1], [1, 1, 5000], [0, 0]])
def test_targets_against_rounds(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes) - 1)] + [None]
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    if sum(sizes):
        for name, want in zip(names, fill(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)):
            assert got[name] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(d, "w " * rng.randint(0, 40), rng.choice(["a", "b", "é", None, "z", "Z"]) if d % 3 else "a") for d in range(3000)] + [(1, None, "a"), (None, "x y", "b"), (None, "x y", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    one, two = (sorted(map(str, mixing.mix_sources(df).collect())) for _ in range(2))
    assert one == two and len(one) == len(rows)
    found = mixing.mix_sources(df).collect()
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        taken = sum(r.size * r.repeats for r in own)
        assert abs(taken - own[0].target) <= 40 and all(0 <= r.repeats <= 3 for r in own)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.repeats for r in found)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = qc.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum(g >= qc.THRESHOLD for g in good) / len(good) > 0.97


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=qc.GROUPS * qc.SPACE + 1)
    texts = ["The THE cat cat $$$ 12", "", "one", None, "a b c d e"]
    column = pa.array(texts, pa.string())
    for (at, x, _), score in zip(qc.sparse_rows(column, [0] * len(texts)), qc.scores(column, weights)):
        assert score == pytest.approx(1 / (1 + np.exp(-(weights[at] @ x))), rel=1e-9)


def test_classifier_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (5, ""), (6, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, None), (None, 1), (5, 0)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        rows = qc.score_quality(docs, given).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
        assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert qc.score_quality(docs.limit(0), labels).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] > kept[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == kept[-1] and out.agg(F.sum("n_tokens")).first()[0] == out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]


def test_token_files_with_ids_that_are_no_integers(spark, tmp_path):
    """Strings and decimals, null, repeated: in the order of the ids, and back in their own type."""
    known = Tokenizer.from_file(BPE)
    texts = {"b": "Hello, world.", "a": "", "ä": "über 12", "c": None, None: "null id"}
    for kind, given in (("string", list(texts.items()) + [("b", "Hello, world.")]), ("decimal(9,2)", [(Decimal("1.50"), "x y"), (Decimal("-3.00"), "z"), (None, "w")])):
        docs = spark.createDataFrame(given, f"doc_id {kind}, text string").repartition(3)
        got = sorted(token_store.tokenize(docs, BPE, False).collect(), key=lambda r: r.start)
        order = sorted(given, key=lambda g: (g[0] is not None, g[0] if g[0] is not None else 0, g[1] or ""))
        assert [r.doc_id for r in got] == [g[0] for g in order]
        ids = [[*known.encode(t or "", add_special_tokens=False).ids, 0] for _, t in order]
        assert [r.n_tokens for r in got] == list(map(len, ids)) and [r.ids_crc32 for r in got] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
        path = str(tmp_path / kind[:3])
        token_store.write_tokens(docs, path, BPE, False)
        assert sorted(map(str, (list(r.ids) for r in token_store.read_tokens(spark, path).collect()))) == sorted(map(str, ids))


def test_a_phrase_of_many_items_and_documents_makes_no_candidates(spark, monkeypatch):
    """Each of 80 items and 300 documents has the same passage; only the documents with an item of their own are candidates, of that item alone."""
    rng = random.Random(12)
    made = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    stock = made(8)
    items = [(k, f"{made(30)} {stock} {made(6)}") for k in range(80)] + [(None, stock)]
    docs = [(k, f"{made(40)} {stock} {made(9)}") for k in range(300)] + [(1000 + k, f"{made(5)} {items[k][1]} {made(5)}") for k in range(3)] + [(2000, " ".join(items[5][1].split()[:12]))]
    seen = []
    whole = decontaminate.candidates
    monkeypatch.setattr(decontaminate, "candidates", lambda f, k: seen.append(whole(f, k).collect()) or whole(f, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    assert got == {(k, None) for k in range(300)} | {(1000 + k, i) for k in range(3) for i in (k, None)}
    assert len([c for c in seen[0] if c.item_id is not None]) == 3
