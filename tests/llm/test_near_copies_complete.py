"""Near copies among texts that share a long passage: every candidate pair is compared, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from gneiss.llm import simhash


def crowd(n: int, common: int, own: int, seed: int = 5) -> list[str]:
    """n texts of one shared passage and words of their own, each followed by a copy with one word changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage, out = [word() for _ in range(common)], []
    for _ in range(n):
        mine = [word() for _ in range(own)]
        copy = list(mine)
        copy[own // 2] = word()
        out += [" ".join(passage + mine), " ".join(passage + copy)]
    return out


def by_brute_force(texts: list[str]) -> tuple[list[int], int]:
    got = list(simhash.text_sketches(pa.array(texts), simhash.TABLES, simhash.CHECKS))
    prints, checks = np.stack([g[1] for g in got]), np.stack([g[2] for g in got])
    above, links = list(range(len(texts))), 0

    def top(x: int) -> int:
        while above[x] != x:
            x = above[x]
        return x

    for k in range(len(texts)):
        met = (np.bitwise_count(prints[k] ^ prints[k + 1 :]) <= 2).any(axis=1)
        near = np.bitwise_count(checks[k] ^ checks[k + 1 :]).sum(axis=1, dtype=np.int64) <= simhash.MOST_BITS
        for j in (np.flatnonzero(met & near) + k + 1).tolist():
            links += 1
            x, y = top(k), top(j)
            above[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(texts))], links


def partition(tops) -> set[frozenset[int]]:
    groups: dict[int, set[int]] = {}
    for k, t in tops:
        groups.setdefault(t, set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_crowded_prints_lose_no_pair(spark):
    texts = crowd(1500, 240, 60)
    tops, links = by_brute_force(texts)
    assert links > 1000
    found = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert partition((r.doc_id, r.top) for r in found) == partition(enumerate(tops))


def test_blocks_of_one_print(spark):
    rng = np.random.default_rng(3)
    checks = rng.integers(0, 1 << 62, (60, 8))
    checks = np.concatenate((checks, checks ^ 1))
    rows = [(k, [7 ^ (k % 2), 99], [int(x) for x in c], k if k % 60 < 40 else 40 + 60 * (k // 60)) for k, c in enumerate(checks)]
    nodes = spark.createDataFrame(rows, "node long, prints array<long>, checks array<long>, top long")
    found = simhash.linked_tops(nodes, 90, size=8).collect()
    assert {frozenset((r.a, r.b)) for r in found} == {frozenset((k, k + 60)) for k in range(40)} | {frozenset((40, 100))}


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_recall_by_exact_similarity_does_not_depend_on_other_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    pairs = []
    for _ in range(400):
        own = [word() for _ in range(rng.randint(80, 300))]
        copy = list(own)
        for _ in range(rng.randint(1, max(1, len(own) // 40))):
            copy[rng.randrange(len(copy))] = word()
        pairs += [" ".join(own), " ".join(copy)]
    rows = list(enumerate(pairs)) + [(10_000 + k, t) for k, t in enumerate(crowd(400, 240, 60))]
    top = {r.doc_id: r.top for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [k for k in range(0, 800, 2) if lo <= jaccard(pairs[k], pairs[k + 1]) < hi]
        assert len(own) > 30 and sum(top[k] == top[k + 1] for k in own) >= 0.9 * len(own), (lo, len(own))
    assert len({top[k] for k in range(0, 800, 2)}) == 400


def test_dropping_near_copies_with_clashing_columns(spark):
    own = [" ".join(f"{w}{k}" for k in range(60)) for w in "abc"]
    rows = [(1, own[0]), (2, own[0] + " z"), (2, own[0] + " z"), (3, own[1]), (3, own[1]), (None, own[1]), (4, None), (5, ""), (6, own[2]), (6, own[1] + " y")]
    names = "doc_id long, text string, gone_id string, again_id string, near_key string, gone_key string, again_key string, node int, top int, h int"
    df = spark.createDataFrame([(*r, *"vwxyz", k, k, k) for k, r in enumerate(rows)], names)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]
