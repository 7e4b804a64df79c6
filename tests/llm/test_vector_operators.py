"""Whitening and vector codes, against plain brute force in Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyspark.sql.functions as F
import pytest

from gneiss.llm.queries import op12_whitening, op13_vector_codes
from gneiss.llm.vector_codes import Part, compress, grouped, squared, train_codes
from gneiss.llm.whitening import exact_cross, whiten

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def usable(rows):
    """(key, x, label) of rows as the operators take them."""
    longest = max((len(v) for _, v, *_ in rows if v and all(e is not None and math.isfinite(e) for e in v)), default=0)
    return [(r[0], tuple(math.floor(256 * float(e)) for e in r[1]), r[2]) for r in rows if r[1] and len(r[1]) == longest and all(e is not None and math.isfinite(e) for e in r[1])]


def from_table(spark, sf=SF):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


def awkward(n, length, seed, span=3.0):
    rng = random.Random(seed)
    rows = [(k, [float(np.float32(rng.gauss(0.3, span))) for _ in range(length)], rng.choice([None, 1, 2])) for k in range(n)]
    rows += [(rows[0][0], *rows[0][1:]), (None, rows[1][1], 7)]  # a repeated row, a null key
    rows += [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [1.0], 1), (n + 4, [NAN] * length, 1), (n + 5, [INF] + [0.0] * (length - 1), 1), (n + 6, [None] + [0.0] * (length - 1), 1)]
    return rows


def expected_whitening(rows, components=4):
    """n, deviation by key, eigenvalues, eigenvectors and whitened, with the covariance from fractions."""
    kept = usable(rows)
    fit = sorted({x for _, x, _ in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[Fraction(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    order = np.argsort(-values)[:components]
    trace = float(sum(cov[i][i] for i in range(d)))
    out = []
    for key, x, _ in kept:
        away = [n * a - s for a, s in zip(x, sums, strict=True)]
        out.append((key, n, sum(a * a for a in away), [float(np.array(away, float) / n @ vectors[:, k] / math.sqrt(values[k])) for k in order]))
    return out, [float(values[k] / trace) for k in order]


@pytest.mark.parametrize("table", ["given", "awkward"])
def test_whitening_against_fractions(spark, table):
    rows = from_table(spark) if table == "given" else awkward(60, 7, 3)
    got = op12_whitening(spark, SF).collect() if table == "given" else whiten(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    want, explained = expected_whitening(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation), r.n), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    assert len(got) == 4 * len(want) and set(by) == {(key, deviation, n) for key, n, deviation, _ in want}
    signs = [None] * 4
    for key, n, deviation, white in want:
        for k in range(4):
            own = by[key, deviation, n][k + 1]
            assert all(abs(abs(w) - abs(white[k])) < 1e-8 for w in own)
            if abs(white[k]) > 1e-3:
                signs[k] = signs[k] or math.copysign(1, own[0] * white[k])
                assert all(w * white[k] * signs[k] > 0 for w in own)


def test_whitening_without_variance_and_without_rows(spark):
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], SCHEMA)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in sorted(one)][:2] == [(1, 1, 0, None, 0.0, 0.0)] * 1 + [(2, 1, 0, None, 0.0, 0.0)]
    line = whiten(spark.createDataFrame([(k, [k / 256, 2 * k / 256], 0) for k in range(5)], SCHEMA)).where("component = 1").orderBy("vec_id").collect()
    assert [round(abs(r.whitened), 9) for r in line] == [round(abs(k - 2) / math.sqrt(2), 9) for k in range(5)] and line[0].explained == pytest.approx(1)
    empty = whiten(spark.createDataFrame([(1, None, 0)], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_with_figures_beyond_64_bits(spark):
    rows = [(k, [2.0**40 + 2.0**33 * k * k, -(2.0**52) + 2.0**45 * k], 0) for k in range(9)]
    got = {(r.vec_id, r.component): r for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), components=2).collect()}
    want, explained = expected_whitening(rows, 2)
    assert all(abs(got[key, k + 1].whitened) == pytest.approx(abs(white[k]), abs=1e-3) for key, _, _, white in want for k in range(2))
    assert {k: int(got[k, 1].deviation) for k in range(9)} == {key: d for key, _, d, _ in want} and max(d for _, _, d, _ in want) > 1 << 63


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 20, 1 << 40, (1 << 62) - 1):
        y = rng.integers(-top, top, (50, 3))
        assert (exact_cross(y) == y.astype(object).T @ y.astype(object)).all()


def expected_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda book, part: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for c in cut:
                own.setdefault(nearest(book, c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(v) // len(own[k]) for v in zip(*own[k], strict=True)) if k in own else e for k, e in enumerate(book)]
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    total = {}
    for (_, _, label), f in zip(kept, found, strict=True):
        total[label] = total.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted([(key, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[label], sha) for (key, _, label), f in zip(kept, found, strict=True)], key=str)


@pytest.mark.parametrize("table", ["given", "ties", "few", "wide"])
def test_codes_against_brute_force(spark, table):
    rows = {"given": lambda: from_table(spark), "ties": lambda: awkward(150, 16, 5, 0.01), "few": lambda: awkward(9, 32, 6), "wide": lambda: awkward(120, 48, 7, 300.0)}[table]()
    found = op13_vector_codes(spark, SF) if table == "given" else compress(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, found.collect()), key=str) == expected_codes(rows)


def test_codes_without_rows_and_of_vectors_that_do_not_fit(spark):
    assert compress(spark.createDataFrame([(1, [NAN], 1)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA), parts=2)
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [1e9] * 16, 1)], SCHEMA))


def test_bounds_spare_most_groups_and_never_the_nearest():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-12, 13, (5000, 4))
    group = grouped(centres, 8)
    code, _, bounds, _ = Part(centres, group, None).first(x)
    after = centres + rng.integers(-2, 3, centres.shape)
    got, error, lower, scanned = Part(after, group, centres).again(x, code, bounds)
    every = squared(x, after)
    assert (got == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()
    assert scanned < 0.5 * len(x) * (group.max() + 1)
    others = np.where(np.arange(64)[None] == got[:, None], np.inf, np.sqrt(every))
    assert all((lower[:, g] <= others[:, group == g].min(axis=1) + 1e-9).all() for g in range(group.max() + 1))


def test_rounds_scan_fewer_groups_than_there_are(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    codes, books = train_codes(rows)
    assert codes.agg(F.sum("scanned")).first()[0] < codes.count() * 16 * 8 and books.shape == (16, 64, 4)
