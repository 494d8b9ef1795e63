"""Whitening against exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from bindery.llm import whitening
from bindery.llm.whitening import fit_whitening, whiten, whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int, deviation string, _key int, `a.b` int, n int"


def frame(spark, vectors, parts=3):
    rows = [(i, v, 1, "x", 2, 3, 4) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def vectors_of(n, dims, scale=0.3, seed=5):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(n, dims)) @ draw.normal(size=(dims, dims)) * scale
    return [(i - 3, [float(np.float32(c)) for c in row]) for i, row in enumerate(mixed)]


def expected(vectors):
    x = [[math.floor(1024 * Fraction(c)) + 100_000 for c in v] for _, v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(row[k] for row in x) for k in range(dims)]
    d = [[n * row[k] - sums[k] for k in range(dims)] for row in x]
    v = [[sum(r[a] * r[b] for r in d) / n**3 for b in range(dims)] for a in range(dims)]
    return n, sums, d, np.array(v)


def check(rows, vectors, components=8):
    n, sums, d, v = expected(vectors)
    values, base = np.linalg.eigh(v)
    values, base = values[::-1], base.T[::-1]
    by_id = {i: k for k, (i, _) in enumerate(vectors)}
    count = min(components, len(sums))
    assert len(rows) == n * count
    for r in rows:
        k, c = by_id[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum(e * e for e in d[k])
        value = sum(Fraction(e, n) * Fraction(float(u)) for e, u in zip(d[k], base[c]))
        assert abs(abs(r.whitened) - abs(float(value) / math.sqrt(values[c]))) < 1e-6
        assert abs(r.explained - values[c] / np.trace(v)) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("n, dims", [(60, 5), (200, 12), (40, 1)])
def test_against_fractions(spark, n, dims):
    vectors = vectors_of(n, dims)
    check(whitened_components(frame(spark, vectors)).collect(), vectors)


def test_small_steps_and_wide_entries(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STEP_ROWS", 7)
    vectors = vectors_of(50, 3, scale=1e10)  # squares past 64 bits
    rows = whitened_components(frame(spark, vectors, 1)).collect()
    check(rows, vectors)
    assert max(r.deviation for r in rows) > 1 << 63


def test_unusable_vectors_are_left_out(spark):
    vectors = vectors_of(40, 4)
    bad = [None, [], [1.0, None, 2.0, 3.0], [math.nan] * 4, [1.0, math.inf, 0.0, 0.0], [1.0, -math.inf, 0.0, 0.0], [1.0]]
    rows = whitened_components(frame(spark, vectors + [(1000 + i, v) for i, v in enumerate(bad)])).collect()
    check(rows, vectors)


def test_repeated_rows_and_null_identifiers(spark):
    vectors = vectors_of(30, 3)
    doubled = frame(spark, vectors + vectors[:5] + [(None, v) for _, v in vectors[:2]])
    rows = whitened_components(doubled).collect()
    assert len(rows) == 37 * 3 and all(r.n == 37 for r in rows)
    assert sum(r.vec_id is None for r in rows) == 6
    assert len({tuple(r) for r in rows if r.vec_id == vectors[0][0]}) == 3


def test_results_do_not_depend_on_partitions(spark):
    vectors = vectors_of(90, 6)
    models = [fit_whitening(frame(spark, vectors, parts)) for parts in (1, 4, 11)]
    for m in models[1:]:
        assert (m.n, m.sums, m.trace) == (models[0].n, models[0].sums, models[0].trace)
        assert (m.covariance == models[0].covariance).all()


def test_flat_dimensions_are_null(spark):
    vectors = [(i, [float(i), 2.0, float(i)]) for i in range(10)]
    rows = whitened_components(frame(spark, vectors)).collect()
    assert [r.whitened is None for r in sorted(rows)] == [False, True, True] * 10
    assert all(r.identity_error < 1e-9 for r in rows)
    one = whitened_components(frame(spark, vectors[:1])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, None)] * 3


def test_huge_entries_do_not_overflow(spark):
    vectors = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 5.0])]
    rows = whitened_components(frame(spark, vectors)).collect()
    assert len(rows) == 6 and all(r.n == 3 for r in rows)


def test_nothing_to_fit(spark):
    none = frame(spark, [])
    assert fit_whitening(none) is None and whitened_components(none).count() == 0
    assert whitened_components(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(none, None).columns == ["vec_id", "deviation", "whitened"]
