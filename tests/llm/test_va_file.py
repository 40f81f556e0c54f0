"""Clusters over the approximation against plain rounds in NumPy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from panelspark.llm import va_file


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(256 * x) < va_file.MOST for x in v)]
    ids, x = [i for i, _ in kept], np.array([v for _, v in kept], dtype=np.int64).reshape(-1, dim)
    order = sorted((j for j in range(len(ids))), key=lambda j: (
        ids[j] is None, hashlib.sha256(f"2:{ids[j]}".encode()).hexdigest(), kept[j][1]))[:k]
    c = x[order].copy()
    for n in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        best = d.argmin(axis=1)
        if n < rounds:
            for j in range(len(c)):
                if (best == j).any():
                    c[j] = x[best == j].sum(axis=0) // (best == j).sum()
    return sorted((i is not None, i, int(b), int(d[r, b])) for r, (i, b) in enumerate(zip(ids, best))), c


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, b"") for i, v in rows], "vec_id long, embedding array<double>, cluster int, cells binary")


def found(spark, rows, k, rounds, dim, bits=va_file.BITS):
    got = va_file.clustered(frame(spark, rows), k, rounds, dim, bits=bits)
    return sorted((r.id is not None, r.id, r.cluster, r.distance) for r in got.members.collect()), got


@pytest.mark.parametrize("bits", [2, 5])
def test_clusters_equal_plain_rounds(spark, bits):
    r = np.random.default_rng(1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(r.normal(0, 0.3, (300, 5)))]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, [0.1] * 5), (400, None), (401, [0.1] * 4), (402, [0.1, None, 0.0, 0.0, 0.0]),
             (403, [math.nan] * 5), (404, [math.inf] + [0.0] * 4), (405, [1e300] + [0.0] * 4), (406, [2.0 ** 18] * 5)]
    want, centroids = plain(rows, 8, 3, 5)
    got, result = found(spark, rows, 8, 3, 5, bits)
    assert got == want
    assert (result.centroids == centroids).all()


def test_vectors_apart_are_not_fetched(spark):
    r = np.random.default_rng(2)
    centre = r.normal(0, 8, (6, 16))
    rows = [(int(i), (centre[i % 6] + r.normal(0, 0.05, 16)).tolist()) for i in range(600)]
    want, _ = plain(rows, 6, 4, 16)
    got, result = found(spark, rows, 6, 4, 16)
    assert got == want
    assert result.fetched[-1] < 300


def test_intervals_hold_the_distances():
    r = np.random.default_rng(3)
    v = r.integers(-300, 300, (500, 9))
    cells = va_file.Cells.of(v[:50], v.min(axis=0), v.max(axis=0), 3)
    place = cells.find(v)
    assert (cells.unpack(cells.pack(place)) == place).all()
    rows = np.arange(9)
    assert all((cells.low[rows, p] <= x).all() and (x <= cells.high[rows, p]).all() for p, x in zip(place, v))
    near = va_file.Intervals(cells, r.integers(-300, 300, (11, 9)))
    d = ((v[:, None] - near.centroids[None]) ** 2).sum(axis=2)
    left = near.left(place)
    assert left[np.arange(500), d.argmin(axis=1)].all() and not left.all()


def test_few_equal_and_no_vectors(spark):
    assert found(spark, [], 4, 2, 3)[0] == []
    got, result = found(spark, [(1, [0.5, 0.5, 0.5])] * 4, 40, 5, 3)
    assert got == [(True, 1, 0, 0)] * 4 and len(result.centroids) == 4
    table = va_file.inertia(result).collect()
    assert len(table) == 4 and {(r.inertia, r.cluster_inertia) for r in table} == {(0, 0)}


def test_sums_beyond_a_long_are_null(spark):
    rows = [(1, [2.0 ** 18.9] * 16), (2, [-(2.0 ** 18.9)] * 16), (3, [0.0] * 16)] * 24
    got = va_file.inertia(va_file.clustered(frame(spark, rows), 1, 1, 16)).collect()
    assert len(got) == 72 and {r.inertia for r in got} == {None}
