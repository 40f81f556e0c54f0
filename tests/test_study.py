"""Fused scoring of variants against the written-out one."""

from __future__ import annotations

import numpy as np
import pytest

from panelspark.operators import saliency as L


def scorer():
    return lambda seqs: [float((np.asarray(x, dtype=float) ** 2) @ np.arange(1, len(x) + 1)) for x in seqs]


@pytest.mark.parametrize("strategy", ["mean", "zero"])
def test_fused_scores_equal_written_variants(spark, strategy):
    rng = np.random.default_rng(0)
    rows = [(w % 2, w, rng.normal(size=9).tolist(), [float(v) for v in rng.integers(0, 4, 9)]) for w in range(12)]
    df = spark.createDataFrame(rows, "g int, window long, seq array<double>, sal array<double>")
    want = L.score_variants(L.expand_variants(df, ["g"], [1, 3, 20], strategy=strategy), ["g"], scorer())
    got = L.study_scores(df, ["g"], scorer(), [1, 3, 20], strategy=strategy)
    key = ["g", "window", "variant", "k"]
    a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (want, got))
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) == 12 * (3 + 4 + 12 + 9)
    assert (a[key] == b[key]).all().all()
    for c in ("score", "base", "delta", "sal"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c
    few = L.study_scores(df, ["g"], scorer(), [1, 3], only=("insert", "shift"), strategy=strategy).toPandas()
    assert set(few.variant) == {"insert", "shift_-3", "shift_-1", "shift_1", "shift_3"}
    one = few.merge(b, on=key)
    assert np.allclose(one.delta_x, one.delta_y)


@pytest.mark.parametrize("k", [11, 30])
def test_stability_of_large_sets_matches_all_pairs(spark, monkeypatch, k):
    """Beyond the subset way: repeated sets, several blocks a key, members over more than one slice."""
    import itertools
    rng = np.random.default_rng(k)
    rows = [("a", [int(v) for v in rng.choice(60, k, replace=False)]) for _ in range(60)]
    rows += [rows[i % 7] for i in range(20)] + [("one", list(range(k))), ("same", list(range(k))), ("same", list(range(k))[::-1])]
    rows += [("apart", list(range(k * i, k * i + k))) for i in range(6)]
    monkeypatch.setattr(L, "BLOCK_SETS", 16)
    df = spark.createDataFrame(rows, "g string, s array<int>")
    got = {r["g"]: r["jaccard"] for r in L.jaccard_topk(df, ["g"], "s", k).collect()}
    for g in ("a", "apart", "same"):
        js = [len(x & y) / len(x | y) for x, y in itertools.combinations([set(s) for n, s in rows if n == g], 2)]
        assert got[g] == pytest.approx(sum(js) / len(js), abs=1e-6), g
    assert got["one"] == 1.0
    whole = L.jaccard_topk(df.filter("g = 'a'").drop("g"), [], "s", k).first()["jaccard"]
    assert whole == pytest.approx(got["a"], abs=1e-6)


def test_both_ways_of_stability_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("a" if i % 3 else "b", [int(v) for v in rng.choice(12, 4, replace=False)]) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, s array<int>")
    subsets = {r["g"]: r["jaccard"] for r in L.jaccard_topk(df, ["g"], "s", 4).collect()}
    monkeypatch.setattr(L, "SUBSET_K", 3)
    monkeypatch.setattr(L, "BLOCK_SETS", 9)
    blocks = {r["g"]: r["jaccard"] for r in L.jaccard_topk(df, ["g"], "s", 4).collect()}
    assert subsets == pytest.approx(blocks, abs=1e-6)
