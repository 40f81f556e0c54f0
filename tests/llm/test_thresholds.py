"""Thresholds of the personal-data candidates, and what they find of planted loose forms."""

from __future__ import annotations

import numpy as np
import pytest

from panelspark.llm import boosting, personal


def test_lowest_threshold_has_the_precision():
    r = np.random.default_rng(0)
    p = np.round(r.uniform(0, 1, 4000), 3)
    y = (r.uniform(0, 1, 4000) < p).astype(float)
    t = boosting.lowest_threshold(p, y, 0.9)
    assert 0.5 <= t <= 1 and y[p >= t].mean() >= 0.899
    lower = np.unique(p[(p < t) & (p >= 0.5)])
    assert all(y[p >= u].sum() + u < 0.9 * ((p >= u).sum() + 1) for u in lower)
    assert boosting.lowest_threshold(np.array([0.9]), np.array([1.0]), 0.99) == 2.0
    assert boosting.lowest_threshold(np.array([0.99]), np.array([1.0]), 0.99) == 0.99
    assert boosting.lowest_threshold(np.array([0.99]), np.array([0.0]), 0.99) == 2.0
    assert boosting.lowest_threshold(np.array([]), np.array([]), 0.99) == 2.0


@pytest.fixture(scope="module")
def model(spark):
    return personal.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_planted_loose_forms(model):
    """Recall of loose forms, and precision on numbers of other uses, in whole made-up texts."""
    assert set(model.thresholds) <= {0, 1, 2, 3} and all(t >= 0.5 for t in model.thresholds.values())
    words = "the old mill stood by the river and the miller wrote down what the carts had brought".split()
    r = np.random.default_rng(3)

    def around(span):
        a, b = (" ".join(r.permutation(words)[:6]) for _ in range(2))
        return f"{a} {span} {b}."
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    name = lambda: "".join(r.permutation(list("abcdeghilmnorst"))[:6])
    loose, plain = [], []
    for _ in range(60):
        loose += [(0, f"{name()}[at]{name()}.org"), (3, f"({r.integers(201, 990)}) {r.integers(200, 999)}-{d(4)}"),
                  (1, f"10[.]{r.integers(0, 256)}[.]{r.integers(0, 256)}[.]{r.integers(1, 255)}")]
        plain += [f"{r.integers(1800, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}", f"{r.integers(10, 99)} of {r.integers(100, 999)}",
                  f"{r.integers(1, 12)}.{r.integers(10, 99)}", f"page {r.integers(10, 400)}"]
    found = 0
    for kind, span in loose:
        text = around(span)
        at = text.index(span)
        found += any(k == kind and a < at + len(span) and at < b for a, k, b in personal.all_spans(text, model)[1])
    wrong = sum(bool(personal.all_spans(around(s), model)[1]) for s in plain)
    assert found >= 0.9 * len(loose), found / len(loose)
    assert wrong <= 0.02 * len(plain), wrong / len(plain)


def test_examples_of_a_text_full_of_numbers_come_in_batches(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org " + " ".join(str(k) for k in range(6000)), "x"), (1, None, "y"), (2, "", "z")],
                                 "doc_id long, text string, kind string")
    assert personal.examples(docs).groupBy("held").count().count() >= 1
