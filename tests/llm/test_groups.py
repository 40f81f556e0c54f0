"""Greedy tiling, hot nodes, long pages, and the pipeline on documents that share ids."""

from __future__ import annotations

import time

import numpy as np
import pytest

import corpus_pipeline
from panelspark.llm import common, components, decontaminate, html_text, language, range_coder, simhash


def plain_tiles(text, item, least):
    """Greedy tiling as it is defined: the longest match of unmarked words, of equals the first, again and again."""
    least = max(1, min(least, len(item)))
    free = [np.ones(len(text), bool), np.ones(len(item), bool)]
    out = []
    while True:
        best = None
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n] and free[0][t + n] and free[1][p + n]:
                    n += 1
                if n >= least and (best is None or (-n, t, p) < best):
                    best = (-n, t, p)
        if best is None:
            return out
        n, t, p = -best[0], best[1], best[2]
        free[0][t:t + n] = free[1][p:p + n] = False
        out.append((n, t, p))


def test_tiles_are_greedy():
    r = np.random.default_rng(7)
    for trial in range(1000):
        letters = 2 if trial % 2 else 4
        text, item = (r.integers(1, 1 + letters, int(r.integers(0, 26))).astype(np.uint64) for _ in range(2))
        want = plain_tiles(text, item, 3)
        got = decontaminate.tiles(text, item, 3) if len(item) else []
        assert got == want, (text, item)
        assert sum(g[0] for g in got) <= decontaminate.reachable(text, item, 3)


def test_repeated_words_are_tiled_in_time():
    start = time.time()
    got = decontaminate.tiles(np.ones(4000, np.uint64), np.ones(300, np.uint64), 5)
    assert got == [(300, 0, 0)] and time.time() - start < 20


def test_pairs_that_share_boilerplate_alone_are_not_joined(spark):
    line = "all of these words stand in every item"
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(60)) + " " + line) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, line), (2, " ".join(f"w3x{j}" for j in range(60)))], "doc_id long, text string")
    got = decontaminate.overlaps(docs, items).collect()
    assert [(r.id, r.item_id) for r in got] == [(2, 3)]


def test_components_of_a_hot_node(spark, monkeypatch):
    """A node far beyond the bound is split by salts, and the components are the same."""
    monkeypatch.setattr(common.join_counted, "__defaults__", (50,))
    r = np.random.default_rng(1)
    pairs = [(7, int(k)) for k in range(10_000, 14_000)] + [(int(a), int(a) + 1) for a in r.integers(0, 3000, 900)]
    pairs += [(13_999, 2_000_000), (2_000_000, 1)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(8)
    got = {x.node: x.root for x in components.components(links).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_joined_groups_are_split(spark):
    big = spark.range(10_000).selectExpr("id % 3 * 0 k", "id v").union(spark.range(10).selectExpr("id + 1 k", "id v"))
    small = big.groupBy("k").count().selectExpr("k", "count _n", "k * 10 x")
    got = common.join_counted(big, small, "k", "v", hot=100)
    assert got.count() == 10_010 and got.where("x <> k * 10").count() == 0
    assert "_salt" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("page", [
    "<b>" * 20_000 + "</i>" * 20_000 + "text", "<b>" * 20_000 + "<div>" * 3 + "</b>" * 20_000 + "text",
    "<div>" * 20_000 + "</p>" * 20_000 + "text", "<b>" * 10_000 + "<div>" * 10_000 + "text", "<i>" * 5_000 + "<li>" * 20_000 + "text",
    "<p>a <b>" * 20_000, "x" * 300_000 + "<" * 20_000])
def test_long_pages_take_linear_time(page):
    start = time.time()
    parsed = html_text.parse(page)
    html_text.decode(parsed, np.full(len(parsed.nodes), 0.9))
    html_text.features(parsed)
    assert time.time() - start < 5
    assert any("text" in b or "a" in b or "x" in b for b in parsed.blocks)


def test_end_tags_keep_their_reach():
    def blocks(source):
        return html_text.parse(source).blocks
    assert blocks("<div><b>a<p>b</b>c</p>d</b></div>e") == ["a", "bc", "d", "e"]
    assert blocks("<ul><li>a<ul><li>b</ul><li>c</ul>d") == ["a", "b", "c", "d"]
    assert blocks("<p>a<div>b</p>c</div>d") == ["a", "bc", "d"]


def test_language_bound_has_no_threshold_in_rows():
    r = np.random.default_rng(0)
    scores = 1 - r.exponential(0.03, 2000)
    bounds = [language.smooth_bound(scores[:n]) for n in (1, 10, 100, 150, 198, 199, 200, 1000, 2000)]
    assert bounds[0] == 0 and all(0 < b < 1 for b in bounds[1:])
    assert max(abs(a - b) for a, b in zip(bounds[4:7], bounds[5:7])) < 0.01


def test_ids_beyond_their_bits_raise():
    with pytest.raises(ValueError, match="bits"):
        range_coder.encode([np.array([1, 70_000])], 16)
    assert range_coder.decode(range_coder.encode([np.array([], dtype=np.int64)], 16), [0], 16)[0].tolist() == []


A, B = "one two three four five six seven eight nine ten " * 4, "zulu yankee xray whiskey victor uniform tango sierra romeo " * 5
C = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam " * 4


@pytest.mark.parametrize("rows, kept", [
    ([(0, A), (1, A), (1, B)], [(0, A), (1, B)]),
    ([(5, A), (5, B)], [(5, A), (5, B)]),
    ([(5, A), (5, A), (6, A), (7, B)], [(5, A), (7, B)]),
    ([(3, C), (1, A), (1, B), (2, B), (0, B)], [(0, B), (1, A), (3, C)]),
    ([(None, A), (None, A), (1, A), (2, None), (4, "")], [(None, A), (None, A), (1, A), (2, None)]),
    ([], [])])
def test_one_document_of_each_group_by_id_and_text(spark, sf_dir, rows, kept):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "z") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _score double, root string")
    got = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(kept, key=str)


def test_decontamination_tells_documents_of_one_id_apart(spark, tmp_path):
    spark.createDataFrame([(1, C)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "x " + C, 9), (1, A, 9), (2, B, 9), (None, C, 9)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(1, A), (2, B), (None, C)], key=str)


def test_classes_that_share_an_id_have_roots_of_their_own(spark):
    docs = spark.createDataFrame([(5, A), (5, B), (6, B)], "doc_id long, text string")
    got = simhash.classes(docs).collect()
    assert {r.component_id for r in got} == {5} and len({r.root for r in got}) == 2
