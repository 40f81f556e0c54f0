"""Null, tie and numeric rules on small frames whose results are known by hand."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions.calendar import last_complete_month, month_end, months
from panelspark.functions.student import t_two_sided
from panelspark.functions.text import article_text, gate, matched_keywords, matched_tags
from panelspark.functions.topics import TOPICS
from panelspark.operators import align as A
from panelspark.operators import calendar as C
from panelspark.operators import evaluate as E
from panelspark.operators import indicators as I
from panelspark.operators import news as N
from panelspark.operators import saliency as L
from panelspark.operators import stats as S
from panelspark.operators import windows as X
from panelspark.schema import DatasetSpec, Registry, Series, nan_to_null, numeric_only

S1 = Series(("id",), "t")
D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def series(spark, values, cols=("x",), id_="a"):
    rows = [(id_, day(i), *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, t date, " + ", ".join(f"{c} double" for c in cols))


def col(df, name, by="t"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_interpolation_is_weighted_by_days(spark):
    rows = [(t, v) for t, v in zip((0, 1, 2, 4, 5, 7), (None, 1.0, None, None, 3.0, None))]
    df = spark.createDataFrame([("a", day(t), v) for t, v in rows], "id string, t date, x double")
    assert col(C.interpolate_time(df, S1, ["x"]), "x") == [1, 1, 1.5, 2.5, 3, 3]


def test_reindex_happens_before_interpolation(spark):
    df = series(spark, [0.0, 100.0, 2.0])
    cal = spark.createDataFrame([(day(0),), (day(2),), (day(3),)], "t date")
    out = C.interpolate_time(A.reindex(df, S1, cal), S1, ["x"])
    assert col(out, "x") == [0.0, 2.0, 2.0]


def test_ffill_then_bfill(spark):
    df = series(spark, [None, 1.0, None, 2.0, None])
    assert col(C.ffill_bfill(df, S1, ["x"]), "x") == [1, 1, 1, 2, 2]


def test_keywords_overlap_plural_and_unicode_borders(spark):
    text = "Interest rates rise as golds fall; S&P 500 up"
    kws = ["interest rate", "interest rates", "gold", "silver", "s&p 500", "rate"]
    df = spark.createDataFrame([(text,), ("marigold éminent ñgold gold9",), ("gold",)], "x string")
    got = [r[0] for r in df.select(matched_keywords(F.col("x"), kws)).collect()]
    assert got[0] == sorted(set(kws) - {"silver"})
    assert got[1] == [] and got[2] == ["gold"]


def test_tags_need_the_subject_name(spark):
    kw = [("Subject", "A"), ("glocations", "B"), ("subject", "C"), ("SUBJECT", "A")]
    df = spark.createDataFrame([(kw,), (None,)], "k array<struct<name:string,value:string>>")
    got = [r[0] for r in df.select(matched_tags(F.col("k"), ["A", "B", "C"])).collect()]
    assert got == [["A", "C"], []]


def test_article_text_falls_back_to_the_headline(spark):
    df = spark.createDataFrame([(" a, b ", "h"), (",", " h,1"), (None, None)], "a string, h string")
    assert [r[0] for r in df.select(article_text(F.col("a"), F.col("h"))).collect()] == ["a b", "h1", None]


def test_gate_is_case_and_null_safe(spark):
    df = spark.createDataFrame([("Business", None), (None, "WORLD"), (None, None)], "d string, s string")
    assert [r[0] for r in df.select(gate(F.col("d"), F.col("s"), {"business"}, {"world"})).collect()] == [True, True, False]


@pytest.mark.parametrize("broad,tight,kws,want", [
    (["x"], ["y"], ["k"], "both"), (["x"], ["y"], [], "nyt_only"), ([], ["y"], ["k"], "nyt_only"),
    ([], [], ["k", "l"], "kw_only"), ([], [], ["k"], None), (["x"], [], [], None)])
def test_bucket_priority(spark, broad, tight, kws, want):
    df = spark.createDataFrame([(broad, tight, kws)], "b array<string>, t array<string>, k array<string>")
    assert df.select(N.bucket(F.col("b"), F.col("t"), F.col("k"))).first()[0] == want


def test_topics_categories_are_exclusive(spark):
    topic = TOPICS["metals"]
    rows = [("Copper mine strike lifts metal prices", [("subject", "Automobiles")]),
            ("Tariff and inflation worries", [("subject", "Interest Rates")]),
            ("Nothing to see", [("subject", "Cooking")])]
    df = spark.createDataFrame(
        [(t, None, "2024-01-01T05:00:00", "Business", "x", k) for t, k in rows],
        "abstract string, headline string, pub_date string, news_desk string, section_name string, "
        "keywords array<struct<name:string,value:string>>")
    got = {r["text"].split()[0]: (r["bucket"], r["category"]) for r in N.filter_articles(df, topic).collect()}
    assert got == {"Copper": ("both", "metal"), "Tariff": ("both", "economy")}


def test_argmax_takes_the_first_of_equal(spark):
    df = spark.createDataFrame([(.4, .4, .2), (.2, .4, .4), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(C.first_max_label([F.col(x) for x in "abc"])).collect()] == ["positive", "negative", None]


def test_rsi_without_losses_is_100(spark):
    out = I.add_rsi(series(spark, [5.0] * 16), S1, "x")
    assert col(out, "RSI") == [None] * 14 + [100.0, 100.0]


def test_zero_range_gives_null(spark):
    df = series(spark, [(5.0, 5.0, 5.0)] * 15, ("high", "low", "close"))
    out = I.add_stochastic(df, S1)
    assert set(col(out, "Stoch_K")) == {None}
    w = I.indicator(df, S1, "r", lambda w: I.williams_r("high", "low", "close", w), back=14)
    assert set(col(w, "r")) == {None}


def test_log_difference_needs_a_positive_column(spark):
    mixed = I.difference(series(spark, [1.0, 0.0, 3.0]), S1, ["x"], "log_diff")
    assert col(mixed, "x") == [-1.0, -1.0, 3.0]
    pos = I.difference(series(spark, [1.0, math.e, 1.0]), S1, ["x"], "log_diff")
    assert col(pos, "x") == pytest.approx([1.0, 1.0, -1.0])


def test_enrich_drops_the_warm_up_rows(spark):
    df = series(spark, [(10.0 + i % 3, 12.0 + i % 5, 9.0 - i % 2, 10.0 + i % 4) for i in range(40)],
                ("open", "high", "low", "close"))
    assert I.enrich(df, S1).count() == 25


def test_cum_return_survives_a_total_loss(spark):
    out = I.cum_return(series(spark, [0.1, -2.0, 0.5, -1.0, 0.2]), S1, "x")
    assert col(out, "cum_return") == pytest.approx([1.1, -1.1, -1.65, 0.0, 0.0])


def test_isolated_gap_only(spark):
    rows = [(day(i), .2 + i / 100, .5, .3, [float(i), 1.0], "negative") for i in (0, 2, 5)]
    df = spark.createDataFrame(rows, "t date, prob_positive double, prob_negative double, "
                                     "prob_neutral double, embedding array<double>, label string")
    out = {r["t"]: r for r in C.fill_isolated(df).collect()}
    assert sorted(out) == [day(0), day(1), day(2), day(5)]
    assert out[day(1)]["embedding"] == [1.0, 1.0] and out[day(1)]["label"] == "negative"
    assert out[day(1)]["prob_positive"] == pytest.approx(.21)


def test_softmax_literals(spark):
    df = spark.createDataFrame([(9.0, 8.0, 7.0), (5.0, 0.0, 0.0)], "a double, b double, c double")
    rows = df.select(*N.softmax([F.col(x) for x in "abc"])).collect()
    assert [round(v, 2) for v in rows[0]] == [.67, .24, .09] and rows[1][0] > .98


def test_row_softmax_literal(spark):
    df = spark.createDataFrame([("f", "a", .073673815), ("f", "b", .15281895), ("f", "c", .21120216)],
                               "f1 string, f2 string, r double")
    got = [r["attention"] for r in S.row_softmax(df).orderBy("f2").collect()]
    assert got == pytest.approx([.13961034, .30806366, .552326], abs=1e-6)


def test_months():
    assert last_complete_month(dt.date(2026, 7, 16)) == (2026, 6)
    assert last_complete_month(dt.date(2026, 1, 31)) == (2025, 12)
    assert months(2025, (2026, 2))[0] == (2025, 1) and len(months(2025, (2026, 2))) == 14
    assert month_end(2024, 2) == dt.date(2024, 2, 29)


@pytest.mark.parametrize("n,ctx,pred,want", [(40, 10, 7, 24), (17, 10, 7, 1), (16, 10, 7, 0)])
def test_window_count(spark, n, ctx, pred, want):
    df = series(spark, [float(i) for i in range(n)])
    assert X.sliding_windows(df, S1, ctx, pred, "x", size=8).count() == want


def test_windows_keep_nulls_in_place(spark):
    df = series(spark, [0.0, None, 2.0, 3.0, None])
    out = X.sliding_windows(df, S1, 2, 2, "x").orderBy("window").collect()
    assert [(r["x"], r["y"]) for r in out] == [([0.0, None], [2.0, 3.0]), ([None, 2.0], [3.0, None])]


def test_split_lead_in(spark):
    df = series(spark, [float(i) for i in range(60)])
    n = {r["split"]: r["count"] for r in X.temporal_split(df, S1, 10, 15, 5).groupBy("split").count().collect()}
    assert n == {"train": 35, "val": 20, "test": 15}
    short = X.temporal_split(series(spark, [1.0] * 12), S1, 10, 15, 5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in short} == {"val": 2, "test": 12}


def test_token_bins(spark):
    df = spark.createDataFrame([(-100.0,), (-15.0,), (0.0,), (15.0,), (100.0,)], "x double")
    got = [r[0] for r in df.select(X.token(F.col("x"), F.lit(1.0))).collect()]
    assert got == [3, 3, 2049, 4095, 4095]


def test_scale_of_zeros_is_one(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([None],), ([-2.0, 4.0],)], "x array<double>")
    assert [r[0] for r in df.select(X.window_scale("x")).collect()] == [1.0, 1.0, 3.0]


def test_dedupe_keeps_the_last_row(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (1, 2, "c"), (2, 1, "d")], "k int, s int, v string")
    got = {r["k"]: r["v"] for r in A.dedupe_last(df, ["k"], ["s"]).collect()}
    assert got == {1: None, 2: "d"}


def test_count_between_gives_the_tail_to_the_last_span(spark):
    k = Series((), "t")
    spans = spark.createDataFrame([(day(2),), (day(5),)], "t date")
    points = spark.createDataFrame([(day(i),) for i in (0, 2, 4, 5, 9, 9)], "t date")
    got = {r["t"]: r["n_points"] for r in A.count_between(points, spans, k).collect()}
    assert got == {day(2): 2, day(5): 3}


def test_cramers_v_of_a_perfect_match_is_one(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "y")] * 7, "p string, q string")
    assert S.cramers_v(df, "p", "q").first()["cramers_v"] == pytest.approx(1.0)


def test_crps_equals_the_pairwise_form(spark):
    ens, y = sorted([1.0, 4.0, 2.5, 2.5]), 3.0
    want = sum(abs(x - y) for x in ens) / 4 - sum(abs(a - b) for a in ens for b in ens) / 32
    df = spark.createDataFrame([(ens, y)], "e array<double>, y double")
    assert df.select(E.crps("e", F.col("y"))).first()[0] == pytest.approx(want)


def test_t_distribution():
    assert t_two_sided(2.228139, 10) == pytest.approx(.05, abs=1e-6)
    assert t_two_sided(1.0, 1) == pytest.approx(.5) and t_two_sided(0.0, 7) == 1.0


def test_dm_test_of_equal_losses(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 2, 1.0 + i % 2) for i in range(20)], "window int, mse double, mse_naive double")
    r = E.dm_test(df, [], h=3).first()
    assert r["stat"] == 0.0 and r["p_value"] == pytest.approx(1.0)


def test_jaccard_matches_all_pairs(spark):
    import itertools
    import random
    rng = random.Random(3)
    sets = [rng.sample(range(9), 3) for _ in range(12)]
    pairs = list(itertools.combinations(sets, 2))
    want = sum(len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in pairs) / len(pairs)
    df = spark.createDataFrame([("g", s) for s in sets] + [("one", [1, 2, 3])], "g string, s array<int>")
    got = {r["g"]: r["jaccard"] for r in L.jaccard_topk(df, ["g"], "s", 3).collect()}
    assert got["g"] == pytest.approx(want) and got["one"] == 1.0


def test_vector_mask(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]], [1])], "s array<array<double>>, i array<int>")
    assert df.select(L.mask_positions("s", "i", "mean", vector=True)).first()[0] == [[1.0, 2.0], [2.0, 4.0]]


def test_unknown_labels_raise(spark):
    bad = lambda: lambda texts: [{"embedding": [0.0], "probs": {"up": 1.0}} for _ in texts]
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(Exception, match="labels"):
        N.score_text(df, bad).collect()


def test_embedding_only_scorer(spark):
    only = lambda: lambda texts: [{"embedding": [1.0, 2.0]} for _ in texts]
    r = N.score_text(spark.createDataFrame([("x",)], "text string"), only).first()
    assert r["embedding"] == [1.0, 2.0] and r["prob_positive"] is None


def test_daily_news_without_probabilities(spark):
    df = spark.createDataFrame([(day(0), [1.0, 3.0]), (day(0), [3.0, 5.0])], "date date, embedding array<double>")
    r = N.daily_news(df).first()
    assert r["embedding"] == [2.0, 4.0] and "label" not in r.asDict()


def test_wide_news_and_back(spark):
    rows = [("d1", 1, "a"), ("d1", 2, "b"), ("d2", 1, "c")]
    wide = N.news_wide(spark.createDataFrame(rows, "date string, slot int, text string"))
    assert wide.columns == ["Date", "News 1", "News 2"]
    back = sorted((r["Date"], r["slot"], r["headline"]) for r in N.melt_headlines(wide).collect())
    assert back == rows
    with pytest.raises(ValueError, match="long form"):
        N.news_wide(spark.createDataFrame(rows, "date string, slot int, text string"), max_width=1)


def test_nan_becomes_null_and_arrays_are_not_numeric(spark):
    df = spark.createDataFrame([(float("nan"), [1.0], "s")], "x double, v array<double>, s string")
    assert nan_to_null(df).first()["x"] is None
    assert numeric_only(df, keep=("s",)).columns == ["x", "s"]


def test_unknown_dataset_fails_loudly():
    reg = Registry({"a": DatasetSpec("A")})
    assert reg["a"].target_id == "A"
    with pytest.raises(KeyError, match="known: a"):
        reg["b"]


def test_misaligned_streams_raise(spark):
    a, b = series(spark, [1.0, 2.0]), series(spark, [1.0])
    X.assert_aligned(a, a, ["id", "t"])
    with pytest.raises(ValueError):
        X.assert_aligned(a, b, ["id", "t"])
