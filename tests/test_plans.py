"""What the plans must and must not contain."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspark.operators import indicators as I
from panelspark.schema import Series
from panelspark.sources.bars import read_panel

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "enrich_hourly", "difference", "reindex_interpolate", "ffill_bfill", "count_between", "sliding_windows",
    "temporal_split", "per_window_metrics", "reconcile_vendor", "trading_day_mask", "histogram_clipped",
    "jaccard_topk", "exact_quantiles_by_group", "fill_isolated_news", "autocorrelation", "dm_statistic"])
def test_no_cartesian_or_nested_loop(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["enrich_hourly", "sliding_windows", "indicator_rsi", "ffill_bfill", "difference"])
def test_row_windows_run_inside_bounded_pieces(name, spark, sf_dir):
    """Every window over rows is partitioned by a bucket or segment, not by the series alone.

    Windows over the bucket table itself are the only ones keyed by the series.
    """
    text = plan(QUERIES[name](spark, sf_dir))
    specs = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", text)
    assert specs
    for spec in specs:
        assert "_seg" in spec or "_bucket" in spec, spec


def test_indicators_share_one_exchange(spark):
    df = spark.range(100).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("id"), F.expr("date_add(date'2024-01-01', cast(id as int))").alias("t"),
                                 *[(F.col("id") + 1.0).alias(c) for c in ("open", "high", "low", "close")])
    text = plan(I.enrich(df, Series()))
    by_segment = re.findall(r"Exchange hashpartitioning\(id#\d+, _seg#\d+L", text)
    assert len(by_segment) == 1
    by_bucket = re.findall(r"Exchange hashpartitioning\(id#\d+, _bucket#\d+", text)
    assert len(by_bucket) <= 3


def test_no_task_holds_all_buckets_of_a_series(spark):
    """A million buckets of one key: windows and groups over them are keyed by a run as well, and runs are short."""
    from panelspark.operators import segments as G
    s = Series(("id",), "t", "1")
    table = spark.range(1_000_000).select(F.lit("a").alias("id"), F.col("id").alias("_at"), F.lit(1).alias("_rows"))
    out = G.carried(table, s.keys, "_at", {"_before": G.Carry("_rows", "sum"), "all_": G.Carry("_rows", "sum", "all")}, 2)
    specs = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", plan(out))
    assert specs and sum("_run" in x for x in specs) >= 3
    # what is keyed by the series alone is the uppermost table, a row for each FAN * FAN buckets
    assert out.where("coalesce(_before, 0) <> _at or all_ <> 1000000").count() == 0
    runs = table.groupBy(F.floor(F.col("_at") / G.FAN)).count()
    assert runs.agg(F.max("count")).first()[0] <= G.FAN and runs.count() <= 1_000_000 / G.FAN + 1


def test_projection_and_ids_reach_the_scan(spark, sf_dir):
    df = read_panel(spark, f"{sf_dir}/orders.parquet", ["1-URGENT"], ["o_totalprice"], "o_orderpriority", "o_orderdate")
    text = plan(df)
    assert "o_custkey" not in text
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in text


def test_cutoff_is_pushed_down(spark, sf_dir):
    from panelspark.operators.align import cutoff
    df = cutoff(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_totalprice"), "o_orderdate",
                dt.datetime(1996, 1, 1))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan(df))


def test_article_text_is_searched_once(spark, sf_dir):
    """Filters on the matches do not repeat the keyword search."""
    text = plan(QUERIES["filter_articles"](spark, sf_dir))
    assert text.count("RLIKE") <= text.count("Contains(") + text.count("contains(") + 40
    assert "Generate explode" in text


def test_members_meet_no_exchange_before_their_scores(spark):
    """Guard, rebuild and sort happen where members are drawn, and give what the long form gives."""
    import numpy as np
    from pyspark.sql import functions as F

    from panelspark.operators import evaluate as E

    def draw(x, pred, mc, seed):
        out = E.bootstrap(x, pred, mc, seed)
        out[seed % mc, 0] = np.nan
        return out
    rows = [("a", w, [float(v * v % 7 + w) for v in range(9)], [1.0, 2.0, 3.0], 10.0 + w) for w in range(40)]
    win = spark.createDataFrame(rows, "id string, window bigint, x array<double>, y array<double>, anchor double")
    steps = win.select("id", "window", F.col("anchor").alias("naive"), F.posexplode("y").alias("i", "truth"))
    truth = steps.select("id", "window", (F.col("i") + 1).alias("horizon"), "truth", "naive")
    for mode in ("diff", "log_diff"):
        short = E.score_ensembles(E.forecast_ensembles(win, ["id"], draw, 3, 20, 5, mode, "anchor"))
        assert "Exchange" not in plan(short)
        long_ = E.clean_samples(E.forecast(win, ["id"], draw, 3, 20, 5), ["id", "window"])
        long_ = E.score_steps(E.reconstruct(long_, win, ["id"], mode), truth, ["id"])
        key = ["id", "window", "horizon"]
        a, b = (d.orderBy(*key).select(*key, "crps", "mse", "wis80", "pit").toPandas() for d in (short, long_))
        assert len(a) == 120 and np.allclose(a.iloc[:, 3:], b.iloc[:, 3:], rtol=1e-9)


def test_nothing_pins_results_to_executors():
    import pathlib
    root = pathlib.Path(entry.__file__).parent / "panelspark"
    banned = ["local" + "Checkpoint", ".cross" + "Join(", ".rd" + "d", "persist("]
    for f in root.rglob("*.py"):
        text = f.read_text()
        for word in banned:
            assert word not in text, (f, word)


def test_row_differences_count_nothing_before_rows_are_dealt(spark, sf_dir):
    """No counting table grows with an input file's split, and copies by the thousand unfold."""
    from panelspark.operators.align import row_diff
    below = plan(QUERIES["row_differences"](spark, sf_dir)).split("== Initial Plan ==")[-1].rsplit("Exchange", 1)[1]
    assert "Scan parquet" in below and "Aggregate" not in below
    a = spark.range(9_000).select(F.when(F.col("id") > 0, "x").alias("v"), F.lit(1).alias("w"))
    b = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), (None, 1), (None, 1), (None, 1)], "v string, w int")
    got = {tuple(r[:3]): r[3] for r in row_diff(a, b).groupBy("v", "w", "side").count().collect()}
    assert got == {("x", 1, "only_a"): 8_997, ("x", 2, "only_b"): 1, (None, 1, "only_b"): 2}
